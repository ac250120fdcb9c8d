"""Reading level of texts: a linear ranker learned from pairs of graded texts, calibrated by isotonic regression.

Features tell the syntax of a text (length of sentences and words, clauses, commas, passive and nominal endings) and
its vocabulary (hashed words and pairs of words, each by its share in the text). The ranker learns from pairs of
texts of different levels which is the more demanding; isotonic regression turns its scores into levels. What has no
level is told by the shares of words, structure and foreign signs, and by a model of the letters of German and English
words, learned from the graded texts, whose held-out scores set its threshold. Texts are worked on in batches: each
distinct word and piece of a batch is looked at once, the rest is arrays.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Most labelled documents that the ranker is fitted on, drawn by a hash of their key; and its size and training.
LABELS, HASHED, EPOCHS, RATE, DECAY, SEED = 2_000, 1 << 15, 15, 0.5, 1e-5, 42
#: Pairs of texts that one step of the training takes.
BATCH = 64
#: Only prose of at least so many pieces between white space has a level.
LEAST_WORDS = 25
#: Standard deviations by which a text of another language is less likely than the least likely graded text when held out.
SPREAD = 2.0
LONGEST = 200

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*")
_SENTENCE = regex.compile(r"[.!?…]+(?=\s|$|[\"“”'])|\n\s*\n")
_CLAUSE = regex.compile(r"[,;:–]")
_DIGIT = regex.compile(r"\p{Nd}")
_FORMULA = regex.compile(r"[=≈≤≥∑∂→∞φκ√∫±·^_{}<>|§%]")
_WORDLIKE = regex.compile(r"^[(\[„“”\"'‚‘«»*-]*\p{L}[\p{L}\p{M}'’/.-]*[.,:;!?)\]\"“”'’…*–-]*$")
#: Fields that no space parts, keys with their value, braces, indexes and calls with quotes.
_STRUCTURED = regex.compile(r"[;|]\S*[;|]|^[^;]*\d;\S|\p{L};\S|\"\s*:|^\"[^\"]*\",?\]?[,}]*$|\w\[\d|\w\([\"']|[\"']\)|^[{}\[\]]|\p{L}{2}=\S|::|^#$|^(?:def|return|import|elif)$")
#: Signs and letters of other scripts; formulas hold Greek letters and mathematical signs, which are none.
_STRANGE = regex.compile(r"(?![°©®])[\p{So}\p{Nl}\p{Sk}ﬀ-ﬆ]|(?![\p{Latin}\p{Greek}])\p{L}|(?![0-9])\p{Nd}|[²µΩœ](?=\p{L}{2})")
_HEADER = regex.compile(r"^\s*\[\d+-\p{L}+\]\s*")
# The commonest words of German and English prose.
FUNCTION_WORDS = {
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "und", "oder", "aber", "nicht", "kein", "keine",
    "ist", "sind", "war", "waren", "wird", "werden", "wurde", "hat", "haben", "hatte", "kann", "soll", "muss", "auf", "aus", "bei", "mit",
    "nach", "von", "vom", "vor", "zu", "zum", "zur", "im", "in", "am", "an", "für", "über", "unter", "durch", "als", "wie", "wenn", "weil",
    "dass", "so", "auch", "noch", "nur", "schon", "es", "er", "sie", "wir", "ich", "uns", "man", "sich", "wo", "was", "wer",
    "the", "a", "an", "and", "or", "but", "not", "no", "is", "are", "was", "were", "be", "been", "has", "have", "had", "can", "will", "would",
    "should", "must", "of", "to", "on", "at", "by", "for", "from", "with", "as", "that", "this", "which", "who", "what", "it", "he",
    "she", "we", "you", "they", "i", "my", "our", "your", "its", "their", "if", "when", "because", "than", "then", "there", "all", "do", "does",
}
N_SYNTAX = 15


@lru_cache(maxsize=200_000)
def _kind(piece: str) -> tuple[bool, bool, bool, bool]:
    """Whether a piece is a word, structure, strange, and a bar."""
    return bool(_WORDLIKE.match(piece)), bool(_STRUCTURED.search(piece)), bool(_STRANGE.search(piece)), piece == "|"


NOMINAL = ("ung", "heit", "keit", "tion", "ität", "ment", "ness", "ity")
PASSIVE = {"wird", "werden", "wurde", "worden", "been", "being", "be"}


@lru_cache(maxsize=200_000)
def _told(word: str) -> tuple[int, int, int, bool, bool, bool]:
    """Hashes of a word and of its end, its length, whether it is a function word, nominal, passive."""
    return zlib.crc32(word.encode()), zlib.crc32(f"~{word[-5:]}".encode()), len(word), word in FUNCTION_WORDS, word.endswith(NOMINAL), word in PASSIVE


#: Letters that the model of words tells apart; ^ and $ are a word's ends, others count as one.
ALPHABET = {c: i for i, c in enumerate("^$abcdefghijklmnopqrstuvwxyzäöüß")}


@lru_cache(maxsize=200_000)
def _triples(word: str) -> tuple[int, ...]:
    """The letters of a word in threes, as numbers; none for the names of variables and units, of up to two letters."""
    if len(word) < 3:
        return ()
    n = len(ALPHABET) + 1
    at = [0, 0, *[ALPHABET.get(c, n - 1) for c in word if c not in "'’-"], 1]
    return tuple((at[i] * n + at[i + 1]) * n + at[i + 2] for i in range(len(at) - 2))


def _per_text(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values by text; starts: where each text's values begin, and their end."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[starts[1:]] - total[starts[:-1]]


def _starts(lists: list[list[str]]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("int64")


def _distinct(lists: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """(which of the distinct strings each one is, the distinct strings)."""
    codes, seen = pd.factorize(np.array([*chain.from_iterable(lists)], dtype=object))
    return codes, list(seen)


@dataclass
class Tokens:
    """The words of a batch of texts."""

    per: list[list[int]]
    starts: np.ndarray
    codes: np.ndarray
    seen: list[str]


def tokenise(texts: list[str]) -> Tokens:
    """Words by sentence; no word goes over the end of a sentence."""
    parts = [[_WORD.findall(p.lower()) for p in _SENTENCE.split(t) if p] for t in texts]
    words = [[*chain.from_iterable(p)] for p in parts]
    return Tokens([[len(x) for x in p if x] for p in parts], _starts(words), *_distinct(words))


def prose(texts: list[str | None]) -> np.ndarray:
    """Whether texts may have a level: enough words, and not made of fields, code, data or signs.

    Every piece between white space is a word, a neutral piece (a number, a unit, a part of a formula) or structure
    (fields joined by signs, quoted keys, calls). Prose has many words, little structure and few foreign signs. Pieces
    are searched whole, however long.
    """
    lists = [x.split() if x else [] for x in texts]
    enough = np.array([len(x) >= LEAST_WORDS for x in lists], bool)
    lists = [_HEADER.sub("", t).split() if e else [] for t, e in zip(texts, enough, strict=True)]
    starts, (codes, seen) = _starts(lists), _distinct(lists)
    # No word is longer than LONGEST; longer pieces aren't kept.
    kinds = np.array([_kind(p) if len(p) <= LONGEST else (False, bool(_STRUCTURED.search(p)), bool(_STRANGE.search(p)), False) for p in seen], float).reshape(-1, 4)
    words, structure, strange, bars = (_per_text(starts, kinds[codes, k]) for k in range(4))
    n = np.maximum(np.diff(starts), 1)
    return enough & (words >= 0.3 * n) & (structure <= 0.08 * n) & (strange <= 0.08 * n) & (bars <= 0.1 * n)


def is_prose(text: str | None) -> bool:
    return bool(prose([text])[0])


@dataclass
class Features:
    """Of a batch of texts: for every bucket of the vocabulary that a text has, the text, the bucket and the value; and the syntax."""

    text: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    syntax: np.ndarray


def features(texts: list[str], tokens: Tokens) -> Features:
    """The hashed vocabulary and the syntax values of prose texts."""
    starts, codes = tokens.starts, tokens.codes
    told = np.array([_told(w) for w in tokens.seen], dtype="int64").reshape(-1, 6)
    count = np.diff(starts)
    n = np.maximum(count, 1)
    size = told[codes, 2]
    per = [np.array(p or [0], float) for p in tokens.per]
    s = np.maximum([len(p) for p in tokens.per], 1)
    share = lambda x: _per_text(starts, x) / n
    which = np.repeat(np.arange(len(texts)), count)
    distinct = np.bincount(np.unique(which * max(len(told), 1) + codes) // max(len(told), 1), minlength=len(texts))
    syntax = np.column_stack([
        np.log1p([p.mean() for p in per]), np.log1p([np.median(p) for p in per]), np.log1p([p.max() for p in per]),
        share(size) / 10, share(size >= 10), share(size >= 15), share(size <= 4),
        np.array([len(_CLAUSE.findall(t)) for t in texts]) / n, share(told[codes, 3]), share(told[codes, 4]), share(told[codes, 5]),
        np.array([len(_FORMULA.findall(t)) for t in texts]) / n, np.array([len(_DIGIT.findall(t)) for t in texts]) / np.maximum([len(t) for t in texts], 1),
        np.array([t.count("?") + t.count("!") for t in texts]) / s, distinct / n,
    ])
    # Words that name a place or plant occur in few texts and teach nothing; hashing keeps the table's size fixed.
    single = told[codes, 0].astype(np.uint64)
    before = np.roll(single, 1)
    has = np.flatnonzero(count)
    before[starts[has]] = single[starts[has + 1] - 1]  # before a text's first word stands its last
    double = (before * np.uint64(0x9E3779B1) + single) & np.uint64(0xFFFFFFFF)
    hashed = np.concatenate([single, double, told[codes, 1].astype(np.uint64)]) % np.uint64(HASHED)
    keys, counts = np.unique(np.tile(which, 3) * HASHED + hashed.astype("int64"), return_counts=True)
    text, value = keys // HASHED, np.sqrt(counts)
    norm = np.sqrt(np.bincount(text, weights=counts, minlength=len(texts)))
    return Features(text, keys % HASHED, value / np.maximum(norm[text], 1e-9), syntax)


def standardised(syntax: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Syntax values in deviations from the labelled texts, cut at 3, so that very long texts don't stand out."""
    return np.clip((syntax - mean) / scale, -3.0, 3.0) / math.sqrt(N_SYNTAX)


@dataclass
class Ranker:
    """Weights of syntax and vocabulary, the steps of the calibration (scores from knots[i] on have levels[i]), and the model of words.

    letters: log probability of each letter after two others; least: a text whose words are less likely, in the mean
    over their letters, is neither German nor English.
    """

    mean: np.ndarray
    scale: np.ndarray
    syntax: np.ndarray
    vocabulary: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    letters: np.ndarray
    least: float = -math.inf

    def scores(self, texts: list[str], tokens: Tokens) -> np.ndarray:
        x = features(texts, tokens)
        words = np.bincount(x.text, weights=self.vocabulary[x.bucket] * x.value, minlength=len(texts))
        return words + standardised(x.syntax, self.mean, self.scale) @ self.syntax

    def level(self, score: float) -> float:
        """Interpolated between the calibration's steps."""
        return float(np.interp(score, self.knots, self.levels))

    def read(self, texts: list[str | None]) -> np.ndarray:
        """The levels of texts, NaN for what has none."""
        out = np.full(len(texts), math.nan)
        fit = np.flatnonzero(prose(texts))
        if len(fit):
            kept = [texts[i] for i in fit]
            tokens = tokenise(kept)
            known = likelihoods(tokens, self.letters) >= self.least
            out[fit] = np.where(known, np.interp(self.scores(kept, tokens), self.knots, self.levels), math.nan)
        return out


def letter_model(tokens: Tokens, rows: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of letters after two others in the distinct words of texts (or of some rows of them)."""
    n = len(ALPHABET) + 1
    codes = tokens.codes if rows is None else np.concatenate([tokens.codes[tokens.starts[i] : tokens.starts[i + 1]] for i in rows] or [np.array([], int)])
    counts = np.full(n**3, 0.05)
    at = np.array([*chain.from_iterable(_triples(tokens.seen[c]) for c in np.unique(codes))], dtype="int64")
    np.add.at(counts, at, 1.0)
    table = counts.reshape(-1, n)
    return np.log(table / table.sum(1, keepdims=True)).ravel()


def likelihoods(tokens: Tokens, letters: np.ndarray) -> np.ndarray:
    """Mean log probability of the letters of each text's words; 0 without words."""
    told = np.array([(letters[[*_triples(w)]].sum() if len(w) > 2 else 0.0, len(_triples(w))) for w in tokens.seen], float).reshape(-1, 2)
    return _per_text(tokens.starts, told[tokens.codes, 0]) / np.maximum(_per_text(tokens.starts, told[tokens.codes, 1]), 1)


def pool_adjacent(scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of values on scores: the least and the largest score of each pooled block, each with its value, ascending.

    Between blocks the values are joined by a line, so that a border lies where the scores are apart.
    """
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(scores[order], values[order], strict=True):
        blocks.append([s, s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, high, v2, n2 = blocks.pop()
            low, _, v1, n1 = blocks.pop()
            blocks.append([low, high, (v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.array([x for b in blocks for x in b[:2]]), np.array([b[2] for b in blocks for _ in range(2)])


def _gram(x: Features, dense: np.ndarray, block: int = 256) -> np.ndarray:
    """Products of all pairs of the labelled texts, which are few; worked out in blocks."""
    n = len(dense)
    out = (dense @ dense.T).astype(np.float32)
    first = np.searchsorted(x.text, np.arange(n + 1))

    def rows(a: int) -> np.ndarray:
        b = min(n, a + block)
        part = np.zeros((b - a, HASHED), np.float32)
        own = slice(first[a], first[b])
        part[x.text[own] - a, x.bucket[own]] = x.value[own]
        return part

    for a in range(0, n, block):
        left = rows(a)
        for c in range(a, n, block):
            out[a : a + block, c : c + block] += (p := left @ (left if c == a else rows(c)).T)
            if c != a:
                out[c : c + block, a : a + block] += p.T
    return out


def _train(gram: np.ndarray, grades: np.ndarray, rows: np.ndarray, seed: int) -> np.ndarray:
    """How much each text weighs in the ranker that is learned from pairs of the given rows."""
    rng = np.random.default_rng(seed)
    weight, score = np.zeros(len(grades)), np.zeros(len(grades), np.float32)
    levels = np.unique(grades[rows])
    by_level = [rows[grades[rows] == g] for g in levels]
    own = np.searchsorted(levels, grades[rows])
    step = 0
    # Pairs of neighbouring levels are the hard ones; each text meets one of every other level an epoch.
    for _ in range(EPOCHS):
        hard, easy = [], []
        for k in range(len(levels)):
            take = (own != k) & ((np.abs(own - k) == 1) | (rng.random(len(rows)) < 0.3))
            other = rng.choice(by_level[k], take.sum())
            hard.append(np.where(own[take] > k, rows[take], other))
            easy.append(np.where(own[take] > k, other, rows[take]))
        order = rng.permutation(sum(map(len, hard)))
        hard, easy = np.concatenate(hard)[order], np.concatenate(easy)[order]
        for a in range(0, len(order), BATCH):
            h, e = hard[a : a + BATCH], easy[a : a + BATCH]
            step += len(h)
            pull = np.float32(RATE) / (1 + step / (20 * len(rows))) / (1 + np.exp(np.minimum(30.0, 4 * (score[h] - score[e]))))
            np.add.at(weight, h, pull)
            np.subtract.at(weight, e, pull)
            score += pull @ gram[h] - pull @ gram[e]  # gram is symmetric, and its rows lie together
            weight *= 1 - DECAY * len(h)
            score *= 1 - DECAY * len(h)
    return weight


def fit(texts: list[str], grades: list[int], seed: int = SEED, folds: int = 4) -> Ranker:
    """A ranker fitted on all texts; calibrated on scores that rankers give to texts they were not fitted on."""
    kept = [(t, g) for t, g, p in zip(texts, grades, prose(texts), strict=True) if p]
    texts, values = [t for t, _ in kept], np.array([g for _, g in kept], float)
    tokens = tokenise(texts)
    letters = letter_model(tokens)
    if len(np.unique(values)) < 2:
        level = float(values.mean()) if kept else math.nan
        return Ranker(np.zeros(N_SYNTAX), np.ones(N_SYNTAX), np.zeros(N_SYNTAX), np.zeros(HASHED), np.array([0.0]), np.array([level]), letters)
    x = features(texts, tokens)
    mean, scale = x.syntax.mean(0), x.syntax.std(0) + 1e-6
    dense = standardised(x.syntax, mean, scale)
    gram, everything = _gram(x, dense), np.arange(len(texts))
    weight = _train(gram, values, everything, seed)
    vocabulary = np.bincount(x.bucket, weights=weight[x.text] * x.value, minlength=HASHED)
    fold = np.random.default_rng(seed).permutation(len(texts)) % folds
    scores, likely = gram @ weight, np.empty(len(texts))
    for k in range(folds):
        inside = everything[fold != k]
        if len(np.unique(values[inside])) > 1:
            scores[fold == k] = gram[fold == k] @ _train(gram, values, inside, seed + 1 + k)
        likely[fold == k] = likelihoods(tokens, letter_model(tokens, inside))[fold == k]
    knots, levels = pool_adjacent(scores, values)
    return Ranker(mean, scale, dense.T @ weight, vocabulary, knots, levels, letters, float(likely.min() - SPREAD * likely.std()))


def fit_labels(documents: DataFrame, labels: DataFrame, most: int = LABELS) -> Ranker:
    """The ranker of the labelled documents, of at most `most` of them."""
    drawn = labels.select("doc_id", "reading_level").filter("reading_level BETWEEN 1 AND 5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` texts come to the driver.
    graded = documents.select("doc_id", "text").join(drawn, "doc_id").filter(F.col("text").isNotNull()).orderBy("doc_id").toPandas()
    return fit(graded.text.tolist(), graded.reading_level.tolist())


def reading_level(text: Column, ranker: Ranker) -> Column:
    """The level of a text, from 1.0 to 5.0; null for null, for all that isn't German or English prose, and if no label was given at all.

    Whole texts are read, however long; repeated texts have equal levels. Labels of null or absent documents and levels
    beyond 1 to 5 teach nothing; labels of one level only give that level to all prose.
    """

    @pandas_udf("double")
    def level(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            levels = ranker.read([x if isinstance(x, str) else None for x in texts])
            yield pd.Series(pd.arrays.FloatingArray(np.nan_to_num(levels), np.isnan(levels)))

    # Else a filter on the level would be pushed below the projection and read everything twice.
    return level.asNondeterministic()(text)
