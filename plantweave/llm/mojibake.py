"""Text spoiled by a wrong character encoding: found and restored by a noisy-channel decoder.

A channel writes text in one encoding and reads it in another, or loses letters to a substitute sign. What each
channel makes of each letter is worked out from the codecs; turned round, this gives every word a lattice of the
letters that it may have had, with wildcards for lost ones, read in any letter case since texts are reformatted
afterwards. A list Viterbi search under a character model keeps the best paths of each channel, and the words
they spell are looked up in the corpus by a join. A word is spoiled if a channel explains it better than the
corpus does as it stands. Signs that only a wrong encoding leaves make it the less likely that it stands as it was written.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, maybe_broadcast, spread

#: Letters that every channel may have spoiled, and signs that only multi-byte channels show beyond doubt.
GERMAN = "äöüÄÖÜß"
WIDE = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)])) + "–—„“”‚‘’…€°§\xa0\xad"
SINGLE = GERMAN + "éèáàãõøåæçñÉÈÁÀÃÕØÅÆÇÑ"
#: Paths kept a word and channel.
PATHS = 16
#: Log priors: of a word that was spoiled, more by a multi-byte channel, less for one that becomes no word of the corpus, of a question mark that was added,
#: of a foreign letter and of a sign inside a word.
SPOILED, SURE, UNKNOWN, ADDED, FOREIGN, SIGN = -6.0, 4.0, -3.0, -4.0, -12.0, -16.0
#: Log likelihoods of signs that only a wrong encoding leaves in a word that stands as it was written, and of a word that was spoiled
#: by none of the channels.
TELLING, UNDONE = -120.0, -80.0

#: Values that hold none of these are written in plain German letters and can't be spoiled.
SUSPICIOUS = r"[^\x{0}-\x{7E}äöüÄÖÜß]|\?"

_BETWEEN = regex.compile(r"(?:(?<![ÂâÃãÅåÄäŠš┬├√])\xa0|[\s　 -  --\xa0\x85]|[(){}\[\].,;:/+&*_\"'|<>=!-])+", regex.V1)
_INVISIBLE = regex.compile(r"\xad|[​-‏⁠]")
_CERTAIN = regex.compile(r"[�﻿\x7f-\x84\x86-\x9f─-◿√]|ï»¿|Ï»¿")
_MIXED = regex.compile(r"(?=.*\p{Latin})(?=.*[\p{Cyrillic}\p{Han}\p{Hangul}\p{Katakana}\p{Greek}])")
_QUOTES = "„“”‚‘’«»–—…"
_ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüß"


def _read(data: bytes, codec: str) -> str | None:
    """Bytes read in a codec; as Windows does, bytes that it leaves out become control characters."""
    out = []
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        if codec not in ("cp1252", "cp1251"):
            return None
    for b in data:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _written(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=1)
def channels() -> dict[str, dict[str, tuple[str, ...]]]:
    """Of each channel: what it shows, in any letter case, and the letters that this may have been."""
    out: dict[str, dict[str, set[str]]] = {}

    def add(channel: str, seen: str | None, letter: str) -> None:
        if not seen or seen == letter or seen.isascii():
            return
        for form in {seen, seen.lower(), seen.upper(), seen.swapcase()}:
            if any(ord(c) > 126 and c not in GERMAN for c in form) and not (len(form) == 1 and form in SINGLE and form.swapcase() == letter):
                out.setdefault(channel, {}).setdefault(form, set()).add(letter)

    for reader in ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251"):
        for letter in WIDE:
            seen = _read(letter.encode(), reader)
            add(f"utf-8>{reader}", seen, letter)
            if reader in ("cp1252", "latin-1") and seen:
                add(f"utf-8>{reader} twice", _read(seen.encode(), reader), letter)
    for writer, readers in (("cp1252", ("cp850", "cp437", "mac_roman", "cp1251")), ("cp850", ("cp1252", "latin-1", "mac_roman")), ("mac_roman", ("cp1252", "latin-1", "cp850"))):
        for reader in readers:
            for letter in SINGLE:
                if data := _written(letter, writer):
                    add(f"{writer}>{reader}", _read(data, reader), letter)
    for reader in ("gbk", "big5", "shift_jis", "euc_kr"):
        for letter in GERMAN:
            for after in ["", *map(chr, range(65, 91)), *map(chr, range(97, 123))]:
                if (seen := _read((letter + after).encode("cp1252"), reader)) and len(seen) == 1 and ord(seen) > 0x3000:
                    add(f"cp1252>{reader}", seen, letter + after)
    for sign in ("�", "?"):
        for times in (1, 2):
            out.setdefault("lost", {})[sign * times] = set(SINGLE + "šŠ")
    return {channel: {seen: tuple(sorted(letters)) for seen, letters in table.items()} for channel, table in out.items()}


@lru_cache(maxsize=1)
def _finders() -> dict[str, regex.Pattern]:
    return {c: regex.compile("|".join(map(regex.escape, sorted(t, key=len, reverse=True)))) for c, t in channels().items()}


@lru_cache(maxsize=1)
def _many() -> regex.Pattern:
    """Sequences that only a misread multi-byte encoding leaves."""
    return regex.compile("|".join(sorted({regex.escape(s) for c, t in channels().items() if c.startswith("utf-8") for s in t if len(s) > 1}, key=len, reverse=True)))


def split_words(text: str | None) -> list[str]:
    """The words of a text, composed, without invisible signs; never cut inside a misread sequence."""
    if not text:
        return []
    text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    return [w for w in _BETWEEN.split(text) if w]


def _bare(word: str) -> str:
    return word if _many().search(word) else word.strip(_QUOTES)


def suspicious(word: str) -> bool:
    word = _bare(word)
    return any(ord(c) > 126 and c not in GERMAN for c in word) or ("?" in word and word.strip("?") != "")


def _is_letter(c: str) -> bool:
    """Letters with a case; modifiers such as a lone circumflex are signs."""
    return unicodedata.category(c) in ("Lu", "Ll", "Lt")


def fold(word: str) -> str:
    return _bare(word).casefold().replace("ss", "ß")


def symbols(word: str) -> str:
    """A word in the alphabet of the character model, with its borders."""
    return "^^" + "".join(c if c in _ALPHABET else "0" if c.isdigit() else "#" for c in word) + "$"


class CharacterModel:
    """Trigrams with back-off; its size is bounded by the alphabet."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.three = counts
        self.two: Counter[str] = Counter()
        self.pair: Counter[str] = Counter()
        self.one: Counter[str] = Counter()
        for g, n in counts.items():
            self.two[g[:2]] += n
            self.pair[g[1:]] += n
            self.one[g[2]] += n
        self.mid: Counter[str] = Counter()
        for g, n in self.pair.items():
            self.mid[g[0]] += n
        self.all = sum(counts.values()) or 1

    def step(self, before: str, c: str) -> float:
        p = (self.one[c] + 0.5) / (self.all + 25)
        p = (self.pair[before[1] + c] + 4 * p) / (self.mid[before[1]] + 4)
        return math.log((self.three.get(before + c, 0) + 4 * p) / (self.two[before] + 4))

    def score(self, word: str) -> float:
        s = symbols(word)
        return sum(self.step(s[i - 2 : i], s[i]) for i in range(2, len(s)))


def _as_is(word: str, model: CharacterModel) -> float:
    """Log probability of a word as it stands, without its frequency."""
    folded = fold(word)
    inner = folded.strip("?")
    cost = ADDED if inner != folded else 0.0
    for c in inner:
        if ord(c) > 126 and c not in _ALPHABET:
            cost += FOREIGN if _is_letter(c) else SIGN
        elif c == "?":
            cost += SIGN
    return cost + model.score("".join(c for c in inner if c in _ALPHABET or c.isdigit() or c.isascii()))


def paths(word: str, channel: str, model: CharacterModel) -> list[tuple[float, str]]:
    """The best readings of a word through one channel, by a list Viterbi search, as (log probability, reading)."""
    table = channels()[channel]
    edges: list[tuple[str, ...]] = []
    at, found = 0, False
    for m in _finders()[channel].finditer(word):
        edges += [(c,) for c in word[at : m.start()]]
        options = table[m[0]]
        first = m.start() == 0 or not word[m.start() - 1].isalpha()
        if channel == "lost":
            upper = first and len(word) > 1 and not word[-1].isupper() or word[:1].isupper() and word[1:2].isupper()
            options = tuple(o for o in options if o == "ß" or o.isupper() == upper) or options
        edges.append(options)
        at, found = m.end(), True
    if not found:
        return []
    edges += [(c,) for c in word[at:]]
    best: dict[str, list[tuple[float, str]]] = {"^^": [(0.0, "")]}
    for options in edges:
        after: dict[str, list[tuple[float, str]]] = {}
        for state, texts in best.items():
            for option in options:
                s, cost = state, 0.0
                for c in option.casefold().replace("ss", "ß"):
                    foreign = ord(c) > 126 and c not in _ALPHABET
                    if foreign:
                        cost += FOREIGN if len(options) == 1 else FOREIGN / 2
                    c = symbols(c)[2:-1]
                    cost += model.step(s, c)
                    s = s[1] + c
                after.setdefault(s, []).extend((score + cost, text + option) for score, text in texts)
        best = {s: sorted(t, reverse=True)[:PATHS] for s, t in after.items()}
    ended = [(score + model.step(s, "$"), text) for s, texts in best.items() for score, text in texts]
    return sorted(ended, reverse=True)[:PATHS]


def _candidates(counts: dict[str, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Readings of suspicious words; the word as it stands is the one without a channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = CharacterModel(counts)
        for pdf in batches:
            out = []
            for word in pdf.word:
                certain = bool(_CERTAIN.search(word) or _many().search(word) or _MIXED.search(_bare(word)))
                clean = word.replace("ï»¿", "").replace("Ï»¿", "").replace("﻿", "")
                stripped = _bare(word).strip("?")
                known = stripped if all(ord(c) <= 126 or c in GERMAN for c in stripped) and "?" not in stripped else None
                # The corpus' count of a word with foreign letters can't be trusted: copies repeat what is spoiled.
                added = ADDED if known is not None and known != _bare(word) else 0.0
                out.append((word, word, "", fold(known) if known else None, _as_is(word, model) + TELLING * certain, added + TELLING * certain))
                if certain:
                    out.append((word, word, "none of the channels", None, UNDONE + model.score("".join(c for c in fold(word) if c in _ALPHABET)), 0.0))
                # Foreign letters may be right, signs between letters hardly.
                letters = all(_is_letter(c) for c in word if ord(c) > 126 and c not in GERMAN) and "?" not in word
                seen = set()
                if clean != word:
                    out.append((word, clean, "byte order mark", fold(clean), SPOILED + model.score(fold(clean)), SPOILED))
                for channel in channels():
                    # Sequences of two and more signs hardly come together by chance.
                    sure = SURE if channel.startswith("utf-8") else 0.0
                    for score, text in paths(clean, channel, model):
                        if text not in seen:
                            seen.add(text)
                            left = sum(FOREIGN if _is_letter(c) else SIGN for c in text if ord(c) > 126 and c not in WIDE + "\xa0") + SIGN * ("?" in text.strip("?"))
                            out.append((word, text, channel, fold(text), SPOILED + sure + UNKNOWN * letters + score + left, SPOILED + sure + left))
            yield pd.DataFrame(out, columns=["word", "reading", "channel", "folded", "by_model", "prior"]).assign(own=lambda x: [fold(w) for w in x.word])

    return run


_CANDIDATE = "word string, reading string, channel string, folded string, by_model double, prior double, own string"


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter[str] = Counter()
        for word, n in zip(pdf.folded, pdf.n, strict=True):
            s = symbols(word)
            for i in range(2, len(s)):
                counts[s[i - 2 : i + 1]] += 1 + int(math.log(n))
        yield pd.DataFrame({"gram": list(counts), "n": list(counts.values())})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [split_words(x) for x in pdf.value]
        yield pdf.assign(
            words=[[w for w in ws if not suspicious(w)] for ws in words],
            odd=[[w for w in ws if suspicious(w)] for ws in words],
        )


def spoiled_values(values: DataFrame) -> DataFrame:
    """(value, restored, probability) of the spoiled ones among values (value, n): distinct texts with their number of rows.

    restored: the text with each spoiled word as it most likely was; a word that nothing explains stays as it is. probability: that
    of the word that is most likely spoiled, of all hypotheses the best one on each side; above a half a value is spoiled.
    Null and empty texts are never spoiled. Frequencies are those of all words of all values.
    """
    parts = cut_lineage(spread(values.filter(F.col("value").isNotNull())).mapInPandas(_cut, "value string, n long, words array<string>, odd array<string>"))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(folded=[fold(w) if plain or all(_is_letter(c) for c in _bare(w)) else "" for w, plain in zip(pdf.word, pdf.plain, strict=True)])[["folded", "plain", "n"]]

    # Words with foreign letters are known as well, but only as readings of others.
    words = parts.select(F.explode("words").alias("word"), F.lit(True).alias("plain"), "n").unionByName(parts.select(F.explode("odd").alias("word"), F.lit(False).alias("plain"), "n"))
    words = words.groupBy("word", "plain").agg(F.sum("n").alias("n"))
    lexicon = cut_lineage(words.mapInPandas(folded, "folded string, plain boolean, n long").filter("folded <> ''").groupBy("folded").agg(F.sum("n").alias("n"), F.max("plain").alias("plain")))
    total = lexicon.agg(F.sum("n")).first()[0] or 1
    # At most 34^3 rows: the alphabet, a digit, another sign and the borders.
    grams = {r.gram: r.n for r in lexicon.filter("plain").select("folded", "n").mapInPandas(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}

    odd = parts.select(F.explode("odd").alias("word")).distinct()
    readings = spread(odd).mapInPandas(_candidates(grams), _CANDIDATE)
    own = lexicon.select(F.col("folded").alias("own"), F.col("n").alias("n_own"))
    scored = readings.join(lexicon, "folded", "left").join(own, "own", "left")
    # A reading with foreign letters counts only if it is far more frequent than the word as it stands.
    counts = F.col("plain") | (F.col("n") > 3 * F.coalesce("n_own", F.lit(0)))
    scored = scored.withColumn("score", F.greatest("by_model", F.when(counts, F.col("prior") + F.log(F.col("n") / F.lit(float(total))))))
    # The best spoiled reading against the word as it stands: what is likelier, given all that each implies.
    as_is, spoiled = F.max(F.when(F.col("channel") == "", F.col("score"))), F.max(F.when(F.col("channel") != "", F.struct("score", "reading")))
    verdict = scored.groupBy("word").agg(as_is.alias("a"), spoiled.alias("o")).withColumn("probability", 1 / (1 + F.exp(F.col("a") - F.col("o.score"))))
    bad = cut_lineage(verdict.filter(F.col("probability") > 0.5).select("word", F.col("o.reading").alias("restored"), "probability"))

    hit = parts.filter(F.size("odd") > 0).select("value", F.explode(F.array_distinct("odd")).alias("word")).join(maybe_broadcast(bad, row_bytes=200), "word")
    grouped = hit.groupBy("value").agg(F.sort_array(F.collect_list(F.struct(F.length("word").alias("l"), "word", "restored")), asc=False).alias("fixes"), F.max("probability").alias("probability"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, fixes in zip(pdf.value, pdf.fixes, strict=True):
                text = _INVISIBLE.sub("", unicodedata.normalize("NFC", value))
                for fix in fixes:
                    text = text.replace(fix["word"], fix["restored"])
                out.append(text)
            yield pd.DataFrame({"value": pdf.value, "restored": out, "probability": pdf.probability})

    return grouped.mapInPandas(restore, "value string, restored string, probability double")


def spoiled_rows(columns: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(table_name, rec_id, restored, probability) of spoiled fields. columns: (table's name, table, its key, its text column).

    All columns share one set of word frequencies. Rows with repeated values each count.
    """
    fields = [df.select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("rec_id"), F.col(text).alias("value")) for name, df, key, text in columns]
    counted = [f.groupBy("value").agg(F.count(F.lit(1)).alias("n")) for f in fields]
    values, rows = counted[0], fields[0]
    for c, f in zip(counted[1:], fields[1:], strict=True):
        values, rows = values.unionByName(c), rows.unionByName(f)
    values = values.groupBy("value").agg(F.sum("n").alias("n"))
    bad = maybe_broadcast(cut_lineage(spoiled_values(values)), row_bytes=400)
    return rows.filter(F.col("value").rlike(SUSPICIOUS)).join(bad, "value").select("table_name", "rec_id", "restored", "probability")
