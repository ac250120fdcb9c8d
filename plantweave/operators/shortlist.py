"""The k plants most like each name by the weighted similarity, over all plants that pass the fuel and size filters.

No word or letter has to be shared. Queries and name variants meet in blocks, every pair of blocks once; in a block
a bound from the letters that two names have in common leaves out variants that can't be among the k best, and the
others get their exact score from bit-parallel subsequences of many names at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FUELS_OF_ENERGY, core_name
from ..session import cut_lineage
from .lookup import top_k
from .similarity import weighted

#: Variants of a block, rows whose windows are searched at once, and the longest query whose letters fit an integer's bits.
BLOCK, WINDOW_ROWS, BITS = 262_144, 1_024, 63
#: Letters between two places up to which those of a name are counted, and such places.
CUT, CUTS = 6, 8
#: Names whose bits are searched at once, and names of which windows are searched without counting letters first.
TOGETHER, FEW = 8_192, 1_000
#: The first score from which plants are looked for, by how much the next one is less, and names from which it isn't less by twice as much.
LEVEL, STEP, MANY = 80.0, 7.0, 2_000
_ONE = np.uint64(1)
#: Bytes with their bits in the other order.
_TURNED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], "uint8")
_LOW = np.array([(1 << i) - 1 for i in range(64)], "uint64")


def _codes(texts: list[str], points: np.ndarray) -> np.ndarray:
    """Codes of the letters, a row a place and a column a text; 0 beyond its end."""
    longest = max(map(len, texts), default=0)
    letters = np.array(texts, dtype=f"U{max(longest, 1)}").view("uint32").reshape(len(texts), -1).T[:longest]
    return np.where(letters > 0, np.searchsorted(points, letters) + 1, 0).astype("uint8" if len(points) < 255 else "uint16")


def _places(codes: np.ndarray, letters: int) -> np.ndarray:
    """For each letter and text the bits of the letter's places, a bit a place from the first on."""
    out = np.zeros((letters + 1, codes.shape[1]), "uint64")
    every = np.arange(codes.shape[1])
    for i, line in enumerate(codes[:BITS]):
        out[line, every] |= _ONE << np.uint64(i)
    return out


def _common(masks: np.ndarray, n: int, codes: np.ndarray) -> np.ndarray:
    """similarity.common() of one text of n letters and many."""
    row = np.full(codes.shape[1], _LOW[n])
    for line in codes:
        hit = masks[line] & row
        row = (row + hit) | (row - hit)
    return n - np.bitwise_count(row & _LOW[n]).astype("int64")


def _windows(masks: np.ndarray, n: int, codes: np.ndarray, size: np.ndarray, cut_off: bool = False) -> np.ndarray:
    """similarity.best_window() of one text of n letters and many, which are all longer or all shorter, by default without the windows that are cut off at an end."""
    best = np.zeros(len(size))
    for a in range(0, len(size), WINDOW_ROWS):
        l = size[a : a + WINDOW_ROWS]  # noqa: E741
        longest = int(l.max())
        part = codes[:longest, a : a + WINDOW_ROWS]
        if l[0] > n:
            ends = np.arange(1, longest + n)[:, None] if cut_off else np.arange(n, longest + 1)[:, None]
            valid = np.minimum(ends, l) - np.maximum(ends - n, 0) if cut_off else np.where(ends <= l, n, 0)
            if cut_off:
                part = np.pad(part, ((n - 1, n - 1), (0, 0)))  # nothing is in common with what isn't there
            hits = masks[part]
            row = np.full(valid.shape, _LOW[n])
            for i in range(n):
                hit = hits[i : i + len(ends)] & row
                row = (row + hit) | (row - hit)
            c = n - np.bitwise_count(row & _LOW[n]).astype("int64")
            score = 200.0 * c / (n + np.maximum(valid, 0))
        else:
            ends = np.arange(1, n + longest)[:, None] if cut_off else np.arange(max(int(l.min()), 1), n + 1)[:, None]
            low, high = np.maximum(ends - l, 0), np.minimum(ends, n)
            valid, inside = high - low, _LOW[high] ^ _LOW[np.minimum(low, high)]
            row = np.full(valid.shape, _LOW[n])
            for line in part:
                hit = masks[line] & inside & row
                row = (row + hit) | (row - hit)
            c = valid - np.bitwise_count(row & inside).astype("int64")
            score = 200.0 * c / (l + np.maximum(valid, 0))
        best[a : a + WINDOW_ROWS] = np.where(valid > 0, score, 0.0).max(0)
    return best


def _cuts(codes: np.ndarray, letters: int) -> np.ndarray:
    """For each letter and text how often it comes up in the first CUT, 2 CUT, ... letters, a byte each from the lowest on."""
    out = np.zeros((letters + 1, codes.shape[1], CUTS), "uint8")
    every = np.arange(codes.shape[1])
    for i, line in enumerate(codes[: CUT * CUTS]):
        out[line, every, i // CUT] += 1
    for t in range(1, CUTS):
        out[:, :, t] += out[:, :, t - 1]
    return out.view("<u8")[:, :, 0]


class Names:
    """Distinct name variants, prepared for many queries."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        letters = sorted({" ", *"".join(texts)})
        self.alphabet, points = {c: i for i, c in enumerate(letters, 1)}, np.array([ord(c) for c in letters], "uint32")
        words = [t.split() for t in texts]
        sets = [sorted(set(w)) for w in words]
        self.plain, self.sorted = _codes(texts, points), _codes([" ".join(sorted(w)) for w in words], points)
        self.spaced = _codes(["".join(f" {w}" for w in s) for s in sets], points)
        self.size = np.array([len(t) for t in texts], "int64")
        self.set_size = np.array([sum(map(len, s)) + len(s) - 1 for s in sets], "int64")
        self.n_words = np.array([len(s) for s in sets], "uint8")
        self.repeats = np.array([len(s) < len(w) for s, w in zip(sets, words, strict=True)])
        self.as_sorted = np.array([w == sorted(w) for w in words])
        self.repeating = np.flatnonzero(self.repeats)
        ids: dict[str, int] = {}
        self.having: dict[str, list[int]] = {}
        self.word_at = np.zeros(self.spaced.shape, "int32")
        for i, s in enumerate(sets):
            at = 0
            for w in s:
                self.having.setdefault(w, []).append(i)
                self.word_at[at : at + len(w) + 1, i] = ids.setdefault(w, len(ids) + 1)
                at += len(w) + 1
        self.ids = ids
        self.having = {w: np.array(rows) for w, rows in self.having.items()}
        self.longest = max(len(self.plain), 1)
        kind = "uint8" if self.longest < 256 else "uint16"
        self.counts = np.zeros((len(self.alphabet) + 1, len(texts)), kind)
        for line in self.plain:
            self.counts[line, np.arange(len(texts))] += 1
        self.at_most: dict[tuple[str, int], np.ndarray] = {}
        self.limits: dict[int, np.ndarray] = {}
        self.spreads: dict[int, np.ndarray] = {}
        self.needed: dict[tuple[int, float], list[int]] = {}
        cuts = [0, *(np.flatnonzero(np.diff(self.size)) + 1).tolist(), len(texts)]
        #: (first, end, letters) of names in a row that have as many letters: few if the names come by length.
        self.runs = [(a, b, int(self.size[a])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        self.small = self.size.astype("uint32")
        self.pattern = np.zeros(len(texts), "uint64")
        self.touched = np.zeros(0, "int64")
        self.score, self.rated = np.full(len(texts), np.nan), []
        self.low = _LOW[np.minimum(self.size, BITS)]
        self.low_short = self.low.astype("uint32")
        #: The bits of the places of each form in two halves.
        self.places = [(p.astype("uint32"), (p >> np.uint64(32)).astype("uint32")) for p in (_places(c, len(self.alphabet)) for c in (self.plain, self.sorted))]
        self.cuts = [_cuts(c, len(self.alphabet)) for c in (self.plain, self.sorted)]
        self.best_of: dict[int, np.ndarray] = {}
        self.window = np.full(len(texts), np.nan, "float32")
        self.windowed: list[np.ndarray] = []
        self.in_common = [np.full(len(texts), -1, "int16") for _ in self.places]  # letters, of each form
        self.compared: list[list[np.ndarray]] = [[] for _ in self.places]

    def best_of_longer(self, n: int) -> np.ndarray:
        """For sizes of longer names, stretches of letters and letters that a text of n letters has in common with one, the best ratio of a window in it.

        Stretch t ends with letter CUT (t + 1) and is long enough for any window that ends in its last CUT letters.
        """
        if n not in self.best_of:
            out, found = np.zeros((CUT * CUTS + 1, CUTS, CUT * CUTS + 1), "float32"), np.arange(CUT * CUTS + 1)
            stretch = -(-(n + CUT - 1) // CUT)
            ratios = [200.0 * np.minimum(found, l) / (n + l) for l in range(n + 1)]  # of windows of l letters
            for m in range(n + 1, len(out)):
                out[m, -(-n // CUT) - 1 : -(-m // CUT)] = ratios[n]
                for l in range(1, n):  # noqa: E741
                    for t in (-(-l // CUT) - 1, min(CUTS, (m - l) // CUT + stretch) - 1):
                        np.maximum(out[m, t], ratios[l], out[m, t])
            self.best_of[n] = out
        return self.best_of[n]

    def longer_windows(self, form: int, text: str, rows: np.ndarray) -> np.ndarray:
        """No window of the longer names at rows, of at most CUT * CUTS letters, has a better ratio, by the letters in common."""
        found, shift = np.zeros(CUTS * len(rows), "uint8"), np.uint64(8 * min(-(-(len(text) + CUT - 1) // CUT), CUTS))
        counts, before = np.empty(len(rows), "uint64"), np.zeros(len(rows), "uint64")
        for c in set(text):
            if c in self.alphabet:
                np.take(self.cuts[form][self.alphabet[c]], rows, out=counts)
                if shift < 64:
                    np.left_shift(counts, shift, before)
                    np.subtract(counts, before, counts)
                in_bytes = counts.view("uint8")
                np.minimum(in_bytes, np.uint8(text.count(c)), in_bytes)
                np.add(found, in_bytes, found)
        table = self.best_of_longer(len(text))
        found, at, best = found.reshape(-1, CUTS), self.size[rows] * (table.shape[1] * table.shape[2]), np.zeros(len(rows), "float32")
        for t in range(CUTS):
            np.maximum(best, table.reshape(-1).take(at + found[:, t] + t * table.shape[2]), best)
        return best

    def shorter_windows(self, text: str, rows: np.ndarray) -> np.ndarray:
        """No window of the text, which is longer than the names at rows, has a better ratio, by the letters in common."""
        best, size, n, step = np.zeros(len(rows), "float32"), self.size[rows], len(text), 5
        for low in range(int(size.min()), int(size.max()) + 1, 4):
            at = np.flatnonzero((size >= low) & (size < low + 4))
            if not len(at):
                continue
            most, own, found_most = low + 3, np.arange(low, low + 4)[:, None], np.arange(n + 1)
            first = ((size[at] - low) * (n + 1)).astype("int32")
            group = np.zeros(len(at), "float32")
            parts = {text[a : a + most + step - 1]: most for a in range(0, n - low + 1, step)}  # the fewest letters of windows in a stretch
            for l in range(1, most, step):  # noqa: E741
                for part in (text[: l + step - 1], text[max(n - l - step + 1, 0) :]):
                    parts[part] = min(parts.get(part, l), l)
            counts = {c: self.counts[self.alphabet[c]].take(rows[at]) for c in set(text) if c in self.alphabet}
            for part, least in parts.items():
                found = np.zeros(len(at), self.counts.dtype)
                for c in set(part):
                    if c in counts:
                        found += np.minimum(counts[c], self.counts.dtype.type(part.count(c)))
                # A window has as many letters as it has in common at least.
                table = (200.0 * found_most / (own + np.minimum(np.maximum(found_most, least), own))).astype("float32")
                np.maximum(group, table.reshape(-1).take(first + found), group)
            best[at] = group
        return best

    def letters_in(self, text: str) -> np.ndarray:
        """How many letters each name has in common with the text, in any order."""
        out = np.zeros(len(self.texts), self.counts.dtype)
        for c in set(text):
            if c in self.alphabet:
                key = c, min(text.count(c), self.longest)
                if key not in self.at_most:
                    self.at_most[key] = np.minimum(self.counts[self.alphabet[c]], self.counts.dtype.type(key[1]))
                out += self.at_most[key]
        return out

    def bits(self, form: int, c: str, rows: np.ndarray, short: bool) -> np.ndarray:
        """The bits of a letter's places in the names at rows. short: none has more than 32 letters."""
        low, high = (half[self.alphabet[c]] for half in self.places[form])
        return low.take(rows) if short else low.take(rows).astype("uint64") | high.take(rows).astype("uint64") << np.uint64(32)

    def steps(self, form: int, text: str, rows: np.ndarray, back: bool = False, short: bool = False) -> Iterator[np.ndarray]:
        """After each letter of the text the bits of the names' places, unset where the longest common subsequence grows. back: places count from a name's end."""
        row = np.full(len(rows), 0, "uint32" if short else "uint64")
        np.invert(row, row)
        found = {c: self.bits(form, c, rows, short) for c in set(text) if c in self.alphabet}
        if back:
            beyond = (64 - np.minimum(self.size[rows], 64)).astype("uint64")
            found = {c: _TURNED.take(bits.byteswap().view("uint8")).view("uint64") >> beyond for c, bits in found.items()}
        hit, rest = np.empty_like(row), np.empty_like(row)
        for c in text:
            if c in found:
                np.bitwise_and(found[c], row, hit)
                np.subtract(row, hit, rest)
                np.add(row, hit, row)
                np.bitwise_or(row, rest, row)
            yield row

    def common(self, form: int, text: str, rows: np.ndarray) -> np.ndarray:
        """similarity.common() of the text and the names at rows."""
        out, size = np.empty(len(rows), "int64"), self.size[rows]
        short = size <= (32 if len(rows) > FEW or size.max(initial=0) <= 32 else 0)
        for is_short, low in ((True, self.low_short), (False, self.low)):
            some = np.flatnonzero(short == is_short)
            for a in range(0, len(some), TOGETHER):
                part = some[a : a + TOGETHER]
                for row in self.steps(form, text, rows[part], short=is_short):  # noqa: B007
                    pass
                out[part] = size[part] - np.bitwise_count(row & low[rows[part]])
        return out

    def ends(self, form: int, text: str, rows: np.ndarray, least: float = 0.0) -> np.ndarray:
        """The best ratio of the shorter side with a beginning or end of the longer that has fewer letters; names at rows are all longer or all shorter.

        Ratios below least may come out as less.
        """
        size, n, best = self.size[rows], len(text), np.zeros(len(rows))
        longer = size[0] > n
        short = np.full(len(rows), n) if longer else size
        reach = least / (200.0 - least) - 1e-9  # fewer letters than that of the shorter side can't reach least
        low = self.low[rows]
        start, stop = int(short.min() * reach), int(size.max())
        for back in (False, True):
            for j, row in enumerate(self.steps(form, text[::-1] if back else text, rows, back), 1):
                if not longer:
                    if j >= stop:
                        break
                    if j >= start:
                        c = size - np.bitwise_count(row & low)
                        best = np.maximum(best, np.where(j < size, 200.0 * c / (size + j), 0.0))
            if longer:
                most = n - 1 - np.bitwise_count(row & _LOW[n - 1]).astype("int64")
                some = np.flatnonzero(200.0 * most >= (n + most) * (least - 1e-9))
                if len(some):
                    row, part = row[some], best[some]
                    for w in range(max(start, 1), n):
                        part = np.maximum(part, 200.0 * (w - np.bitwise_count(row & _LOW[w]).astype("int64")) / (n + w))
                    best[some] = part
        return best

    def masks(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.alphabet) + 1, "uint64")
        for i, c in enumerate(text):
            if c in self.alphabet:
                out[self.alphabet[c]] |= _ONE << np.uint64(i)
        return out


class Query:
    """One name against all variants: bounds of their scores, and exact scores where they are asked for."""

    def __init__(self, text: str, names: Names) -> None:
        self.text, self.names, self.n = text, names, len(text)
        self.words = sorted(set(text.split()))
        self.set_size = sum(map(len, self.words)) + len(self.words) - 1
        self.repeats = len(self.words) < len(text.split())
        # Only one query at a time uses these tables; the next one clears what this one set.
        self.pattern, self.score = names.pattern, names.score
        self.pattern[names.touched] = 0
        having = [(np.uint64(1 << k), names.having[w]) for k, w in enumerate(self.words) if w in names.having]
        for bit, rows in having[:1]:
            self.pattern[rows] = bit
        for bit, rows in having[1:]:
            self.pattern[rows] |= bit
        names.touched = np.zeros(0, "int64") if not having else having[0][1] if len(having) == 1 else np.flatnonzero(self.pattern)
        sharing = names.touched
        self.forget()
        for rows in names.windowed:
            names.window[rows] = np.nan
        names.windowed.clear()
        for known, compared in zip(names.in_common, names.compared, strict=True):
            for rows in compared:
                known[rows] = -1
            compared.clear()
        self.letters = names.letters_in(text)
        if self.n not in names.limits:
            names.limits[self.n] = self._limits()
            near, discount = self._spread(np.arange(names.longest + 1))
            names.spreads[self.n] = np.where(near, 0, np.where(discount == 0.9, 1, 2)).astype("uint8")
        spread = names.spreads[self.n].take(names.small.take(sharing))
        self.near_sharing = sharing[spread == 0]
        #: Names whose score is at least that much, as they share words.
        self.sure = {95.0: self.near_sharing[self._within(self.near_sharing)], 85.5: sharing[spread == 1], 57.0: sharing[spread == 2]}

    @property
    def bound(self) -> np.ndarray:
        """No score of a name is above its bound."""
        return self.bound_of(np.arange(len(self.names.texts)))

    def bound_of(self, rows: np.ndarray) -> np.ndarray:
        names = self.names
        out = names.limits[self.n].take(self.letters[rows].astype("uint32") * np.uint32(names.longest + 1) + names.small[rows])
        own = (self.pattern[rows] > 0) | names.repeats[rows] | self.repeats
        if (at := np.flatnonzero(own)).size:
            r = rows[at]
            out[at] = self._bound(self.letters[r].astype("int64"), names.size[r], names.set_size[r], self._shares(r), self.pattern[r] > 0)
        return out

    def reaching(self, least: float, fitting: np.ndarray) -> np.ndarray:
        """The fitting names whose bound is least or more, without those that share words and are of unlike length, unless more than their words can tell."""
        names = self.names
        if self.repeats:
            rows = np.flatnonzero(fitting)
            return rows[self.bound_of(rows) >= least]
        if (self.n, least) not in names.needed:
            if len(names.needed) > 50_000:
                names.needed.clear()
            table = names.limits[self.n].reshape(-1, names.longest + 1) >= least
            names.needed[self.n, least] = np.where(table.any(0), table.argmax(0), np.iinfo("int64").max).tolist()
        need, out = names.needed[self.n, least], np.zeros(len(names.texts), bool)
        most = np.iinfo(self.letters.dtype).max
        for a, b, size in names.runs:
            if need[size] <= most:
                np.greater_equal(self.letters[a:b], need[size], out=out[a:b])
        if len(own := self.near_sharing):
            out[own] |= 0.95 * self._shares(own) + 1e-9 >= least  # the letters are counted already
        if len(own := names.repeating):
            out[own] = self.bound_of(own) >= least
        return np.flatnonzero(np.logical_and(out, fitting, out))

    def _spread(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether names of so many letters are of like length, and the discount if they aren't."""
        spread = np.maximum(self.n, size) / np.maximum(np.minimum(self.n, size), 1)
        return spread < 1.5, np.where(spread <= 8, 0.9, 0.6)

    def _within(self, rows: np.ndarray) -> np.ndarray:
        n = np.bitwise_count(self.pattern[rows])
        return (n > 0) & ((n == len(self.words)) | (n == self.names.n_words[rows]))

    def _shared(self, rows: np.ndarray) -> np.ndarray:
        """Letters of the shared words with a space between two."""
        pattern = self.pattern[rows]
        few = len(self.words) <= 8  # a table of all patterns
        every, pattern = (pattern.astype("int64"), np.arange(1 << len(self.words), dtype="uint64")) if few else (None, pattern)
        out = np.maximum(np.bitwise_count(pattern).astype("int64") - 1, 0)
        for k, w in enumerate(self.words):
            if w in self.names.having:
                out += np.where(pattern & np.uint64(1 << k), len(w), 0)
        return out.take(every) if few else out

    def _limits(self) -> np.ndarray:
        """_bound() of names without shared or repeated words, by letters in common and size."""
        width = self.names.longest + 1
        common, size = np.divmod(np.arange((max(self.n, self.names.longest) + 1) * width), width)
        return self._bound(common, np.maximum(size, 1), size, np.zeros(len(size)), False, self.n)

    def _shares(self, rows: np.ndarray) -> np.ndarray:
        """The best ratio of the shared words with either side."""
        s, other = self._shared(rows), np.minimum(self.names.set_size[rows], self.set_size)
        return np.where(self._within(rows), 100.0, np.where(s > 0, 200.0 * s / np.maximum(s + other, 1), 0.0))

    def _bound(self, common: np.ndarray, size: np.ndarray, set_size: np.ndarray, shares: np.ndarray, sharing: np.ndarray | bool, own: int | None = None) -> np.ndarray:
        """No score is above it. common: at least the letters that any two forms of the names have in common."""
        near, discount = self._spread(size)
        whole = 200.0 * common / (self.n + size)
        like = 0.95 * np.maximum(np.minimum(200.0 * common / np.maximum((own or self.set_size) + set_size, 1), 100.0), shares)
        part = 200.0 * common / np.maximum(np.minimum(self.n, size) + common, 1)
        unlike = np.maximum(discount * part, 0.95 * discount * np.where(sharing, 100.0, part))
        return np.maximum(whole, np.where(near, like, unlike)) + 1e-9

    def by_windows(self, rows: np.ndarray, least: float) -> np.ndarray:
        """Of the names at rows those that can reach least, besides what shared words tell of names of unlike length, by the letters of windows."""
        names = self.names
        if least <= 0 or len(rows) < FEW or not 0 < self.n <= CUT * CUTS:
            return rows
        size = names.size[rows]
        near, discount = self._spread(size)
        longer = size > self.n
        keep = near | (longer & (size > CUT * CUTS)) | (~longer & (np.count_nonzero(~longer & ~near) < 4 * FEW)) | (200.0 * self.letters[rows] / (self.n + size) + 1e-9 >= least)
        left = np.flatnonzero(~keep)
        rest = rows[left]
        if len(new := np.flatnonzero(np.isnan(names.window[rest]))):
            part, factor = rest[new], discount[left[new]]
            names.windowed.append(part)
            ordered = " ".join(sorted(self.text.split()))
            longer, best = longer[left[new]], np.zeros(len(new), "float32")
            if len(at := np.flatnonzero(longer)):
                best[at] = names.longer_windows(0, self.text, part[at])
            if len(at := np.flatnonzero(longer & (self.pattern[part] == 0) & ~(names.as_sorted[part] & (ordered == self.text)))):
                best[at] = np.maximum(best[at], 0.95 * names.longer_windows(1, ordered, part[at]))
            if len(at := np.flatnonzero(~longer)):
                best[at] = names.shorter_windows(self.text, part[at])
                if ordered != self.text:
                    best[at] = np.maximum(best[at], 0.95 * names.shorter_windows(ordered, part[at]))
            names.window[part] = factor * best + 1e-3
        keep[left] = names.window[rest] >= least
        return rows[keep]

    def forget(self) -> None:
        """Leaves all names without a score."""
        for rows in self.names.rated:
            self.score[rows] = np.nan
        self.names.rated.clear()

    def _in_common(self, form: int, text: str, rows: np.ndarray) -> np.ndarray:
        """Names.common(), of each name once."""
        known = self.names.in_common[form]
        out = known[rows].astype("int64")
        if len(new := np.flatnonzero(out < 0)):
            out[new] = self.names.common(form, text, rows[new])
            known[rows[new]] = out[new]
            self.names.compared[form].append(rows[new])
        return out

    def rate(self, rows: np.ndarray, least: float) -> None:
        """Sets the scores of rows; those below least may get less than they have, and keep that until forget()."""
        names = self.names
        rows = rows[np.isnan(self.score[rows])]
        bound = self.bound_of(rows)
        rows, bound = rows[bound >= least], bound[bound >= least]
        names.rated.append(rows)
        alone = rows if not 0 < self.n <= BITS else rows[names.size[rows] > BITS]
        if len(alone):
            self.score[alone] = [weighted(self.text, names.texts[i]) for i in alone]
            rows, bound = rows[np.isnan(self.score[rows])], bound[np.isnan(self.score[rows])]
        near, discount = self._spread(names.size[rows])
        by_words = 0.95 * discount * 100.0
        told = ~near & (self.pattern[rows] > 0) & (bound <= by_words + 2e-9)  # nothing else can be more
        self.score[rows[told]] = by_words[told]
        rows, near, discount = rows[~told], near[~told], discount[~told]
        if not len(rows):
            return
        size = names.size[rows]
        ordered = " ".join(sorted(self.text.split()))
        common = self._in_common(0, self.text, rows)
        whole = 200.0 * common / (self.n + size)
        shares = self.pattern[rows] > 0
        same = names.as_sorted[rows] & (ordered == self.text)
        in_order = np.where(same, common, 0)
        most = self.letters[rows].astype("int64")  # in any order
        most = 0.95 * 200.0 * most * np.where(near, 1.0 / (self.n + size), discount / np.maximum(np.minimum(self.n, size) + most, 1)) + 1e-9
        if (asked := np.flatnonzero((near | ~shares) & ~same & (most >= least) & (most > whole))).size:
            in_order[asked] = self._in_common(1, ordered, rows[asked])
        # Cut off at an end, a window has as many letters as it has in common at least.
        short = np.minimum(self.n, size)
        sets = near & (shares | names.repeats[rows] | self.repeats)
        more = np.maximum(np.where(near, 0.0, 200.0 * common / np.maximum(short + common, 1)), 0.95 * np.where(near | shares, 0.0, 200.0 * in_order / np.maximum(short + in_order, 1)))
        left = np.flatnonzero(sets | (whole >= least) | (discount * more + 1e-9 >= least) | (near & (0.95 * 200.0 * in_order / (self.n + size) + 1e-9 >= least)) | ~near & shares)
        self.score[rows] = whole
        rows, size, short, near, discount, common, whole, shares, same, in_order, sets = (x[left] for x in (rows, size, short, near, discount, common, whole, shares, same, in_order, sets))
        if not len(rows):
            return
        words = np.where(near, 200.0 * in_order / (self.n + size), 0.0)
        words[sets] = np.maximum(words[sets], self._word_sets(rows[sets]))
        out = np.maximum(whole, 0.95 * words)

        out = np.where(near | ~shares, out, np.maximum(out, 0.95 * discount * 100.0))
        for form, text, codes, found, factor, asked in ((0, self.text, names.plain, common, discount, ~near), (1, ordered, names.sorted, in_order, 0.95 * discount, ~near & ~shares & ~same)):
            # Cut off at an end, a window has as many letters as it has in common at least; else as many as the shorter side.
            for longer in (True, False):
                side = asked & (size != self.n) & ((size > self.n) == longer)
                limit = factor * np.maximum(200.0 * found / np.maximum(short + found, 1), 100.0 * found / np.maximum(short, 1)) + 1e-9
                if 0 < len(some := np.flatnonzero(side & (limit >= least) & (limit > out))) <= TOGETHER // 64:
                    out[some] = np.maximum(out[some], factor[some] * _windows(names.masks(text), self.n, codes[: size[some].max(), rows[some]], size[some], True))
                    continue
                limit = factor * 200.0 * found / np.maximum(short + found, 1) + 1e-9
                if (some := np.flatnonzero(side & (limit >= least) & (limit > out))).size:
                    out[some] = np.maximum(out[some], factor[some] * names.ends(form, text, rows[some], max(0.0, least / factor[some].max())))
                limit = factor * 100.0 * found / np.maximum(short, 1) + 1e-9
                if (some := np.flatnonzero(side & (limit >= least) & (limit > out))).size:
                    out[some] = np.maximum(out[some], factor[some] * _windows(names.masks(text), self.n, codes[: size[some].max(), rows[some]], size[some]))
        self.score[rows] = out

    def _word_sets(self, rows: np.ndarray) -> np.ndarray:
        """similarity.word_set(): shared words come first on both sides, so that only the rests are compared."""
        out = self._shares(rows)
        left = ~self._within(rows)
        for p in np.unique(self.pattern[rows][left]):
            p = int(p)
            at = np.flatnonzero(left & (self.pattern[rows] == p))
            part = rows[at]
            rest = "".join(f" {w}" for k, w in enumerate(self.words) if not p >> k & 1)
            gone = [self.names.ids[w] for k, w in enumerate(self.words) if p >> k & 1]
            codes = self.names.spaced[: self.names.set_size[part].max() + 1, part]
            if gone:
                codes = np.where(np.isin(self.names.word_at[: len(codes), part], gone), 0, codes)
            c = _common(self.names.masks(rest), len(rest), codes)
            out[at] = np.maximum(out[at], 200.0 * (self._shared(part) - (p == 0) + c) / (self.set_size + self.names.set_size[part]))
        return out


def _block_best(k: int):
    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[str, str, float]] = []
        if len(asked) and len(known):
            known = known.sort_values(["id", "v"], ignore_index=True)
            of, texts = pd.factorize(known.v.map(lambda t: " ".join(t.split())))
            order = np.argsort([len(t) for t in texts], kind="stable")
            names, room = Names([texts[i] for i in order]), known.room.to_numpy()
            plants = Plants(np.argsort(order)[of], pd.factorize(known.id)[0], known.id.to_numpy())  # numbers in the order of the ids
            fuels = {e: known.fueltype.isin(f).to_numpy() for e, f in FUELS_OF_ENERGY.items()}
            every = {None: np.ones(len(room), bool)} | fuels
            roomiest = {e: np.fmax.reduceat(np.where(some, room, np.nan)[plants.by_name], plants.start[:-1]) for e, some in every.items()}
            for text, group in asked.groupby("q", sort=False):
                query = Query(" ".join(text.split()), names)
                best: dict[tuple, list[tuple[str, float]]] = {}
                for entry, energy, least_mw in zip(group.entry, group.energy, group.least_mw, strict=True):
                    if (energy, least_mw) not in best:
                        fits = room >= least_mw
                        best[energy, least_mw] = plants.best(query, fits & fuels[energy] if energy in fuels else fits, roomiest[energy if energy in fuels else None] >= least_mw, k)
                    found += [(entry, i, s) for i, s in best[energy, least_mw]]
        return pd.DataFrame(found, columns=["entry", "id", "score"])

    return run


class Plants:
    """The plants' rows in the order of the ids: of, the place of a row's name among the names; number, that of its id; ids."""

    def __init__(self, of: np.ndarray, number: np.ndarray, ids: np.ndarray) -> None:
        self.number, self.ids, self.of = number, ids, of
        self.by_name = np.argsort(of, kind="stable")
        self.start = np.searchsorted(of[self.by_name], np.arange(of.max(initial=-1) + 2))
        self.first = np.zeros(number.max(initial=-1) + 1, "int64")  # a row of each number
        self.first[number[::-1]] = np.arange(len(number))[::-1]

    def rows(self, names: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """The rows of names that fit."""
        start, n = self.start[names], self.start[names + 1] - self.start[names]
        rows = self.by_name[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return rows[fits[rows]]

    def smallest(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The k smallest numbers of rows."""
        number = self.number[rows]
        if len(number) > 16 * k and len(some := np.unique(np.partition(number, 8 * k)[: 8 * k])) >= k:
            return some[:k]
        return np.unique(number)[:k]

    def ranked(self, query: Query, names: np.ndarray, fits: np.ndarray, told: list[tuple[np.ndarray, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the k best of the rows that fit of rated names and what is told of numbers, ties by number."""
        rated = query.score[names]
        names, rated = names[rated >= 0], rated[rated >= 0]
        for most in (8 * k, len(names)):
            floor = np.partition(rated, len(rated) - most)[len(rated) - most] if most < len(rated) else -1.0
            rows = self.rows(names[rated >= floor], fits)
            number = np.concatenate([self.number[rows], *[n for n, _ in told]])
            score = np.concatenate([query.score[self.of[rows]], *[np.full(len(n), s) for n, s in told]])
            order = np.lexsort((number, -score))
            first = order[np.sort(np.unique(number[order], return_index=True)[1])[:k]]
            if len(first) == k and score[first[-1]] >= floor:
                break
        return number[first], score[first]

    def best(self, query: Query, fits: np.ndarray, fitting: np.ndarray, k: int) -> list[tuple[str, float]]:
        """(id, score) of the k best plants among the rows that fit, ties by id. fitting: whether any row of a name fits."""
        query.forget()  # scores below another least
        least, seen, told = -1.0, np.zeros(0, "int64"), []
        for (score, names), by_words in zip(query.sure.items(), (None, 0.95 * 0.9 * 100.0, 0.95 * 0.6 * 100.0), strict=True):
            if len(names):
                some = self.smallest(self.rows(names, fits), k)
                if by_words:  # rated only if anything else can be more
                    told.append((some, by_words))
                seen = np.union1d(seen, some)
                if len(seen) >= k:
                    least = score
                    break
        level = max(least, LEVEL)
        while True:  # a level that k plants reach is looked for from above, as few names reach a high one
            some = query.by_windows(query.reaching(level, fitting), level)
            query.rate(some, level)
            number, score = self.ranked(query, some, fits, told, k)
            if len(number) == k:
                least = max(least, score[-1])
            if least >= level:
                break
            level = max(level - (STEP if len(some) > MANY else 2 * STEP), least) if level > 2 * STEP else least
            query.forget()
        return [(self.ids[self.first[n]], float(s)) for n, s in zip(number, score, strict=True)]


def _best(query: Query, rows: np.ndarray, of: np.ndarray, number: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[str, float]]:
    """Plants.best() of the rows."""
    fits = np.zeros(len(of), bool)
    fits[rows] = True
    fitting = np.zeros(len(query.names.texts), bool)
    fitting[of[rows]] = True
    return Plants(of, number, ids).best(query, fits, fitting, k)


def meet(asked: DataFrame, name: str, known: DataFrame, variant: str, blocks: int):  # noqa: ANN201
    """asked and known cogrouped: equal names meet each block of the variants in one partition."""
    spark = asked.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    n = parts * blocks
    # Keys that a hash sends to one partition each: one row a partition comes to the driver.
    keys = {r[0]: r[1] for r in spark.range(40 * n).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id")).collect()}
    key = F.array(*[F.lit(keys.get(p, p)).cast("long") for p in range(n)])
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda: F.get(key, F.col("_part") * blocks + F.col("_block")).alias("_key")
    mine = asked.withColumn("_part", F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")).withColumn("_block", every(blocks)).select(place(), *asked.columns)
    theirs = known.withColumn("_block", F.pmod(F.xxhash64(variant), F.lit(blocks)).cast("int")).withColumn("_part", every(parts)).select(place(), *known.columns)
    return mine.repartition(n, "_key").groupBy("_key").cogroup(theirs.repartition(n, "_key").groupBy("_key"))


def most_similar(queries: DataFrame, plants: DataFrame, k: int, least: int = 4, block: int = BLOCK) -> DataFrame:
    """(entry, id, score, rank): the k plants of the most similar names for each entry; ties by id.

    queries: entry (distinct), q (its core name), energy, mw. plants: id, match_names, fueltype, capacity. Every variant
    of least letters of every plant that fits in fuel and size is considered; a plant has its best variant's score.
    The work grows with the product of both tables.
    """
    size = F.nanvl(F.coalesce("capacity", F.lit(0.0)), F.lit(0.0))
    room = F.when(size == 0, float("inf")).otherwise(size)
    variants = plants.select("id", "fueltype", room.alias("room"), F.explode(F.split("match_names", r" \| ")).alias("_v")).withColumn("v", core_name(F.col("_v")))
    known = cut_lineage(variants.filter(F.length("v") >= least).select("id", "fueltype", "room", "v").distinct())
    floor = F.coalesce(F.nanvl(F.col("mw").cast("double"), F.lit(None).cast("double")) * (1 - 0.3), F.lit(float("-inf")))
    asked = queries.filter("q <> ''").select("entry", "q", "energy", floor.alias("least_mw"))

    blocks = max(1, -(-known.count() // block))
    met = meet(asked, "q", known, "v", blocks)
    near = met.applyInPandas(_block_best(k), "entry string, id string, score double")
    return top_k(near.groupBy("entry", "id").agg(F.max("score").alias("score")), "entry", "score", "id", k)


def core_queries(names: DataFrame, entry: Column, name: Column, energy: Column, mw: Column) -> DataFrame:
    """The queries of most_similar(): one a distinct entry, with the largest power and the first category of its names."""
    return names.select(entry.alias("entry"), core_name(name).alias("q"), energy.alias("energy"), mw.alias("mw")).groupBy("entry").agg(F.min("q").alias("q"), F.min("energy").alias("energy"), F.max("mw").alias("mw"))
