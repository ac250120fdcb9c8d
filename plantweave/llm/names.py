"""Names of plants as people type them, taken apart: place, type, block, direction, voltage sections, operator.

The short forms of plant types and directions are fixed. Which words are names of operators or grids, and which are the
adjectives of nicknames, is learned from the corpus (words.py) and given to the parser; everything else is part of the place.
Texts are compared in a folded form, in which letter case, umlauts and their substitutes (ae, plain vowel) don't show.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cached_property, lru_cache

import regex

# Forms of the plant types, directions, bundles of plants and words that tell nothing.
TYPES = {
    "windpark": "WP", "windpk": "WP", "wp": "WP", "windkraftanlage": "WP", "wka": "WP",
    "solarpark": "PVA", "solarpk": "PVA", "pva": "PVA", "photovoltaikanlage": "PVA", "pv": "PVA",
    "biogasanlage": "BGA", "biogasanl": "BGA", "biogas-anl": "BGA", "bga": "BGA",
    "braunkohlekraftwerk": "BKW", "braunkohle-kw": "BKW", "bkw": "BKW",
    "gasturbinenkraftwerk": "GTKW", "gasturbinen-kw": "GTKW", "gtkw": "GTKW",
    "heizkraftwerk": "HKW", "heizkw": "HKW", "hkw": "HKW",
    "pumpspeicherwerk": "PSW", "pumpspeicherkraftwerk": "PSW", "pumpsp": "PSW", "psw": "PSW",
    "kraftwerk": "KW", "kraftw": "KW", "kw": "KW",
}
CLUSTERS = {"cluster", "clust", "cl", "einspeiseverbund", "verbund", "sammelanlage", "ee-sammelanlage", "ee-cluster"}
DIRECTIONS = {
    "nord": "N", "nrd": "N", "n": "N", "nordl": "N",
    "sud": "S", "sd": "S", "s": "S", "sudl": "S",
    "ost": "O", "ostl": "O", "o": "O",
    "west": "W", "wst": "W", "w": "W", "westl": "W",
    "mitte": "M", "mtte": "M", "m": "M",
}
BLOCKS = {"block", "blk", "bl"}
LEGAL = {"gmbh", "ag", "kg", "betriebs", "co", "betriebs-kg", "se", "mbh", "ug"}
#: Parts of a type whose hyphen was lost.
MODIFIERS = {"braunkohle": "BKW", "braunkohlen": "BKW", "gasturbinen": "GTKW", "biogas": "BGA", "pumpspeicher": "PSW"}
FILLERS = {"ee", "und", "u", "der", "die", "das", "des", "anlage", "erzeugungsanlage", "ot", "nr", "von", "am", "an", "bei", "in", "anl", "werk", "park"}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
#: Energy of the registry and of the plant index that goes with each type.
ENERGY = {
    "windenergie an land": {"WP"}, "windenergie auf see": {"WP"}, "solare strahlungsenergie": {"PVA"}, "biomasse": {"BGA"},
    "braunkohle": {"BKW"}, "erdgas": {"GTKW", "HKW"}, "pumpspeicher": {"PSW"}, "steinkohle": {"KW"},
    "wind": {"WP"}, "solar": {"PVA"}, "biogas": {"BGA"}, "lignite": {"BKW"}, "natural gas": {"GTKW", "HKW"}, "hydro": {"PSW"}, "hard coal": {"KW"},
}

_DIGRAPHS = regex.compile("(?<=[aou])e")
_INVISIBLE = regex.compile(r"(?:(?!\s)[\p{Cf}\p{Cc}])+")


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case without accents; ae, oe and ue are one with the umlaut and the plain vowel, ß with ss."""
    text = text.casefold().replace("æ", "ae").replace("ø", "o").replace("ł", "l")
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _DIGRAPHS.sub("", text)


FOLDED_TYPES = {fold(k): v for k, v in TYPES.items()}
FOLDED_CLUSTERS = {fold(k) for k in CLUSTERS}
FOLDED_FILLERS = {fold(k) for k in FILLERS}
LONG_FORMS = {k: v for k, v in FOLDED_TYPES.items() if len(k) >= 7} | {k: "cluster" for k in FOLDED_CLUSTERS if len(k) >= 7}


def _shortened(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@dataclass(frozen=True)
class Words:
    """What the corpus tells of words: companions (operators and grids, which stand beside many places) and adjectives of nicknames."""

    companions: frozenset[str] = frozenset()
    adjectives: frozenset[str] = frozenset()

    @cached_property
    def forms(self) -> dict[str, str]:
        """Long words whose meaning one typing error doesn't hide."""
        return LONG_FORMS | {k: "operator" for k in self.companions if len(k) >= 6}

    @cached_property
    def _near(self) -> dict[str, list[str]]:
        """The long forms by what is left of them without one letter: words within one edit share such a rest."""
        out: dict[str, list[str]] = {}
        for form in self.forms:
            for rest in _shortened(form):
                out.setdefault(rest, []).append(form)
        return out

    @lru_cache(maxsize=100_000)
    def long_form(self, word: str) -> str | None:
        """The meaning of a long form with one typing error."""
        if word in self.forms or len(word) < 7:
            return self.forms.get(word)
        met = dict.fromkeys(f for rest in _shortened(word) for f in self._near.get(rest, ()))
        return next((self.forms[f] for f in self.forms if f in met and within(word, f, 1) is not None), None)


NO_WORDS = Words()


def within(a: str, b: str, k: int, prefix: bool = False) -> int | None:
    """Edit distance with transpositions, if it is at most k, in a band of that width; prefix: a against any begin of b."""
    if not prefix and abs(len(a) - len(b)) > k or len(a) - len(b) > k:
        return None
    big = k + 1
    before, row = None, [j if j <= k else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - k), min(len(b), i + k)
        new = [big] * (len(b) + 1)
        if i <= k:
            new[0] = i
        for j in range(low, high + 1):
            d = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, big)
        if min(new[max(0, low - 1) : high + 1]) > k:
            return None
        before, row = row, new
    d = min(row) if prefix else row[len(b)]
    return d if d <= k else None


@dataclass
class Part:
    """One plant, cluster or unit of a name. place is folded; cut: it was shortened; nick: it is a nickname."""

    place: str = ""
    cut: bool = False
    nick: bool = False
    type: str = ""
    cluster: bool = False
    block: str = ""
    direction: str = ""
    sections: str = ""
    operator: str = ""


_SECTION = regex.compile(r"\bt ?5\d\d(?:\s*[/+&,]?\s*(?:t ?)?5\d\d\b)*")
_PAIRED = regex.compile(r"(?<!\d)(\d{1,2})[\s–-]*(?:/|\+|&|\bund(?!\p{L})|\bu\.)[\s–-]*(\d{1,2})(?!\d)")
#: The second number of a pair that was moved to the front.
_TORN = regex.compile(r"^\W*(\d{1,2})(?!\d)[\s,;]+(.*\d)[\s–-]*(?:/|\+|&|\bund)\W*$", regex.S)
_ITEM = regex.compile(r"\x01[\d ]+\x01|\x02\d+/\d+|[\p{L}\p{M}]+(?:-(?=\p{L})[\p{L}\p{M}]+)*\.?|\d+|[,/+&;]")
_JOINS = frozenset(",/+&;")


def _items(name: str, words: Words) -> list[tuple[str, str]]:
    """(kind, value) of all that a name is made of, in order."""
    text = unicodedata.normalize("NFC", _INVISIBLE.sub("", name))
    text = fold(regex.sub(r"[\s_*\"'„“”‚‘’?]+", " ", text))
    text = _TORN.sub(r"\2/\1", text)
    text = _SECTION.sub(lambda m: " \x01" + " ".join(sorted(set(regex.findall(r"5\d\d", m[0])))) + "\x01 ", text)
    text = _PAIRED.sub(lambda m: f" \x02{m[1]}/{m[2]} ", text)
    out: list[tuple[str, str]] = []
    keyed = False
    for token in _ITEM.findall(text):
        if token[0] == "\x01":
            out.append(("sections", token.strip("\x01 ")))
        elif token[0] == "\x02":
            out.append(("block", token[1:]))
        elif token in _JOINS:
            out.append(("join", token))
        elif token.isdigit():
            out.append(("block", str(int(token))))
        else:
            for word, dotted in _pieces(token.rstrip("."), token.endswith(".")):
                if word in BLOCKS:
                    keyed = True
                    continue
                out.append(_meaning(word, dotted, keyed, words))
                keyed = keyed and out[-1][0] not in ("block",)
            continue
        keyed = False
    return [x for x in out if x[0]]


def _pieces(bare: str, dotted: bool) -> list[tuple[str, bool]]:
    """A token, or what its hyphens join."""
    known = lambda x: x in FOLDED_TYPES or x in FOLDED_CLUSTERS
    if "-" not in bare or known(bare):
        return [(bare, dotted)]
    whole, out = bare.split("-"), []
    while whole:
        take = 2 if len(whole) > 1 and known("-".join(whole[:2])) else 1
        out.append(("-".join(whole[:take]), dotted and len(whole) == take))
        whole = whole[take:]
    return out


def _meaning(word: str, dotted: bool, keyed: bool, words: Words) -> tuple[str, str]:
    if keyed and word in ROMAN:
        return "block", str(ROMAN[word])
    if len(word) == 1:
        return ("block", word.upper()) if keyed else ("letter", word)
    if word in FOLDED_TYPES:
        return "type", FOLDED_TYPES[word]
    if word in FOLDED_CLUSTERS:
        return "cluster", word
    if word in MODIFIERS:
        return "type", MODIFIERS[word]
    if word in LEGAL or word in FOLDED_FILLERS:
        return "", word
    if word in words.companions:
        return "operator", word
    if word in DIRECTIONS:
        return "direction", DIRECTIONS[word]
    if word in ROMAN:
        return "block", str(ROMAN[word])
    if word in words.adjectives:
        return "nick", word
    if (meaning := words.long_form(word)) is not None:
        return ("cluster", word) if meaning == "cluster" else ("operator", word) if meaning == "operator" else ("type", meaning)
    return ("cut" if dotted and len(word) >= 4 else "word"), word


def _part(items: list[tuple[str, str]]) -> Part:
    part, words, nick = Part(), [], ""
    letters = [v for k, v in items if k == "letter"]
    for kind, value in items:
        if kind in ("word", "cut"):
            words.append((len(value), value, kind == "cut"))
        elif kind == "nick":
            nick = value
        elif kind == "cluster":
            part.cluster = True
        elif kind == "type":
            part.type = value if part.type in ("", "KW") else part.type
        elif kind == "sections":
            part.sections = " ".join(sorted({*part.sections.split(), *value.split()}))
        elif kind in ("block", "direction", "operator"):
            setattr(part, kind, getattr(part, kind) or value)
    if words:
        _, part.place, part.cut = max(words)
    elif nick:
        part.place, nick = nick, ""
    if nick:
        part.place, part.nick = f"{nick} {part.place}", True
    part.cluster = part.cluster or bool(part.sections) or bool(part.direction and not part.type)
    for x in letters:
        if part.cluster and x in DIRECTIONS and not part.direction:
            part.direction = DIRECTIONS[x]
        elif not part.cluster and not part.block:
            part.block = str(ROMAN[x]) if x in ROMAN else x.upper()
    return part


def _parted(name: str | None, words: Words) -> list[list[tuple[str, str]]]:
    """What a name is made of, parted at its separators."""
    pieces: list[list[tuple[str, str]]] = [[]]
    for x in _items(name, words) if name else []:
        if x[0] == "join":
            pieces.append([])
        else:
            pieces[-1].append(x)
    return [p for p in pieces if p]


def unknown_words(name: str | None) -> list[list[str]]:
    """The words of each piece of a name that no fixed list knows, whole ones and shortened ones."""
    return [[v for k, v in piece if k in ("word", "cut")] for piece in _parted(name, NO_WORDS)]


@lru_cache(maxsize=50_000)
def parse(name: str | None, words: Words = NO_WORDS) -> tuple[Part, ...]:
    """The plants that a name tells, one for most names, more for a bundle; none for null and blank names.

    A name is a bundle if its separators part it into pieces with a place each. Pieces without a place, which may have
    been moved from one end to the other, belong to their neighbours.
    """
    pieces = _parted(name, words)
    placed = [any(k in ("word", "cut") for k, _ in p) for p in pieces]
    if sum(placed) < 2:
        return (_part([x for p in pieces for x in p]),) if pieces else ()
    # In a circle, a type without a place belongs to the next place, if that has none, anything else to the one before.
    at = [i for i, has in enumerate(placed) if has]
    whole = {i: list(pieces[i]) for i in at}
    for i, piece in enumerate(pieces):
        if not placed[i]:
            after = min((j for j in at if j > i), default=at[0])
            before = max((j for j in at if j < i), default=at[-1])
            typed = any(k == "type" for k, _ in piece) and not any(k == "type" for k, _ in whole[after])
            whole[after if typed else before] += piece
    return tuple(_part(p) for p in whole.values())
