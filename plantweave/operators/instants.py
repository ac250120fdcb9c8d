"""Mixed timestamp formats and time zones to one UTC instant.

Every value is reduced to a shape mask (digits become 9, letters become a). A mask fixes the place of
every field, so each distinct mask is mapped to a parser once per worker and all values of that mask are
then parsed together by slicing one code point matrix. Wall clocks become instants through transition
tables of the zones, which are tied to one version of the zone database.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÄÖÜäöü"
#: No format is longer; a longer value is no timestamp.
LONGEST = 80

# Names of months and weekdays, German and English, and of zones with a fixed offset (minutes).
MONTHS = {
    "januar": 1, "jänner": 1, "january": 1, "jan": 1,
    "februar": 2, "february": 2, "feb": 2,
    "märz": 3, "maerz": 3, "march": 3, "mrz": 3, "mär": 3, "mar": 3,
    "april": 4, "apr": 4,
    "mai": 5, "may": 5,
    "juni": 6, "june": 6, "jun": 6,
    "juli": 7, "july": 7, "jul": 7,
    "august": 8, "aug": 8,
    "september": 9, "sept": 9, "sep": 9,
    "oktober": 10, "october": 10, "okt": 10, "oct": 10,
    "november": 11, "nov": 11,
    "dezember": 12, "december": 12, "dez": 12, "dec": 12,
}
WEEKDAYS = {
    "mo": 0, "di": 1, "mi": 2, "do": 3, "fr": 4, "sa": 5, "so": 6,
    "montag": 0, "dienstag": 1, "mittwoch": 2, "donnerstag": 3, "freitag": 4, "samstag": 5, "sonnabend": 5, "sonntag": 6,
    "mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6,
    "monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5, "sunday": 6,
}
FIXED_ZONES = {"UTC": 0, "Z": 0, "GMT": 0, "ETC/UTC": 0, "ETC/GMT": 0, "UT": 0, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120}
LOCAL_WORDS = {"", "-", "--", "ORTSZEIT"}

_TIME = (
    r"(?P<H>9{1,2})(?:[:.](?P<M>99)(?:[:.](?P<S>99)(?:[.,](?P<f>9{1,9}))?)?)"
    r"(?: ?(?P<word>a+(?:/a+)?))?(?: ?(?P<off>[+-]99(?::?99)?))?"
)
_CLOCKS = [_TIME, r"(?P<H>99)(?P<M>99)", r"(?P<H>9{1,2}) ?(?P<word>a+)"]
_DAYS = [
    r"(?:(?P<wd>a{2,10})\.?,? )?(?P<d>9{1,2})\. ?(?P<m>9{1,2})\. ?(?P<y>9999|99)",
    r"(?:(?P<wd>a{2,10})\.?,? )?(?P<d>9{1,2})/(?P<m>9{1,2})/(?P<y>9999|99)",
    r"(?P<y>9999)-(?P<m>99)-(?P<d>99)",
    r"(?P<y>9999)/(?P<m>99)/(?P<d>99)",
    r"(?P<y>9999)(?P<m>99)(?P<d>99)",
    r"(?:(?P<wd>a{2,10})\.?,? )?(?P<d>9{1,2})(?:\. ?| |-)(?P<mon>a{3,9})(?:\. ?| |-)(?P<y>9999|99)",
]
_DATE_SHAPES = [re.compile(f"{day}(?:(?:(?P<t>a)| ){_TIME})?") for day in _DAYS]
_CLOCK_SHAPES = [re.compile(x) for x in _CLOCKS]
_BARE = {10: 1_000, 13: 1}


@lru_cache(maxsize=4096)
def _date_parser(mask: str) -> dict[str, tuple[int, int]] | int | None:
    """Field positions for a mask; for bare numbers the milliseconds of a unit; None if no parser fits."""
    if len(mask) in _BARE and set(mask) == {"9"}:
        return _BARE[len(mask)]
    return _spans(mask, _DATE_SHAPES)


@lru_cache(maxsize=4096)
def _clock_parser(mask: str) -> dict[str, tuple[int, int]] | None:
    return _spans(mask, _CLOCK_SHAPES)


def _spans(mask: str, shapes: list[re.Pattern[str]]) -> dict[str, tuple[int, int]] | None:
    for shape in shapes:
        if m := shape.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def zone_version() -> str:
    """The version of the zone database on this machine."""
    from zoneinfo import TZPATH

    for folder in TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            path = Path(folder, name)
            if path.exists():
                return path.open().readline().strip().removeprefix("# version ")
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=700)
def transitions(zone: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants in s, ascending; offset in s from each on) of a named zone, for 1900 to 2100. None: no such zone."""
    from zoneinfo import ZoneInfo

    if version != (own := zone_version()):
        raise RuntimeError(f"the zone database here is {own}, that of the driver {version}; results would be mixed")
    try:
        z = ZoneInfo(zone)
    except Exception:  # noqa: BLE001 - whatever is wrong with the name, it names no zone
        return None
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    offset = lambda s: int((epoch + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())
    day, end = int((datetime(1900, 1, 1, tzinfo=UTC) - epoch).total_seconds()), int((datetime(2101, 1, 1, tzinfo=UTC) - epoch).total_seconds())
    at, offsets = [-(2**62)], [offset(day)]
    while day < end:
        after = day + 86_400
        if (new := offset(after)) != offsets[-1]:
            low, high = day, after
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            at.append(high)
            offsets.append(new)
        day = after
    return np.array(at, "int64"), np.array(offsets, "int64")


def _wall_to_utc(wall: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of the wall clock to UTC; second result: which are given by exactly one instant."""
    at, offsets = table
    look = lambda s: offsets[np.searchsorted(at, s, side="right") - 1]
    before, after = look(wall - 86_400), look(wall + 86_400)
    u, v = wall - before, wall - after
    u_fits, v_fits = look(u) == before, look(v) == after
    return np.where(u_fits, u, v), (u_fits ^ v_fits) | (u_fits & (u == v))


@lru_cache(maxsize=4096)
def _zone(text: str, local: str) -> int | str | None:
    """A zone's text as fixed offset in seconds, as name of a region, or None if it is neither."""
    t = text.strip()
    u = t.upper()
    if u in LOCAL_WORDS:
        return local
    if u in FIXED_ZONES:
        return FIXED_ZONES[u] * 60
    if m := re.fullmatch(r"(?:UTC|GMT)? ?([+-])(\d{1,2})(?::?(\d\d))?", u):
        hours, minutes = int(m[2]), int(m[3] or 0)
        return (1 if m[1] == "+" else -1) * (hours * 3600 + minutes * 60) if hours <= 18 and minutes < 60 else None
    return "/".join("_".join(p[:1].upper() + p[1:] for p in part.split("_")) if part.islower() or part.isupper() else part for part in t.split("/")) if "/" in t else None


class _Batch:
    """Fields of one column of values, filled in mask by mask."""

    def __init__(self, n: int) -> None:
        self.ok = np.zeros(n, bool)
        self.day = np.zeros(n, "int64")
        self.ms = np.zeros(n, "int64")
        self.clock = np.zeros(n, bool)
        self.bare = np.zeros(n, bool)
        self.zone = np.full(n, None, object)


def _codes(values: np.ndarray) -> np.ndarray:
    a = values.astype(str)
    return np.ascontiguousarray(a).view(np.uint32).reshape(len(a), -1)


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), "int64")
    for j in range(*span):
        out = out * 10 + (codes[:, j].astype("int64") - 48)
    return out


def _words(codes: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    part = np.ascontiguousarray(codes[:, span[0] : span[1]]).view(f"U{span[1] - span[0]}").ravel()
    return np.unique(part, return_inverse=True)


def _read_clock(codes: np.ndarray, spans: dict[str, tuple[int, int]], local: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(milliseconds of the day, zone texts or None, which are possible)"""
    n = len(codes)
    hour = _number(codes, spans["H"])
    minute = _number(codes, spans["M"]) if "M" in spans else np.zeros(n, "int64")
    second = _number(codes, spans["S"]) if "S" in spans else np.zeros(n, "int64")
    ms = np.zeros(n, "int64")
    if "f" in spans:
        a, b = spans["f"]
        ms = _number(codes, (a, min(b, a + 3))) * 10 ** max(0, 3 - (b - a))
    ok, zone = np.ones(n, bool), np.full(n, None, object)
    if "word" in spans:
        seen, which = _words(codes, spans["word"])
        kinds = np.array([{"am": 1, "pm": 2, "uhr": 0, "h": 0}.get(w.lower(), 3 if w.upper() not in LOCAL_WORDS and _zone(w, local) is not None else 4) for w in seen])[which]
        half = (kinds == 1) | (kinds == 2)
        ok &= (kinds < 4) & (~half | ((hour >= 1) & (hour <= 12)))
        if "M" not in spans:
            ok &= kinds != 3
        hour = np.where(half, hour % 12 + 12 * (kinds == 2), hour)
        zone = np.where(kinds == 3, seen.astype(object)[which], zone)
    if "off" in spans:
        seen, which = _words(codes, spans["off"])
        ok &= np.equal(zone, None)
        zone = seen.astype(object)[which]
    ok &= (minute < 60) & (second < 60) & ((hour < 24) | ((hour == 24) & (minute + second + ms == 0)))
    return ((hour * 60 + minute) * 60 + second) * 1000 + ms, zone, ok


def _read(values: pd.Series, masks: pd.Series, dates: bool, local: str) -> _Batch:
    out = _Batch(len(values))
    which, seen = pd.factorize(masks)
    texts = values.to_numpy(object)
    for k, mask in enumerate(seen):
        if len(mask) > LONGEST or (parser := (_date_parser if dates else _clock_parser)(mask)) is None:
            continue
        rows = np.flatnonzero(which == k)
        codes = _codes(texts[rows])
        if codes.shape[1] != len(mask):
            continue
        if isinstance(parser, int):
            out.ok[rows], out.bare[rows] = True, True
            out.ms[rows] = _number(codes, (0, len(mask))) * parser
            continue
        ok = np.ones(len(rows), bool)
        if dates:
            year, day = _number(codes, parser["y"]), _number(codes, parser["d"])
            year = np.where(parser["y"][1] - parser["y"][0] == 2, 2000 + year, year)
            if "mon" in parser:
                names, inverse = _words(codes, parser["mon"])
                month = np.array([MONTHS.get(x.lower(), 0) for x in names], "int64")[inverse]
            else:
                month = _number(codes, parser["m"])
            ok &= (month >= 1) & (month <= 12) & (year >= 1) & (day >= 1)
            first = ((year - 1970) * 12 + np.where(ok, month, 1) - 1).astype("datetime64[M]")
            days = first.astype("datetime64[D]").astype("int64")
            ok &= day <= (first + 1).astype("datetime64[D]").astype("int64") - days
            days = days + day - 1
            if "wd" in parser:
                names, inverse = _words(codes, parser["wd"])
                told = np.array([WEEKDAYS.get(x.lower(), 9) for x in names])[inverse]
                ok &= told == (days + 3) % 7
            out.day[rows] = days
            if "t" in parser:
                ok &= np.isin(codes[:, parser["t"][0]], (84, 116))
        if "H" in parser:
            ms, zone, fits = _read_clock(codes, parser, local)
            ok &= fits
            out.ms[rows], out.zone[rows], out.clock[rows] = ms, zone, True
        out.ok[rows] = ok
    return out


def _instants(date: pd.Series, time: pd.Series, zone: pd.Series, date_mask: pd.Series, time_mask: pd.Series, local: str, version: str) -> pd.Series:
    n = len(date)
    d, t = _read(date, date_mask, True, local), _read(time, time_mask, False, local)
    no_time = (time.isna() | (time == "")).to_numpy(bool)
    same = d.clock & t.clock & (d.ms == t.ms)
    ok = d.ok & np.where(d.bare, no_time, np.where(d.clock, no_time | (t.ok & same), t.ok))
    ms = np.where(d.clock, d.ms, t.ms)
    told = np.array([x is not None and x == x for x in zone.to_numpy(object)], bool)
    inner = np.where(np.equal(d.zone, None), t.zone, d.zone)
    text = np.where(told, zone.to_numpy(object), np.where(np.equal(inner, None), "", inner))
    which, seen = pd.factorize(text)
    wall = d.day * 86_400 + ms // 1000
    result = np.where(d.bare, d.ms, 0)
    for k, name in enumerate(seen):
        rows = np.flatnonzero((which == k) & ok & ~d.bare)
        if not len(rows):
            continue
        z = _zone(name, local)
        if isinstance(z, int):
            utc, one = wall[rows] - z, np.ones(len(rows), bool)
        elif z is not None and (table := transitions(z, version)) is not None:
            utc, one = _wall_to_utc(wall[rows], table)
        else:
            ok[rows] = False
            continue
        ok[rows] = one
        result[rows] = utc * 1000 + ms[rows] % 1000
    return pd.Series(pd.arrays.IntegerArray(result.astype("int64"), ~ok)) if n else pd.Series([], dtype="Int64")


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s\\u00a0\\u2000-\\u200f\\u202f\\u3000\\ufeff]+", " "))


def _mask(c: Column) -> Column:
    return F.translate(c, DIGITS + LETTERS, "9" * len(DIGITS) + "a" * len(LETTERS))


def instant_ms(date: Column, time: Column, zone: Column, local: str = "Europe/Berlin") -> Column:
    """Milliseconds since 1970 UTC of a start that is written as date, time and zone.

    local: the clock that counts where no zone is given. An embedded zone counts only where zone is null.
    Null results: a missing, unknown or impossible field, a date whose weekday is not its own, a clock time
    that the zone's clock change skips or repeats, a zone that isn't known, two different times. Bare numbers
    of 10 or 13 digits are instants by themselves, if there is no time beside them. Blank fields are missing;
    an empty column or table gives none. Fractions finer than a millisecond are cut.
    """
    version = zone_version()

    @pandas_udf("long")
    def convert(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for date, time, zone, date_mask, time_mask in batches:
            yield _instants(date, time, zone, date_mask, time_mask, local, version)

    d, t = _clean(date), _clean(time)
    # Else a filter on the result would be pushed below the projection and convert everything twice.
    return convert.asNondeterministic()(d, t, _clean(zone), _mask(d), _mask(t))


def is_plain(date: Column, time: Column, zone: Column) -> Column:
    """Whether a start is already written in the one plain form: dd.MM.yyyy, HH:mm, UTC."""
    return F.coalesce((zone == "UTC") & date.rlike(r"^\d\d\.\d\d\.\d{4}\z") & time.rlike(r"^([01]\d|2[0-3]):[0-5]\d\z"), F.lit(False))
