"""Problem 2: timestamps in mixed formats, precisions and time zones become one instant in UTC each.

Method: every text is tokenised into its character-class shape mask: digits, and words by what they may be (month, weekday,
half of the day, anything else).  A mask is mapped to a parser once; all texts of a mask are then parsed together, as columns
of digits cut from one fixed-width character array.  Local times are converted by binary search in zone transition tables,
which carry the version of the zone data they were built from; workers whose version is another than the driver's stop.

* A local time that occurs twice is the earlier one, a skipped one moves on by the skipped span: both mean the offset in
  force before the transition.
* Zone sources in falling order: a written offset, a written region, an abbreviation (read in the record's own zone), the
  record's own zone.
* Digits beyond microseconds are cut, missing seconds are 0, a bare number counts from 1970-01-01 UTC in seconds,
  milliseconds, microseconds or nanoseconds, told apart by its size.

Defined results: null, empty, blank, word-only and impossible values (month 13, hour 27, 30 February, day 366 of a common
year, week 54) give null; a date without a time of day is no moment
and gives null; a local time whose record has no known zone gives null.  ``24:00:00`` is the end of its day; second 60, which
only the last minute of a quarter of an hour can have, is the start of the next minute.  Equal values give equal results,
in whatever order they come; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import metadata
from pathlib import Path
from typing import NamedTuple
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters beyond which a fraction is shortened, and a mask not kept for other texts.
LONG = 80
#: Years of the transition table that nearly all times need.
YEARS = (1900, 2100)
#: No zone has a transition before this year.
FIRST_TRANSITIONS = 1800
#: After this many years the calendar and the rules of every zone repeat.
CYCLE_YEARS, CYCLE_DAYS = 400, 146_097
US = 1_000_000
#: Writings that need no conversion: UTC with a capital T and Z, no or exactly six fraction digits.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{6})?Z$"

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "tues", "thur", "thurs")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# ---------------------------------------------------------------------------------------------------------------------
# Zone transition tables


class ZoneTable(NamedTuple):
    """Transitions of one zone: the instants, the offset from each on (the first before all), both in microseconds."""

    version: str
    at: np.ndarray
    offsets: np.ndarray
    #: Local times from which the offset after a transition holds.
    local: np.ndarray
    names: dict[str, int]

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        return local - self.offsets[np.searchsorted(self.local, local, side="right")]


def zone_data_version() -> str:
    """Version of the zone data in use."""
    for root in TZPATH:
        f = Path(root, "tzdata.zi")
        if f.exists():
            with f.open(encoding="ascii", errors="replace") as h:
                if m := re.match(r"# version (\S+)", h.readline()):
                    return m.group(1)
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "system"


@lru_cache(maxsize=4096)
def zone_table(name: str, first: int = YEARS[0], last: int = YEARS[1]) -> ZoneTable | None:
    """The table of a zone from one year up to another, or None if there is no such zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:  # noqa: BLE001 - names come from data: anything may be wrong with them
        return None

    def state(sec: int) -> tuple[int, str]:
        t = (_EPOCH + timedelta(seconds=sec)).astimezone(zone)
        return int(t.utcoffset().total_seconds()), t.tzname()

    lo = int((datetime(first, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    hi = int((datetime(last, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    step, at, offsets, names = 14 * 86400, [], [], {}
    now, was = lo, state(lo)
    offsets.append(was[0])
    names[was[1].upper()] = was[0]
    while now < hi:
        nxt = min(now + step, hi)
        then = state(nxt)
        if then != was:
            a, b = now, nxt
            while b - a > 1:
                mid = (a + b) // 2
                if state(mid) == was:
                    a = mid
                else:
                    b = mid
            was = state(b)
            if was[0] != offsets[-1]:
                at.append(b)
                offsets.append(was[0])
            names[was[1].upper()] = was[0]
            now = b
        else:
            now = nxt
    off = np.array(offsets, np.int64) * US
    inst = np.array(at, np.int64) * US
    return ZoneTable(zone_data_version(), inst, off, inst + np.maximum(off[:-1], off[1:]), {k: v * US for k, v in names.items()})


def local_to_utc(name: str, local: np.ndarray) -> np.ndarray | None:
    """Instants of local times of a zone in any year, or None if there is no such zone."""
    t = zone_table(name)
    if t is None:
        return None
    out = t.to_utc(local)
    lo, hi = (int(_civil_days(np.array([y]), np.array([1]), np.array([1]))[0]) * 86400 * US for y in YEARS)
    if (early := local < lo).any():
        out[early] = zone_table(name, FIRST_TRANSITIONS, YEARS[0]).to_utc(local[early])
    if (late := local >= hi).any():
        cycle = CYCLE_DAYS * 86400 * US
        shift = (local[late] - hi) // cycle * cycle
        out[late] = zone_table(name, YEARS[1], YEARS[1] + CYCLE_YEARS).to_utc(local[late] - shift) + shift
    return out


# ---------------------------------------------------------------------------------------------------------------------
# Masks and their parsers

#: ASCII digits become ``9``, letters capitals.
_FOLD = {**{c: 57 for c in range(48, 58)}, **{c: c - 32 for c in range(97, 123)}}
_WORDS = re.compile(r"[A-Z]{2,}")
#: Letters of the classes of words in a mask; a letter that stands alone (``T``, ``W``, ``Z``) is a capital.
MONTH, WEEKDAY, HALF, OTHER = "m", "d", "p", "a"


@lru_cache(maxsize=65_536)
def _classed(word: str) -> str:
    w = word.lower()
    kind = MONTH if _month_number(w) else WEEKDAY if w in _DAYS or w in _DAY_NAMES else HALF if w in ("am", "pm") else OTHER
    return kind * len(word)


def shape_mask(text: str) -> str:
    """Digits become ``9``, words the letter of their class; a single letter and everything else stand for themselves.

    Texts of one mask have every field in the same place, and the same parser whichever of them is seen first.
    """
    return shape_masks([text])[0]


def shape_masks(texts: list[str]) -> list[str]:
    """Masks of texts without NUL characters, tokenised in one go."""
    return _WORDS.sub(lambda m: _classed(m[0]), "\0".join(texts).translate(_FOLD)).split("\0") if texts else []


class Shape(NamedTuple):
    """What a family of masks means: ``pattern`` matches normalised texts; named groups are the fields."""

    name: str
    pattern: re.Pattern


_D = r"(?P<Y>\d{4})-(?P<M>\d{2})-(?P<D>\d{2})"
_T = r"(?P<h>\d{1,2}):(?P<m>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_T0 = r"(?P<h>\d{2}):?(?P<m>\d{2})(?::?(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_AMPM = r"(?: ?(?P<p>[AaPp]\.?[Mm]\.?))?"
#: Z, an offset, an abbreviation with or without an offset, a region in brackets, in this order.
_Z = r"(?: ?(?P<z>[A-Za-z]{1,5})?(?P<o>[+-]\d{1,2}(?::?\d{2})?)?)?(?: ?\[(?P<r>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_MON = r"(?P<N>[A-Za-z]{3,9})\.?"
_WDAY = r"(?:[A-Za-z]{3,9}, ?)?"

SHAPES = tuple(
    Shape(n, re.compile(p))
    for n, p in (
        ("iso", rf"{_D}[Tt ]{_T}{_AMPM}{_Z}"),
        ("basic", rf"(?P<Y>\d{{4}})(?P<M>\d{{2}})(?P<D>\d{{2}})[Tt ]?{_T0}{_Z}"),
        ("week", rf"(?P<Y>\d{{4}})-?[Ww](?P<W>\d{{2}})-?(?P<w>\d)[Tt ]{_T0}{_Z}"),
        ("ordinal", rf"(?P<Y>\d{{4}})-?(?P<J>\d{{3}})[Tt ]{_T0}{_Z}"),
        ("year_first", rf"(?P<Y>\d{{4}})[/.](?P<M>\d{{1,2}})[/.](?P<D>\d{{1,2}})[Tt ]{_T}{_AMPM}{_Z}"),
        ("year_first_loose", rf"(?P<Y>\d{{4}})-(?P<M>\d{{1,2}})-(?P<D>\d{{1,2}})[Tt ]{_T}{_AMPM}{_Z}"),
        ("year_last", rf"(?P<a>\d{{1,2}})(?P<sep>[/.\-])(?P<b>\d{{1,2}})(?P=sep)(?P<Y>\d{{4}}),?[Tt ]{_T}{_AMPM}{_Z}"),
        ("day_month", rf"{_WDAY}(?P<D>\d{{1,2}})[ -]{_MON}[ -](?P<Y>\d{{4}}|\d{{2}}),?[Tt ]{_T}{_AMPM}{_Z}"),
        ("month_day", rf"{_WDAY}{_MON} (?P<D>\d{{1,2}}),? (?P<Y>\d{{4}}),?[Tt ]{_T}{_AMPM}{_Z}"),
        ("number", r"(?P<e>-?\d{1,19})(?:\.(?P<f>\d+))?"),
    )
)

#: Offsets, in hours, of abbreviations that a zone itself does not use.
_COMMON = {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "WET": 0, "WEST": 1, "JST": 9, "AEST": 10, "AEDT": 11}


class Parser(NamedTuple):
    """Where the fields of a mask stand."""

    shape: Shape
    #: Field to (from, to) in the text when every character has its place.
    fixed: dict[str, tuple[int, int]] | None


@lru_cache(maxsize=4096)
def parser_for(mask: str, sample: str) -> Parser | None:
    """The parser of a mask, worked out from one text that has it.  Called once per mask: see :func:`instants`."""
    for shape in SHAPES:
        if m := shape.pattern.fullmatch(sample):
            return Parser(shape, {k: m.span(k) for k in m.re.groupindex if m.group(k) is not None})
    return None


def _civil_days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of a Gregorian date."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    base = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 1, 12) - 1]
    return base + ((m == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))


def _month_number(name: str) -> int:
    n = name.lower()
    if n in _MONTHS:
        return _MONTHS.index(n) + 1
    if n in _MONTH_NAMES:
        return _MONTH_NAMES.index(n) + 1
    return 9 if n == "sept" else 0


def _weekday_ok(text: str) -> bool:
    w = re.match("[a-z]*", text.lower())[0]
    return w in _DAYS or w in _DAY_NAMES


class Fields:
    """The fields of texts that share a parser, as arrays."""

    def __init__(self, parser: Parser, texts: list[str]):
        self.n = len(texts)
        self.ok = np.ones(self.n, bool)
        self.text: dict[str, list[str]] = {}
        self._digits: dict[str, np.ndarray] = {}
        width = len(texts[0])
        if parser.fixed is not None and texts[0].isascii():
            grid = np.frombuffer("".join(texts).encode("ascii"), np.uint8).reshape(self.n, width)
            for k, (a, b) in parser.fixed.items():
                cols = grid[:, a:b]
                if ((cols >= 48) & (cols <= 57)).all():
                    self._digits[k] = cols
                else:
                    self.text[k] = [t[a:b] for t in texts]
        else:  # characters of differing width: the same expression, text by text
            keys = parser.shape.pattern.groupindex
            got = [parser.shape.pattern.fullmatch(t) for t in texts]
            self.ok &= np.array([g is not None for g in got])
            for k in keys:
                vals = [(g.group(k) or "") if g else "" for g in got]
                if any(vals):
                    self.text[k] = vals

    def has(self, k: str) -> bool:
        return k in self._digits or k in self.text

    def number(self, k: str, default: int = 0) -> np.ndarray:
        if k in self._digits:
            cols = self._digits[k]
            out = np.zeros(self.n, np.int64)
            for j in range(cols.shape[1]):
                out = out * 10 + (cols[:, j].astype(np.int64) - 48)
            return out
        if k in self.text:
            return np.array([int(v) if v else default for v in self.text[k]], np.int64)
        return np.full(self.n, default, np.int64)

    def micros(self) -> np.ndarray:
        """The fraction in microseconds; further digits are cut."""
        if "f" in self._digits:
            cols = self._digits["f"][:, :6]
            out = np.zeros(self.n, np.int64)
            for j in range(cols.shape[1]):
                out = out * 10 + (cols[:, j].astype(np.int64) - 48)
            return out * 10 ** (6 - cols.shape[1])
        if "f" in self.text:
            return np.array([int((v[:6]).ljust(6, "0")) if v else 0 for v in self.text["f"]], np.int64)
        return np.zeros(self.n, np.int64)

    def words(self, k: str) -> list[str]:
        if k in self._digits:
            return [c.tobytes().decode() for c in self._digits[k]]
        return self.text.get(k, [""] * self.n)


def _each(values: list[str], f: Callable[[str], int]) -> np.ndarray:
    seen: dict[str, int] = {}
    out = np.empty(len(values), np.int64)
    for i, v in enumerate(values):
        if v not in seen:
            seen[v] = f(v)
        out[i] = seen[v]
    return out


def _offset(text: str) -> int:
    """``+05:30`` in microseconds; the least integer if it is none."""
    sign, digits = (-1 if text[0] == "-" else 1), text[1:].replace(":", "")
    h, m = (int(digits[:-2]), int(digits[-2:])) if len(digits) > 2 else (int(digits), 0)
    return sign * (h * 3600 + m * 60) * US if h <= 18 and m < 60 else np.iinfo(np.int64).min


def _convert(parser: Parser, texts: list[str], zones: list[str | None], orders: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970 UTC, valid) of texts that share a parser."""
    f = Fields(parser, texts)
    ok, name = f.ok, parser.shape.name
    if name == "number":
        whole = f.number("e")
        size = np.abs(whole)
        unit = np.select([size < 10**11, size < 10**14, size < 10**17], [0, 3, 6], 9)
        us = np.select([unit == 0, unit == 3, unit == 6], [whole * US * (unit == 0), whole * 1000 * (unit == 3), whole], whole // 1000)
        us = us + np.where(unit == 0, f.micros(), 0)
        digits = np.array([len(w.lstrip("-")) for w in f.words("e")])
        return us, ok & (digits >= 9)  # fewer digits are a year, a date or a count, not a moment
    y = f.number("Y")
    if f.has("Y") and f.words("Y") and len(f.words("Y")[0]) == 2:
        y = y + np.where(y < 70, 2000, 1900)
    if name == "year_last":
        a, b = f.number("a"), f.number("b")
        month_first = np.array([o == "mdy" for o in orders])
        m, d = np.where(month_first, a, b), np.where(month_first, b, a)
    elif f.has("N"):
        m, d = _each(f.words("N"), _month_number), f.number("D")
        if texts and "," in texts[0] and name == "day_month":
            ok = ok & np.array([_weekday_ok(t) if "," in t.split(":")[0] and not t[0].isdigit() else True for t in texts])
    else:
        m, d = f.number("M", 1), f.number("D", 1)
    if name == "week":
        w, wd = f.number("W"), f.number("w")
        jan4 = _civil_days(y, np.full(f.n, 1), np.full(f.n, 4))
        monday = jan4 - (jan4 + 3) % 7
        jan4_next = _civil_days(y + 1, np.full(f.n, 1), np.full(f.n, 4))
        weeks = (jan4_next - (jan4_next + 3) % 7 - monday) // 7
        days = monday + (w - 1) * 7 + wd - 1
        ok = ok & (w >= 1) & (w <= weeks) & (wd >= 1) & (wd <= 7)
    elif name == "ordinal":
        j = f.number("J")
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = _civil_days(y, np.full(f.n, 1), np.full(f.n, 1)) + j - 1
        ok = ok & (j >= 1) & (j <= 365 + leap)
    else:
        ok = ok & (m >= 1) & (m <= 12) & (d >= 1) & (d <= _month_length(y, m))
        days = _civil_days(y, np.clip(m, 1, 12), d)
    ok = ok & (y >= 1)
    h, mi, s = f.number("h"), f.number("m"), f.number("s")
    if f.has("p"):
        pm = _each(f.words("p"), lambda v: 2 if not v else {"AM": 0, "PM": 1}.get(v.replace(".", "").upper(), 3))
        ok = ok & (pm != 3)
        ok = ok & ((pm == 2) | ((h >= 1) & (h <= 12)))
        h = np.where(pm == 2, h, h % 12 + 12 * (pm == 1))
    micros = f.micros()
    end_of_day = (h == 24) & (mi == 0) & (s == 0) & (micros == 0)
    leap = (s == 60) & (mi % 15 == 14)
    ok = ok & ((h <= 23) | end_of_day) & (mi <= 59) & ((s <= 59) | leap)
    local = (days * 86400 + h * 3600 + mi * 60 + s) * US + np.where(leap, 0, micros)
    none = np.iinfo(np.int64).min
    off = np.full(f.n, none, np.int64)
    if f.has("o"):
        off = _each(f.words("o"), lambda v: _offset(v) if v else none)
        ok = ok & ((off != none) | np.array([not v for v in f.words("o")]))
    if f.has("z"):
        abbr = [v.upper() for v in f.words("z")]
        if f.has("o"):  # GMT+3: the abbreviation before an offset may only be one for UTC
            ok = ok & np.array([v in ("", "Z", "UTC", "GMT", "UT") for v in abbr])
        read = {}
        for i, v in enumerate(abbr):
            if off[i] == none and v:
                key = (v, zones[i])
                if key not in read:
                    t = zone_table(zones[i]) if zones[i] else None
                    named = None if v in ("Z", "UTC", "GMT", "UT") else t.names.get(v) if t else None
                    read[key] = named if named is not None else _COMMON[v] * 3600 * US if v in _COMMON else none
                off[i] = read[key]
                if off[i] == none:
                    ok[i] = False
    out = np.where(off != none, local - np.where(off == none, 0, off), 0)
    need = (off == none) & ok
    if need.any():
        regions = f.words("r") if f.has("r") else None
        wanted = np.array([(regions[i] if regions and regions[i] else zones[i]) or "" for i in range(f.n)], dtype=object)
        for z in set(wanted[need]):
            here = need & (wanted == z)
            utc = local_to_utc(z, local[here]) if z else None
            if utc is None:
                ok = ok & ~here
            else:
                out[here] = utc
    return out, ok


def instants(texts: list[str | None], zones: list[str | None], orders: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970-01-01 UTC, valid) of texts written in the given zones and date orders."""
    n = len(texts)
    us, valid = np.zeros(n, np.int64), np.zeros(n, bool)
    by_mask: dict[str, list[int]] = {}
    clean = [_FRACTION.sub(r"\1", c) if len(c) > LONG else c for c in ((t or "").translate(_PLAIN).strip() for t in texts)]
    for i, mask in enumerate(shape_masks(clean)):
        by_mask.setdefault(mask, []).append(i)
    for mask, rows in by_mask.items():
        if "9" not in mask:
            continue
        p = _parser(mask, clean[rows[0]])
        if p is not None:
            us[rows], valid[rows] = _convert(p, [clean[i] for i in rows], [zones[i] for i in rows], [orders[i] for i in rows])
    return us, valid


_PLAIN = {0x2212: "-", 0x2013: "-", 0xA0: " ", 9: " ", 0: "\x01"}
#: No other field has 20 digits, so a text that is no time stays none.
_FRACTION = re.compile(r"(?<=[0-9][.,])([0-9]{20})[0-9]+")
_PARSERS: dict[str, Parser | None] = {}


def _parser(mask: str, sample: str) -> Parser | None:
    if len(mask) > LONG:
        return parser_for.__wrapped__(mask, sample)
    if mask not in _PARSERS:
        if len(_PARSERS) > 100_000:
            _PARSERS.clear()
        _PARSERS[mask] = parser_for(mask, sample)
    return _PARSERS[mask]


# ---------------------------------------------------------------------------------------------------------------------
# Spark


def zone_rules(registries: DataFrame, key: str = "registry", zone: str = "tz_name", order: str = "date_order", most: int = 100_000) -> dict[str, tuple[str, str]]:
    """Key to (zone, date order); refused above ``most`` rows, the proven bound of what is shipped."""
    rows = registries.select(F.col(key).alias("k"), F.col(zone).alias("z"), F.col(order).alias("o")).where("k is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} zone rules")
    return {r.k: (r.z, r.o) for r in rows}


def utc_micros(value: Column, key: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """Microseconds since 1970-01-01 UTC of a text written under the rules of ``key``; null if it is no moment."""
    version = zone_data_version()

    @F.pandas_udf(T.LongType())
    def convert(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if zone_data_version() != version:
            raise RuntimeError(f"zone data {zone_data_version()} here and {version} on the driver give different instants")
        for texts, keys in batches:
            found = [rules.get(k, (None, None)) for k in keys]
            us, ok = instants(list(texts), [z for z, _ in found], [o for _, o in found])
            out = pd.array(us, dtype="Int64")
            out[~ok] = pd.NA
            yield pd.Series(out)

    return convert(value, key)


def normalise(df: DataFrame, columns: list[str], key: str, rules: dict[str, tuple[str, str]], id_col: str) -> DataFrame:
    """``(rec_id, field, raw, utc_us)``: every value of the columns, null ``utc_us`` where it is unreadable."""
    long = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(key).alias("k"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("n", "raw"))
    field = F.element_at(F.array(*map(F.lit, columns)), F.col("n") + 1)
    return long.select("rec_id", field.alias("field"), "raw", utc_micros(F.col("raw"), F.col("k"), rules).alias("utc_us"))
