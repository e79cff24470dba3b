"""What a page says without a label: all dates of a line, times beside the journey's date, headings, names and brands.

Plain functions of a page's lines for the builders; those of one text are Columns too.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import places
from ..functions.scalars import MONTHS, bound
from . import layout

# -- fixed values: shapes of dates with a year, of clock times, and words that tell lines apart --------------------
_MONTH = "|".join(MONTHS)
NAMED_DATE = re.compile(rf"(?i)\b(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s,-]*(?P<m>{_MONTH})[a-z]*[\s,'-]*(?P<y>\d{{4}}|\d\d)\b(?!\s*:)")
MONTH_FIRST = re.compile(rf"(?i)\b(?P<m>{_MONTH})[a-z]*[\s.-]*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})\b")
NUMERIC_DATE = re.compile(r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b")
ISO_DATE = re.compile(r"\b(\d{4})-(\d\d)-(\d\d)\b")
CLOCK = re.compile(r"(?i)\b(\d{1,2}):(\d\d)(?::\d\d)?(?:\s*([ap])\.?m\b)?")
STAMP = re.compile(r"(?i)\bbook(?:ing|ed)\b|\bissued\b|\bgenerated\b|\bprinted\b|\bcloses?\b|\bbag\s*drop\b")
ARROW = re.compile(r"\s*(?:→|➜|➔|»|-->|—>|–>|->)\s*|\s>\s?|\s?>\s")
#: Words of captions: a line that has one is no place, a name that has one is nobody's.
NO_PLACE = frozenset(
    """address boarding booking bus care customer date detail details dropping fare help id landmark location name no number operator order passenger pnr point ref reference
    seat status support ticket time travel travels type""".split()
)
DAY_OR_MONTH = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
NAME_HEADING = re.compile(r"(?i)\bpassenger\s*(?:information|details|name)\b")
NO_NAME = frozenset(
    """addon addons add-on add-ons age airport airpt arrival baggage booking cabin class date departure destination detail details domestic fare flight from gate gender information
    international intl name origin passenger pax reference seat sector status terminal ticket time to type""".split()
)
AGE_GROUP = re.compile(r"(?i)\b(?:adults?|child(?:ren)?|infants?|male|female|senior|citizen|youth)\b")
HONORIFIC = re.compile(r"(?i)^\s*(?:mr|mrs|ms|miss|mstr|master|dr|prof)\.?\s+")
#: Words, and pairs of words, of a document's own heading.
TITLE_WORDS = frozenset("information details summary itinerary booking reference eticket voucher invoice receipt".split())
TITLE_PAIRS = frozenset({("boarding", "pass"), ("e", "ticket"), ("travel", "document"), ("reservation", "slip"), ("electronic", "ticket"), ("departure", "flight"), ("e", "boarding"), ("e", "receipt")})
SALUTATIONS = frozenset("dear hi hello welcome".split())
#: Words of lines whose dates are of a payment or a printout, not of travel.
TRANSACTION = frozenset("billed booked booking created generated invoice issue issued order ordered paid printed purchase purchased receipt transaction".split())
HEADING_LINES, HEADING_DATES, NAME_LINES = 16, 5, 5
# ----------------------------------------------------------------------------------------------------------------

_WORD, _TO, _ARROWS = re.compile(r"[a-z]+(?:-[a-z]+)*"), re.compile(r"(?i)\s+to\s+"), re.compile("[→➜➔»>]")
_NOISE, _CARRIER = re.compile(r"[][{}|\\/@#*_~`\d]"), re.compile(r"(?i)([A-Z0-9]{2})(?:[\s-]?\d{1,4}[A-Z]?)?")
_PLACE_WORD = rf"(?!{DAY_OR_MONTH})(?:[A-Za-z][A-Za-z.'-]*|\([A-Za-z]{{2,5}}\))"
_PLACE_END = re.compile(rf"(?i)(?:^|(?<=[\s,]))({_PLACE_WORD}(?:\s+{_PLACE_WORD}){{0,2}})$")
_PLACE_START = re.compile(rf"(?i)^({_PLACE_WORD}(?:\s+{_PLACE_WORD}){{0,2}})(?=[\s,]|$)")


def words(text: str | None) -> list[str]:
    """The words of a text in small letters; one with a hyphen is one."""
    return _WORD.findall((text or "").lower())


def of_transaction(text: str | None) -> bool:
    """Whether a line speaks of a payment or a printout."""
    return not TRANSACTION.isdisjoint(w for x in words(text) for w in x.split("-"))


def readings(text: str | None) -> list[str]:
    """Every date with a year that a text may mean, in order and once: numbers are read day first and month first. Days that do not exist are none."""
    text, found = text or "", set()
    low = layout.folded(text)
    if any(m in low for m in MONTHS):
        for m in (*NAMED_DATE.finditer(text), *MONTH_FIRST.finditer(text)):
            found.add((int(m["y"]) + (2000 if len(m["y"]) == 2 else 0), MONTHS.index(layout.folded(m["m"])) + 1, int(m["d"])))
    if "/" in text or "." in text or "-" in text:
        for a, b, year in NUMERIC_DATE.findall(text):
            found |= {(int(year), int(b), int(a)), (int(year), int(a), int(b))}
        found |= {tuple(map(int, m)) for m in ISO_DATE.findall(text)}
    return sorted(day for y, m, d in found if (day := _real(y, m, d)))


def _real(year: int, month: int, day: int) -> str | None:
    try:
        return dt.date(year, month, day).isoformat()
    except ValueError:
        return None


def dates_on_line(text: Column) -> Column:
    """``readings`` as a Column: every date with a year that a text may mean."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = lambda shape: F.regexp_extract_all(t, F.lit(shape), F.lit(0))
    month = lambda m: F.lpad((F.array_position(F.array(*(F.lit(x) for x in MONTHS)), F.substring(m, 1, 3))).cast("string"), 2, "0")
    part = lambda x, shape, k: F.regexp_extract(x, shape, k)
    day = lambda y, m, d: F.concat(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date").cast("string")
    named, first = (rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)?[\s,-]*({_MONTH})[a-z]*[\s,'-]*([0-9]{{4}}|[0-9][0-9])\b(?!\s*:)", rf"\b({_MONTH})[a-z]*[\s.-]*([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b")
    number, iso = r"\b([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})\b", r"\b([0-9]{4})-([0-9][0-9])-([0-9][0-9])\b"
    all_ = F.concat(
        F.transform(found(named), lambda x: day(part(x, named, 3), month(part(x, named, 2)), part(x, named, 1))), F.transform(found(first), lambda x: day(part(x, first, 3), month(part(x, first, 1)), part(x, first, 2))),
        F.flatten(F.transform(found(number), lambda x: F.array(day(part(x, number, 3), part(x, number, 2), part(x, number, 1)), day(part(x, number, 3), part(x, number, 1), part(x, number, 2))))),
        F.transform(found(iso), lambda x: day(part(x, iso, 1), part(x, iso, 2), part(x, iso, 3))),
    )
    return F.array_sort(F.array_distinct(F.array_compact(all_)))


def clocks(text: str) -> list[str]:
    """Times with a colon, in order, as HH:MM."""
    out = []
    for hour, minute, half in CLOCK.findall(text):
        h = int(hour) % 12 + (12 if half in "pP" else 0) if half and int(hour) <= 12 else int(hour)
        if h < 24 and int(minute) < 60:
            out.append(f"{h:02d}:{minute}")
    return out


def journey_times(lines: list[dict], journey: str | None) -> list[str]:
    """Times of lines that carry the journey's date; where none does, those of lines without a date. Stamps and other days do not count."""
    dated, free = [], []
    for line in lines:
        shown = clocks(line["text"]) if ":" in line["text"] else None
        if not shown:
            continue
        if STAMP.search(line["text"]):
            continue
        days = readings(line["text"])
        if journey and days and journey not in days:
            continue
        (dated if journey and days else free).extend(shown)
    return dated or free


def _sized(lines: list[dict]):
    """Whether a line is set like a heading: half of the tallest at the top and a quarter above the (upper) median; all are where a page has one size."""
    heights = sorted(x["height"] for x in lines)
    middle, tallest = heights[len(heights) // 2], max(x["height"] for x in lines[:HEADING_LINES])
    return lambda x: heights[0] == heights[-1] or x["height"] >= max(0.45 * tallest, 1.25 * middle)


def route_heading(lines: list[dict]) -> tuple[str, str, int] | None:
    """(from, to, line number) of a heading among the first lines: places around an arrow, around "to", or two large cells."""
    if not lines:
        return None
    large, sizes = _sized(lines), {x["height"] for x in lines}
    for at, line in enumerate(lines[:HEADING_LINES]):
        arrow, cells = ARROW.search(line["text"]) if _ARROWS.search(line["text"]) else None, layout.split_columns(line)
        word = _TO.search(line["text"]) if not arrow and large(line) else None
        cut = arrow or word
        if cut:
            left, right = _PLACE_END.search(line["text"][: cut.start()].strip()), _PLACE_START.search(line["text"][cut.end() :].strip())
            pair = (left[1], right[1]) if left and right else None
            if pair and word and len(sizes) == 1 and not (left[0] == line["text"][: cut.start()].strip() and len(right[1]) == len(line["text"][cut.end() :].strip())):
                pair = None  # in text of one size a sentence is no heading
        else:
            pair = (cells[0]["text"].strip(), cells[1]["text"].strip()) if len(sizes) > 1 and len(cells) > 1 and large(line) else None
            if pair and not all(re.fullmatch(r"[A-Za-z][A-Za-z .'-]{2,24}", x) and NO_PLACE.isdisjoint(words(x)) for x in pair):
                pair = None
        if pair and min(map(len, pair)) >= 3 and pair[0].upper() != pair[1].upper():
            return *pair, at
    return None


@functools.cache
def cities() -> frozenset[str]:
    return frozenset(city.lower() for _, city, _ in places.airport_entries())


@functools.cache
def airport_codes() -> frozenset[str]:
    return frozenset(code for code, _, _ in places.airport_entries())


def first_column(text: str | None) -> str | None:
    """What stands before the first gap."""
    return re.split(r"\s{2,}|\t|\|", text.strip())[0].strip() or None if text else None


@functools.cache
def carriers() -> dict[str, str]:
    return dict(places.airline_entries())


def is_person(name: str) -> bool:
    """No city or airport, no caption, no age group alone."""
    return 2 <= len(name) <= 40 and name.lower() not in cities() and NO_NAME.isdisjoint(words(name)) and not any(c.isdigit() for c in name)


def names_under_heading(lines: list[dict]) -> list[str]:
    """Names beside a heading of passengers, else on the next lines; a longer form of a name that is known is left out."""

    def clean(text: str) -> str:
        return re.sub(r"\s+", " ", AGE_GROUP.sub("", HONORIFIC.sub("", text.replace("|", " ")))).strip()

    for at, line in enumerate(lines):
        cells = layout.split_columns(line)
        here = next((k for k, c in enumerate(cells) if NAME_HEADING.search(c["text"])), None)
        if here is None:
            continue
        beside = [clean(c["text"]) for c in cells[here + 1 : here + 2]]
        below = [clean(x["text"]) for x in lines[at + 1 : at + 1 + NAME_LINES]]
        for group in (beside, below):
            names: list[str] = []
            for name in (x for x in group if is_person(x) and len(x.split()) <= 5):
                if not any(name.lower() == n.lower() or name.lower().startswith(n.lower() + " ") for n in names):
                    names.append(name)
            if names:
                return names
    return []


def is_title(text: str | None) -> bool:
    """A document's title, a salutation, or what is no brand: digits, signs, over four words, or under three letters."""
    t = text or ""
    noise = _NOISE.search(t) or len(t.split()) > 4 or sum(c.isascii() and c.isalpha() for c in t) < 3
    said = [w for x in words(t) for w in x.split("-")]
    heading = not TITLE_WORDS.isdisjoint(said) or not TITLE_PAIRS.isdisjoint(zip(said, said[1:], strict=False))
    return bool(t) and bool(noise or heading or said[:1] and said[0] in SALUTATIONS)


def looks_like_title(text: Column) -> Column:
    """``is_title`` as a Column."""
    t = F.coalesce(text, F.lit(""))

    def heading(said: Column) -> Column:
        pairs = F.transform(F.slice(said, 2, 1 << 30), lambda w, i: F.concat(F.get(said, i), F.lit(" "), w))
        some = lambda words: F.array(*(F.lit(w) for w in sorted(words)))
        return F.arrays_overlap(said, some(TITLE_WORDS)) | F.arrays_overlap(pairs, some(" ".join(p) for p in TITLE_PAIRS)) | F.coalesce(F.get(said, F.lit(0)).isin(*sorted(SALUTATIONS)), F.lit(False))

    noise = t.rlike(r"[\]\[{}|\\/@#*_~`0-9]") | (F.regexp_count(t, F.lit(r"\S+")) > 4) | (F.regexp_count(t, F.lit("[A-Za-z]")) < 3)
    return (t != "") & (noise | bound(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)), heading))


def carrier_name(text: str | None) -> str | None:
    """The airline of a bare code or of a flight number of a known code; anything else as it is."""
    t = (text or "").strip()
    m = _CARRIER.fullmatch(t)
    return (carriers().get(m[1].upper()) or t if m else t) or None


def expand_carrier(text: Column) -> Column:
    """``carrier_name`` as a Column: a small table of codes is a constant."""
    t = F.trim(F.coalesce(text, F.lit("")))
    code = F.upper(F.regexp_extract(t, r"(?i)^([A-Z0-9]{2})(?:[\s-]?[0-9]{1,4}[A-Z]?)?$", 1))
    known = F.from_json(F.lit(json.dumps(carriers())), "map<string,string>")
    return F.nullif(F.coalesce(F.try_element_at(known, code), t), F.lit(""))
