"""Native column functions: dates, times, seats, names, stations, payloads and colours.

All take and return Columns; none uses Python on the executors. Patterns that queries share with SQL oracles
avoid look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def _group(text: Column, pattern: str, k: int) -> Column:
    """A capture group, null where it did not match or is empty."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """The date of a year, month and day that rolls over: 30 February is 1 or 2 March."""
    ok = year.between(1, 9998) & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, F.date_add(F.make_date(F.when(ok, year).otherwise(2000), F.when(ok, month).otherwise(1), F.lit(1)), F.when(ok, day).otherwise(1) - 1))


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _first(text: Column, patterns: list[str], fn) -> Column:
    """``fn(k, match)`` of the first pattern with a match; a later one is tried only where those before have none."""
    if not patterns:
        return F.lit(None)
    at = lambda k, m: F.when(m != "", fn(k, m)).otherwise(rest(k + 1)) if k + 1 < len(patterns) else F.when(m != "", fn(k, m))
    rest = lambda k: bound(F.regexp_extract(text, patterns[k], 0), lambda m: at(k, m))
    return rest(0)


# -- fixed values: shapes of a clock time, in the order they are tried --------------------------------------------
TIMES = [
    r"\b[0-9]{1,2}\s*[:.h]\s*[0-9]{2}(?::[0-9]{2})?\s*(?:a\.?m\.?|p\.?m\.?)?",
    r"\b[0-9]{3,4}\s*(?:hrs?|hours)\b",
    r"\b[0-9]{1,2}[\s.]?[0-9]{2}\s*(?:a\.?m\.?|p\.?m\.?)",
]
# ---------------------------------------------------------------------------------------------------------------


def parse_time(text: Column) -> Column:
    """HH:MM of the first clock time in a text: with a separator (seconds are allowed and dropped), else digits
    before hrs, else digits before am or pm. Null where there is none or it is out of range."""

    def clock(k: int, m: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(m, r"^([0-9]+\s*[:.h]\s*[0-9]{2}):[0-9]{2}", "$1") if k == 0 else m, "[^0-9]", "")
        half = F.when(m.contains("p"), "p").when(m.contains("a"), "a") if k != 1 else F.lit(None).cast("string")
        return F.struct(digits.alias("digits"), half.alias("half"))

    def written(found: Column) -> Column:
        hour, minute = F.substring(found["digits"], F.lit(1), F.length(found["digits"]) - 2).cast("int"), F.right(found["digits"], F.lit(2)).cast("int")
        hour24 = F.when((found["half"] == "p") & (hour < 12), hour + 12).when((found["half"] == "a") & (hour == 12), F.lit(0)).otherwise(hour)
        return F.when((hour24 <= 23) & (minute <= 59), F.concat(F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))

    return bound(_first(F.lower(text), TIMES, clock), written)


# -- fixed values: shapes of a date, in the order they are tried --------------------------------------------------
DATES = [
    r"(?:^|[^0-9])([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[^0-9]|$)",
    rf"(?:^|[^0-9a-z])([0-9]{{1,2}})(?:st|nd|rd|th)?[\s,./-]*{_MONTH}[\s,./'-]*([0-9]{{4}}|[0-9]{{2}})?",
    rf"(?:^|[^a-z]){_MONTH}[\s./-]*([0-9]{{1,2}})(?:st|nd|rd|th)?(?:[\s,./'-]+([0-9]{{4}}))?",
    r"(?:^|[^0-9])([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})(?:[^0-9]|$)",
]
# ---------------------------------------------------------------------------------------------------------------


def parse_date(text: Column, reference: Column) -> Column:
    """struct<date, ambiguous, candidates, had_year> of the first date in a text.

    ISO first, then day-first with a named month, month-first with one, then numbers. Numbers that are both
    at most 12, or both above, are ambiguous and have two candidates and no date. A missing year is the
    reference's; two digits are after 2000.
    """
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit(False).alias("ambiguous"), F.expr("cast(array() as array<date>)").alias("candidates"), F.lit(False).alias("had_year"))
    # a pattern searches the text once; its groups are read from the match
    groups = lambda k, m: F.struct(*(_group(m, DATES[k], g).alias(f"g{g}") for g in (1, 2, 3)))
    return F.coalesce(_first(F.lower(text), DATES, lambda k, m: bound(groups(k, m), lambda g: _dated(k, g, F.year(reference)))), none)


def _dated(k: int, g: Column, now: Column) -> Column:
    """parse_date's answer for the groups of one shape."""
    year_of = lambda y: F.when(F.length(y) == 2, y.cast("int") + 2000).otherwise(y.cast("int"))
    month_of = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("int")
    one, two, three = g["g1"], g["g2"], g["g3"]
    made = lambda date, had, unsure=F.lit(False), both=F.expr("cast(array() as array<date>)"): F.struct(date.alias("date"), unsure.alias("ambiguous"), both.alias("candidates"), had.alias("had_year"))
    if k == 0:
        return made(rolled_date(one.cast("int"), two.cast("int"), three.cast("int")), F.lit(True))
    if k == 1:
        return made(rolled_date(F.coalesce(year_of(three), now), month_of(two), one.cast("int")), three.isNotNull())
    if k == 2:
        return made(rolled_date(F.coalesce(three.cast("int"), now), month_of(one), two.cast("int")), three.isNotNull())
    a, b, year = one.cast("int"), two.cast("int"), year_of(three)
    unsure = F.when((a <= 12) == (b <= 12), True).otherwise(False)
    exact = F.when(~unsure, F.when(a > 12, rolled_date(year, b, a)).otherwise(rolled_date(year, a, b)))
    both = F.array_compact(F.array(rolled_date(year, b, a), rolled_date(year, a, b)))
    return made(exact, F.lit(True), unsure, F.when(unsure, both).otherwise(F.expr("cast(array() as array<date>)")))


def wallet_date(date: Column, time: Column, offset_minutes: Column | None = None) -> Column:
    """ISO date and time with offset; a missing time is 00:00, a missing offset Z."""
    clock = F.coalesce(time, F.lit("00:00"))
    if offset_minutes is None:
        zone = F.lit("Z")
    else:
        size = F.abs(offset_minutes)
        zone = F.coalesce(F.format_string("%s%02d:%02d", F.when(offset_minutes < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), (size % 60).cast("int")), F.lit("Z"))
    return F.when(date.isNotNull(), F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T"), clock, F.lit(":00"), zone))


def offset_minutes(instant: Column, zone: Column) -> Column:
    """Minutes that a zone is ahead of UTC at an instant, with daylight saving."""
    return ((F.unix_timestamp(F.from_utc_timestamp(instant, zone)) - F.unix_timestamp(instant)) / 60).cast("int")


def resolve_julian(day: Column, reference: Column, year_hint: Column | None = None) -> Column:
    """struct<date, confidence> of a day of the year near a reference date.

    The nearest of the years around the reference; of equally near ones the earlier. Day 366 needs a leap
    year. Within 60 days is high, 150 medium, else low; with a year hint, that year and high.
    """
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    made = lambda y: F.when(day.between(1, 366) & ((day < 366) | leap(y)), F.date_add(F.make_date(y, F.lit(1), F.lit(1)), F.when(day.between(1, 366), day).otherwise(1).cast("int") - 1))
    candidate = lambda d: F.struct(F.abs(F.datediff(d, reference)).alias("gap"), d.alias("date"))
    options = F.filter(F.array(*(candidate(made(F.year(reference) + k)) for k in (-1, 0, 1))), lambda c: c["date"].isNotNull())
    best = F.array_min(options)
    near = F.struct(best["date"].alias("date"), F.when(best["gap"] <= 60, "high").when(best["gap"] <= 150, "medium").when(best["gap"].isNotNull(), "low").alias("confidence"))
    if year_hint is None:
        return near
    hinted = made(year_hint)
    return F.when(hinted.isNotNull(), F.struct(hinted.alias("date"), F.lit("high").alias("confidence"))).otherwise(near)


def resolve_issue_date(text: Column, reference: Column) -> Column:
    """Date of a year digit and a day of the year: the year with that digit nearest to the reference."""
    digit, day = _group(text, r"^([0-9])([0-9]{3})$", 1).cast("int"), _group(text, r"^([0-9])([0-9]{3})$", 2).cast("int")
    near = F.array_min(F.transform(F.array(F.lit(-10), F.lit(0), F.lit(10)), lambda k: F.struct(F.abs((F.year(reference) - F.year(reference) % 10) + digit + k - F.year(reference)).alias("gap"), ((F.year(reference) - F.year(reference) % 10) + digit + k).alias("year"))))
    return F.when(day.between(1, 366), F.date_add(F.make_date(near["year"], F.lit(1), F.lit(1)), F.when(day.between(1, 366), day).otherwise(1) - 1))


def normalise_flight_number(text: Column) -> Column:
    """Digits without leading zeros, with an operational suffix letter."""
    return F.nullif(F.concat(F.regexp_extract(F.trim(text), r"^0*([0-9]+)([A-Za-z]?)$", 1), F.upper(F.regexp_extract(F.trim(text), r"^0*([0-9]+)([A-Za-z]?)$", 2))), F.lit(""))


def normalise_seat(text: Column) -> Column:
    """A seat without leading zeros; INF... is an infant without one."""
    t = F.upper(F.trim(text))
    return F.when(t.startswith("INF"), F.lit("Infant")).otherwise(F.nullif(F.regexp_replace(t, r"^0+([0-9]+[A-Z]?)$", "$1"), F.lit("")))


def clean_seat(text: Column) -> Column:
    """Row 1 to 99 and a letter."""
    p = r"(?:^|[^0-9A-Z])0*([1-9][0-9]?)\s*-?\s*([A-L])(?:[^0-9A-Z]|$)"
    t = F.upper(text)
    return F.nullif(F.concat(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)), F.lit(""))


def clean_terminal(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.coalesce(_group(t, r"^(?:TERMINAL|T)[\s:-]*([0-9]{1,2}[A-Z]?|[A-Z])$", 1), _group(t, r"^([0-9]{1,2}[A-Z]?|[A-Z])$", 1))


def airport_code(text: Column) -> Column:
    """A bracketed code of three capitals, or one that stands alone."""
    return F.coalesce(_group(text, r"\(([A-Z]{3})\)", 1), _group(text, r"^\s*([A-Z]{3})\s*$", 1), _group(text, r"(?:^|[^A-Za-z])([A-Z]{3})(?:[^A-Za-z]|$)", 1))


def parse_station(text: Column) -> Column:
    """struct<name, code> of ``NAME (CODE)``, ``CODE - NAME``, ``NAME - CODE`` or a plain name."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    paren, front, back = r"^(.*?)\s*\(([A-Z]{2,5})\)", r"^([A-Z]{2,5})\s+-\s+(.+)$", r"^(.+?)\s+-\s+([A-Z]{2,5})$"
    is_paren, is_front, is_back = (_group(t, p, 2).isNotNull() for p in (paren, front, back))
    name = F.when(is_paren, F.regexp_extract(t, paren, 1)).when(is_front, F.regexp_extract(t, front, 2)).when(is_back, F.regexp_extract(t, back, 1)).otherwise(t)
    code = F.when(is_paren, F.regexp_extract(t, paren, 2)).when(is_front, F.regexp_extract(t, front, 1)).when(is_back, F.regexp_extract(t, back, 2))
    return F.struct(tidy_name(name).alias("name"), code.alias("code"))


def tidy_name(text: Column) -> Column:
    """Words of capitals become capitalised; words of up to three capitals stay as they are."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z]{4,}$"), F.initcap(w)).otherwise(w)), " ")


def tidy_provider(text: Column) -> Column:
    """A name in capitals gets capitals at the beginnings of words; six characters at most, words of four at most, and names in mixed case stay."""
    t = F.trim(text)
    words = F.transform(F.filter(F.split(t, r"\s+"), lambda w: w != ""), lambda w: F.when(F.length(w) <= 4, w).otherwise(F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1000)))))
    return F.when((F.length(t) <= 6) | t.rlike("[a-z]"), t).otherwise(F.array_join(words, " "))


def first_column(text: Column, limit: int = 48) -> Column:
    """What stands before two spaces or a bar, cut to a length."""
    return F.trim(F.substring(F.get(F.split(F.trim(text), r"\s{2,}|\|"), F.lit(0)), 1, limit))


# -- fixed values: senders that name no one, mail services, and labels of mail hosts ------------------------------
NO_ONE = r"(?i)^(no[\s-]?reply|do[\s-]?not[\s-]?reply|bookings?|tickets?|info|support|noreply|customer\s*care)$"
WEBMAIL = r"(?i)^(gmail|outlook|hotmail|yahoo|icloud|proton|me|live|msn)\."
MAIL_LABELS = ("email", "mail", "e", "mailer", "notify", "notifications", "send", "smtp", "www", "m")
# ---------------------------------------------------------------------------------------------------------------


def provider_from_sender(name: Column, domain: Column) -> Column:
    """A provider's name from a sender: its display name (without "via ...") unless it names no one, else the main label of its domain."""
    shown = F.trim(F.regexp_replace(F.trim(name), r"(?i)\s*(via|through)\s+.*$", ""))
    usable = F.coalesce(~F.trim(name).rlike(NO_ONE) & F.length(shown).between(2, 40), F.lit(False))
    labels = F.split(F.lower(domain), r"\.")
    own = F.filter(labels, lambda x: ~x.isin(*MAIL_LABELS))
    core = F.when(F.size(own) > 1, F.get(own, F.lit(0))).otherwise(F.get(labels, F.lit(0)))
    label = F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 1000))
    return F.when(usable, shown).when(domain.isNotNull() & ~domain.rlike(WEBMAIL) & (F.length(core) >= 2), label)


def email_domain(text: Column) -> Column:
    """The domain of the first address in a text."""
    return F.lower(_group(text, r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1))


def departure_timestamp(fields: Column) -> Column:
    """Epoch milliseconds (UTC) of a record's fields, by date and the first of its times, else midnight."""
    date, clock = fields["date"], F.coalesce(fields["departureTime"], fields["startTime"], fields["boardingTime"], fields["time"], F.lit("00:00"))
    at = F.try_to_timestamp(F.concat(date, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(F.year(at).between(1990, 2100), F.unix_millis(at))


def next_label(departs: Column, now: Column) -> Column:
    """A relative time in words, of epoch milliseconds."""
    minutes = F.floor((departs - now) / 60000)
    days = F.datediff(F.timestamp_millis(departs), F.timestamp_millis(now))
    return (
        F.when(departs.isNull(), F.lit(None).cast("string"))
        .when(minutes < 0, F.lit("under way"))
        .when(minutes < 60, F.concat(F.lit("in "), minutes.cast("string"), F.lit(" min")))
        .when(minutes < 1440, F.concat(F.lit("in "), F.floor(minutes / 60).cast("string"), F.lit(" h")))
        .when(days == 1, F.lit("tomorrow"))
        .otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))
    )


def format_date(iso: Column) -> Column:
    """Day and month of an ISO date, as ``5 May``; empty for null, and a text that is no date as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "d MMM"), iso, F.lit(""))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, 0), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / 1048576, 1), F.lit(" MB")))


def looks_like_caption(text: Column) -> Column:
    """A colon at the end, or two to four words of letters of 30 characters at most, without a digit."""
    t = F.trim(text)
    return F.when(t.endswith(":"), True).when(t.rlike("[0-9]"), False).otherwise((F.length(t) <= 30) & t.rlike(r"^[A-Za-z]+(?: [A-Za-z./&]+){1,3}$"))


def looks_like_message(text: Column) -> Column:
    """Two or more known headers before the first blank line, and nothing else there; or an mbox line."""
    head = F.slice(F.split(F.substring(text, 1, 4000), "\r?\n"), 1, 40)
    blank = F.array_position(F.transform(head, lambda x: F.trim(x) == ""), True)
    lines = F.when(blank > 0, F.slice(head, 1, (F.greatest(blank, F.lit(1)) - 1).cast("int"))).otherwise(head)
    known = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^(?:from|to|cc|subject|date|message-id|mime-version|content-type|content-transfer-encoding|received|return-path|reply-to|delivered-to|dkim-signature)\s*:")))
    odd = F.size(F.filter(lines, lambda x: ~x.rlike(r"^[A-Za-z0-9-]+\s*:|^[ \t]")))
    return F.coalesce(F.substring(text, 1, 5) == "From ", F.lit(False)) | F.coalesce((known >= 2) & (odd == 0), F.lit(False))


def looks_like_html(text: Column) -> Column:
    """A tag of a page's beginning, before anything else."""
    tags = ("!doctype html", "html", "body", "table", "div", "meta", "span", r"p[\s>]")
    return F.substring(text, 1, 2000).rlike(rf"(?i)^\s*<(?:{'|'.join(tags)})")


def fnv_hash(text: Column) -> Column:
    """32-bit FNV-1a of a text's code points, as the absolute value of a signed integer."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)
    return F.abs(F.when(h >= F.lit(1 << 31), h - F.lit(1 << 32)).otherwise(h))


def _channels(rgb: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(rgb, 16).bitwiseAND(255), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


def luminance(rgb: Column) -> Column:
    """Relative luminance of 0xRRGGBB."""
    one = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = map(one, _channels(rgb))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def colour_distance(a: Column, b: Column) -> Column:
    """Weighted distance, 2, 4 and 3 for red, green and blue."""
    (r, g, bl), (s, h, c) = _channels(a), _channels(b)
    return F.sqrt((2 * (r - s) * (r - s) + 4 * (g - h) * (g - h) + 3 * (bl - c) * (bl - c)).cast("double"))


def saturation(rgb: Column) -> Column:
    parts = _channels(rgb)
    high, low = F.greatest(*parts), F.least(*parts)
    return F.when(high == 0, F.lit(0.0)).otherwise((high - low) / high)


def is_neutral(rgb: Column, threshold: float = 0.22) -> Column:
    """Greys, black and white."""
    return saturation(rgb) < threshold


def upper_median(name: str) -> Column:
    """Aggregate of a column: of two middle values the upper one."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def ensure_readable(rgb: Column, least: float = 4.5, steps: int = 24) -> Column:
    """Darken a background by 8 % a step until white text on it has the contrast."""
    darker = lambda c: sum((F.floor(x * 0.92).cast("int") * k for x, k in zip(_channels(c), (65536, 256, 1), strict=True)), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), rgb.cast("int"), lambda c, _: F.when(contrast(c, F.lit(0xFFFFFF)) >= least, c).otherwise(darker(c)))


def from_hsl(hue: Column, saturation: Column, lightness: Column) -> Column:
    """0xRRGGBB of a hue in degrees and two shares."""
    a = saturation * F.least(lightness, 1 - lightness)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue / 30.0, F.lit(12.0))
        return F.round(255 * (lightness - a * F.greatest(F.lit(-1.0), F.least(F.least(k - 3, 9 - k), F.lit(1.0))))).cast("int")

    return channel(0) * 65536 + channel(8) * 256 + channel(4)


def palette(text: Column) -> Column:
    """struct<background, accent, foreground> of a name: the hue is its hash, the background is made readable."""
    h = fnv_hash(F.lower(F.trim(text)))
    hue = (h % 360).cast("double")
    background = ensure_readable(from_hsl(hue, F.lit(0.45), F.lit(0.34)))
    accent = from_hsl(F.pmod(hue + 35 + (F.floor(h / 360) % 40), F.lit(360.0)), F.lit(0.7), F.lit(0.6))
    return F.struct(background.alias("background"), accent.alias("accent"), F.lit(0xFFFFFF).alias("foreground"))
