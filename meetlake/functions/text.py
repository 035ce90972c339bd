"""Column expressions on tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINATOR = r"[.!?…][\"'»)\]} ]*$"
BOUNDARY = r"[.!?…,:;—–-]$"
DASH_FIRST = r"^[\"'«(\[ ]*[—–]"


def norm(text: str | Column) -> Column:
    """Lower case, ё as е, letters, digits and inner hyphens only; plain words need no more than lower case."""
    own = F.col(text) if isinstance(text, str) else text
    c = F.translate(F.lower(own), "ё", "е")
    return F.when(own.rlike(r"^[A-Za-z0-9]+\z"), F.lower(own)).otherwise(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}-]+", ""), "^-+|-+$", ""))


def match_key(text: str | Column) -> Column:
    return F.replace(norm(text), F.lit("-"), F.lit(""))


def terminates(text: str | Column) -> Column:
    return F.col(text).rlike(TERMINATOR) if isinstance(text, str) else text.rlike(TERMINATOR)


def thought_boundary(text: Column, following: Column) -> Column:
    return text.rlike(BOUNDARY) | F.coalesce(following.rlike(DASH_FIRST), F.lit(False))


def timecode(seconds: Column) -> Column:
    """m:ss or h:mm:ss of whole seconds."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", two(m), two(s)))


def filler_label(n: Column, dictionary: list[tuple[str, str]]) -> Column:
    """Label of the first pattern that a norm matches."""
    key = F.replace(n, F.lit("-"), F.lit(""))
    first = F.coalesce(*(F.when(key.rlike(p), F.lit(label)) for p, label in dictionary))
    return F.when(key.rlike("|".join(f"(?:{p})" for p, _ in dictionary)), first)


def short_title(text: Column, limit: int = 60) -> Column:
    """White space as one space; beyond the limit cut at the last space before it, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \n\t\r]+", " "))
    head = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    return F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def parse_timecode(c: Column) -> Column:
    """Seconds of 83, 83,5, 1:23, [01:23] or 1:02:03; 0 for anything else."""
    parts = F.transform(F.split(F.translate(F.trim(F.translate(c, "[]()", "")), ",", "."), ":"), lambda x: F.trim(x).try_cast("double"))
    whole = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(c.isNull() | F.exists(parts, lambda x: x.isNull()), 0.0).otherwise(whole)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")


def as_enum(c: Column, names: list[str], aliases: dict[str, str], fallback: str) -> Column:
    """The name that a loose value means: itself, an alias, else the fallback."""
    own = slug(c)
    known = F.when(own.isin(names), own)
    for alias, name in aliases.items():
        known = known.when(own == alias, name)
    return known.otherwise(fallback)


def json_block(c: Column) -> Column:
    """JSON in a reply: the inside of a fence, else from the first { to the last }; null without either."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))


def seconds_label(ms: Column, unit: str = "s", comma: str = ",") -> Column:
    """Tenths of a second, ties to even, with a decimal comma."""
    tenths = F.rint(F.abs(ms) / 100).cast("long")
    return F.concat(F.when((ms < 0) & (tenths > 0), "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit(comma), (tenths % 10).cast("string"), F.lit(" " + unit))


def range_label(low: Column, high: Column) -> Column:
    """A reference range as text: 100-130, up to 2, from 4, or a dash without bounds."""
    text = lambda c: F.regexp_replace(c.cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
    return F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("–", text(low), text(high))).when(high.isNotNull(), F.concat(F.lit("≤ "), text(high))).when(low.isNotNull(), F.concat(F.lit("≥ "), text(low))).otherwise("—")


def number(c: Column, digits: int = 1) -> Column:
    """A number with a decimal comma, a true minus and no zeros at its end; a dash for null and what is not finite."""
    plain = F.regexp_replace(c.cast(f"decimal(30,{digits})").cast("string"), r"\.?0+$" if digits else "$^", "")
    plain = F.regexp_replace(F.translate(F.when(plain.isin("-0", "0", "-", ""), "0").otherwise(plain), ".", ","), "^-", "−")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "—").otherwise(plain)


def signed(c: Column, digits: int = 1) -> Column:
    """number() with its sign; a plain 0 below half of the last digit."""
    small = F.abs(c) < 10.0**-digits / 2
    return F.when(c.isNull() | F.isnan(c), "—").when(small, "0").otherwise(F.concat(F.when(c > 0, "+").otherwise("−"), number(F.abs(c), digits)))


def percent(c: Column, digits: int = 0) -> Column:
    return F.when(c.isNull() | F.isnan(c), "—").otherwise(F.concat(number(c * 100, digits), F.lit(" %")))


def duration_words(seconds: Column, s: str = "s", m: str = "min", h: str = "h") -> Column:
    """'62 s' below two minutes, then whole minutes, then hours and minutes of two digits."""
    minutes = F.floor(seconds / 60 + 0.5)
    long_ = F.concat(F.floor(minutes / 60).cast("string"), F.lit(f" {h} "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(f" {m}"))
    short = F.when(seconds < 120, F.concat(F.floor(seconds + 0.5).cast("string"), F.lit(f" {s}"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(f" {m}"))).otherwise(long_)
    return F.when(seconds.isNull(), "—").otherwise(short)


def rounded_timecode(seconds: Column) -> Column:
    """timecode() of the nearest second."""
    return timecode(F.greatest(F.floor(seconds + 0.5), F.lit(0)))


def day_label(day: Column, today: str, words: tuple[str, str] = ("today", "yesterday")) -> Column:
    """Today, yesterday, the weekday within a week, else day and month, with the year of other years."""
    ago = F.datediff(F.lit(today).cast("date"), day)
    date = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.date_format(day, "MMMM"))
    date = F.when(F.year(day) == F.year(F.lit(today).cast("date")), date).otherwise(F.concat(date, F.lit(" "), F.year(day).cast("string")))
    return F.when(ago == 0, words[0]).when(ago == 1, words[1]).when(ago.between(2, 6), F.date_format(day, "EEEE")).otherwise(date)


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced; a placeholder without a value is an error when the query is built, a null value one when it runs."""
    import re

    names = re.findall(r"\{(\w+)\}", template)
    if missing := [n for n in names if n not in values]:
        raise KeyError(f"no value for {', '.join(missing)}")
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        own = values[piece].cast("string") if i % 2 else None
        parts.append(F.lit(piece) if own is None else F.coalesce(own, F.raise_error(F.lit(f"{piece} is null"))))
    return F.concat(*parts)
