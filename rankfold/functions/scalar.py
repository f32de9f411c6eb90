"""Column-level helpers (JVM-side expressions only; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfold import fixed


def map_values(col: Column, mapping: dict, default=None) -> Column:
    """``CASE col WHEN k THEN v ... ELSE default END`` from a Python dict."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def clip01(x: Column) -> Column:
    """clip to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def interaction_weight(itype: Column) -> Column:
    """F2: interaction type -> strength weight, default 0.1."""
    return map_values(itype, fixed.INTERACTION_WEIGHTS, fixed.DEFAULT_WEIGHT).cast("double")


def rating_norm(value: Column) -> Column:
    """rating value on the 0..1 scale."""
    return value / F.lit(fixed.RATING_SCALE)


def rank_score(score: Column) -> Column:
    """Score used for ordering (T1 tie rule): rounded to 9 places."""
    return F.round(score, fixed.RANK_PLACES)


def out_score(score: Column) -> Column:
    return F.round(score, fixed.OUT_PLACES)


#: what the text of a number looks like: digits may be grouped by single underscores
_DIGITS = r"\d+(_\d+)*"
FLOAT_PATTERN = rf"(?i)^\s*[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?|nan|inf|infinity)\s*$"
#: date, any one character, time with optional parts, offset
ISO_PATTERN = (r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
               r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$")


def parse_double(x: Column) -> Column:
    """float parse, empty -> null, bad -> null (``bad_double`` tells them apart)."""
    return F.when(x.rlike(FLOAT_PATTERN), F.trim(F.replace(x, F.lit("_"), F.lit(""))).try_cast("double"))


def bad_double(x: Column) -> Column:
    """Whether a text is there and is no number."""
    return F.coalesce((x != "") & parse_double(x).isNull(), F.lit(False))


def parse_ts(x: Column) -> Column:
    """ISO date or date and time (basic or extended form, any separator, optional
    fraction cut to microseconds), an offset applied so that the result is UTC; empty ->
    null, bad -> null (``bad_ts`` tells them apart). Week dates are bad."""
    part = lambda k: F.regexp_extract(x, ISO_PATTERN, k)
    two = lambda k: F.when(part(k) == "", F.lit("00")).otherwise(part(k))
    frac = F.substring(F.concat(part(7), F.lit("000000")), 1, 6)
    local = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), two(4), F.lit(":"), two(5),
                     F.lit(":"), two(6), F.lit("."), frac).try_cast("timestamp_ntz")
    offset = F.replace(part(8), F.lit(":"), F.lit(""))
    size = lambda at: F.coalesce(F.substring(offset, at, 2).try_cast("int"), F.lit(0))
    seconds = F.when(offset.isin("", "Z"), F.lit(0)).otherwise(
        F.when(offset.startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * (size(2) * 3600 + size(4) * 60 + size(6)))
    whole = (size(2) < 24) & (size(4) < 60) & (size(6) < 60)
    return F.when(x.rlike(ISO_PATTERN) & whole, local - F.make_interval(secs=seconds))


def bad_ts(x: Column) -> Column:
    """Whether a text is there and is no time."""
    return F.coalesce((x != "") & parse_ts(x).isNull(), F.lit(False))


def json_object_or_empty(x: Column) -> Column:
    """Null JSON text -> '{}'."""
    return F.coalesce(x, F.lit("{}"))


def is_json_object(x: Column) -> Column:
    """True when the text parses as a JSON object (V1 / V2)."""
    return F.coalesce(
        F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))


def once(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once a row. A lambda that names an outer
    expression works it out again for every element, also when it was a column of an
    earlier select (selects are merged)."""
    return F.element_at(F.transform(F.array(value), fn), 1)
