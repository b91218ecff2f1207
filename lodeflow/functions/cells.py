"""Cell semantics as column expressions: trimming, title case, number and date readings of text, and the kind of a cell.

All are compositions of built-in functions. Coercions never throw, whatever the ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that trimming removes (U+0085 is not among it), as a character class's inside.
WHITE = "\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
#: Fixed value: decimal literals that count as numbers; 1d, inf and 1_000 are none.
DECIMAL = r"\A[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\z"
RADIX = r"\A0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)\z"
#: Dates other than ISO ones: a gate and a format, tried in this order.
DATE_FORMATS = (
    (r"\A[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z", "yyyy/M/d"),
    (r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", "M/d/yyyy"),
    (r"\A[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}\z", "d MMM yyyy"),
    (r"\A[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}\z", "MMM d, yyyy"),
)
ISO = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?\z"
ZONED = r"(Z|[+-][0-9]{2}:?[0-9]{2})\z"
#: How a CSV cell spells booleans.
TRUE, FALSE = ("true", "TRUE"), ("false", "FALSE")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def title_case(c: Column) -> Column:
    """In each run of non-space: what stands before the first of A-Z a-z 0-9 _ as it is, that one upper, the rest lower."""

    def one(run: Column) -> Column:
        lead = F.regexp_extract(run, r"(?s)\A([^A-Za-z0-9_]*)", 1)
        n = F.char_length(lead)
        return F.concat(lead, F.upper(F.substring(run, n + 1, F.lit(1))), F.lower(F.substring(run, n + 2, F.char_length(run))))

    runs = F.regexp_extract_all(c, F.lit(rf"[{WHITE}]+|[^{WHITE}]+"), F.lit(0))
    return F.array_join(F.transform(runs, one), "")


def _radix(t: Column) -> Column:
    base = F.when(F.lower(F.substring(t, 2, 1)) == "x", 16.0).when(F.lower(F.substring(t, 2, 1)) == "o", 8.0).otherwise(2.0)
    digits = F.filter(F.split(F.lower(F.substring(t, 3, 1 << 20)), ""), lambda d: d != "")
    return F.aggregate(digits, F.lit(0.0), lambda acc, d: acc * base + (F.instr(F.lit("0123456789abcdef"), d) - 1))


def text_number(c: Column) -> Column:
    """Text as a number: NaN if it is none, 0 for blank text, null for null."""
    plain = F.when(c.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), c.try_cast("double"))
    t = trim(c)
    value = F.when(t == "", 0.0).when(t.rlike(DECIMAL), t.try_cast("double")).when(t.rlike(RADIX), _radix(t)).otherwise(float("nan"))
    return F.when(c.isNotNull(), F.coalesce(plain, value))


def cell_number(c: Column, cells: bool = False) -> Column:
    """text_number of a text; with cells, true and false cells of a CSV file count 1 and 0."""
    if not cells:
        return text_number(c)
    return F.when(c.isin(*TRUE), 1.0).when(c.isin(*FALSE), 0.0).otherwise(text_number(c))


def number(c: Column, kind: T.DataType, cells: bool = False) -> Column:
    """A cell of any simple type as a number: null counts 0, true 1, false 0, text as cell_number reads it."""
    if isinstance(kind, T.StringType):
        value = cell_number(c, cells)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.unix_millis(c.cast("timestamp")).cast("double")
    else:
        value = c.cast("double")
    return F.coalesce(value, F.lit(0.0))


def text_date(c: Column) -> Column:
    """yyyy-MM-dd of text in one of the pinned formats (UTC; month first with slashes), else null."""
    from_iso = F.try_to_timestamp(c)
    shown = F.when(c.rlike(ZONED), F.to_utc_timestamp(from_iso, F.current_timezone())).otherwise(from_iso)
    found = F.when(c.rlike(ISO), shown)
    for gate, form in DATE_FORMATS:
        found = found.when(c.rlike(gate), F.try_to_timestamp(c, F.lit(form)))
    return F.date_format(found, "yyyy-MM-dd")


def text_kind(c: Column) -> Column:
    """What a text cell holds: null, boolean, number, datetime or string. (The grammar of the usual CSV typing, assumed.)"""
    plain = r"\A[ ]*-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ ]*\z"
    big = F.abs(c.try_cast("double")) > 2.0**53
    moment = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
    return (
        F.when(c.isNull() | (c == ""), F.lit("null"))
        .when(c.isin(*TRUE, *FALSE), F.lit("boolean"))
        .when(c.rlike(plain) & ~F.coalesce(big, F.lit(True)), F.lit("number"))
        .when(c.rlike(moment), F.lit("datetime"))
        .otherwise(F.lit("string"))
    )


def cell_key(c: Column, kind: T.DataType, cells: bool = False) -> Column:
    """(kind, value) of a cell, null for a missing one: what makes two cells equal. A number never equals its own text.

    With cells, a text column holds CSV cells, each of the kind that it reads as: 1 and 1.0 are one number there.
    """
    if isinstance(kind, T.NumericType):
        name, value = F.lit("number"), c.cast("double").cast("string")
        if not isinstance(kind, (T.DoubleType, T.FloatType)):
            # whole and decimal numbers that a double would round are keys of their own; no CSV cell is one
            value = F.when(c.cast("double").try_cast("decimal(38,18)") == c.try_cast("decimal(38,18)"), value).otherwise(c.cast("string"))
    elif isinstance(kind, T.StringType) and cells:
        own = text_kind(c)
        name = F.when(own == "string", F.lit("text")).when(own != "null", own)
        value = F.when(own == "number", (F.trim(c).try_cast("double") + 0.0).cast("string")).when(own == "boolean", F.lower(c)).otherwise(c)
    else:
        name = F.lit("boolean" if isinstance(kind, T.BooleanType) else "text" if isinstance(kind, T.StringType) else kind.simpleString())
        value = c.cast("string")
    return F.when(name.isNotNull() & c.isNotNull(), F.struct(name.alias("kind"), value.alias("value")))


def label(c: Column, kind: T.DataType) -> Column:
    """A key as shown on a chart: null as text, whole doubles without a fraction."""
    shown = c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(20,0)").cast("string")).otherwise(shown)
    return F.coalesce(shown, F.lit("null"))
