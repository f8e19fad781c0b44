"""Scalar column functions: Column -> Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.split() treat as
# whitespace, as a Java regex character class.
PY_WS_CLASS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
# Labels and placeholders used by the reports.
DASH = "—"
GUEST_FIRST, GUEST_LAST = "Guest", "Customer"
YES, NO = "Yes", "No"
OPEN, CLOSED = "Open", "Closed"
NOT_AVAILABLE = "N/A"
DISPLAY_PATTERN = "yyyy-MM-dd HH:mm:ss"
# Patterns a display layer treats as date-like text.
DATELIKE_T = r"^\d{4}-\d{2}-\d{2}T"
DATELIKE_SPACE = r"^\d{4}-\d{2}-\d{2} "
CUSTOMER_ID_PATTERN = r"^C(\d+)$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_name(first, last) -> Column:
    """G1: null-propagating ``first || ' ' || last``."""
    return F.concat(col(first), F.lit(" "), col(last))


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace as Python's ``str.strip()``."""
    return F.regexp_replace(col(c), f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")


def blank_to_null(c) -> Column:
    """``(x or '').strip()`` as a nullable column: null when missing or blank."""
    s = py_strip(col(c))
    return F.when(s != "", s)


def split_full_name(c) -> Column:
    """struct(first, last) from a full name; blank -> Guest Customer,
    one word -> <word> Customer, else split at the first whitespace run."""
    return split_stripped(F.coalesce(py_strip(col(c)), F.lit("")))


def split_stripped(s: Column) -> Column:
    """G4 on text already stripped and not null (stage the strip as its own
    column when the input is an expensive expression)."""
    parts = F.split(s, f"{PY_WS_CLASS}+", 2)
    first = F.when(s == "", F.lit(GUEST_FIRST)).otherwise(parts.getItem(0))
    last = (F.when(s == "", F.lit(GUEST_LAST))
            .when(F.size(parts) < 2, F.lit(GUEST_LAST))
            .otherwise(parts.getItem(1)))
    return F.struct(first.alias("firstname"), last.alias("lastname"))


def choose_name(first, last, full) -> Column:
    """Use first/last when either is given (blank one -> Guest/Customer),
    else parse the full name."""
    f, l = blank_to_null(first), blank_to_null(last)
    parsed = split_full_name(full)
    given = f.isNotNull() | l.isNotNull()
    return F.struct(
        F.when(given, F.coalesce(f, F.lit(GUEST_FIRST))).otherwise(parsed["firstname"]).alias("firstname"),
        F.when(given, F.coalesce(l, F.lit(GUEST_LAST))).otherwise(parsed["lastname"]).alias("lastname"),
    )


def yes_no(c) -> Column:
    """Boolean flag as Yes/No."""
    return F.when(col(c), F.lit(YES)).otherwise(F.lit(NO))


def open_closed(c) -> Column:
    return F.when(col(c), F.lit(OPEN)).otherwise(F.lit(CLOSED))


def or_dash(c) -> Column:
    """Null or empty text -> dash (no trimming, as ``x or '—'``)."""
    return F.when(col(c).isNull() | (col(c) == ""), F.lit(DASH)).otherwise(col(c))


def sort_seconds(c) -> Column:
    """Ordering key of a date-time at whole seconds (fractions tie)."""
    return F.date_trunc("second", col(c)).cast("timestamp_ntz")


def parse_datetime(c) -> Column:
    """ISO text -> timestamp_ntz, unparsable -> null."""
    return col(c).try_cast("timestamp_ntz")


def is_datelike(c) -> Column:
    """Text a display layer would try to format as a date-time."""
    t = col(c)
    return (t.rlike(DATELIKE_T) | t.rlike(DATELIKE_SPACE)
            | (F.instr(t, "T") > 0) & (F.length(t) >= 19))


def display_cell(c) -> Column:
    """G14 in a table cell: null -> dash; date-like text that parses -> fixed
    pattern; everything else, the empty text and a date alone included, passes through."""
    t = col(c)
    parsed = parse_datetime(t)
    return (F.when(t.isNull(), F.lit(DASH))
            .when(is_datelike(t) & parsed.isNotNull(), F.date_format(parsed, DISPLAY_PATTERN))
            .otherwise(t))


def display_datetime(c) -> Column:
    """G14 on dashboard and order pages: text that parses as a date or date-time
    -> fixed pattern; everything else passes through, with no dash."""
    t = col(c)
    return F.coalesce(F.date_format(parse_datetime(t), DISPLAY_PATTERN), t)


def customer_id_number(c) -> Column:
    """Numeric suffix of ``C<digits>`` ids; null for other ids."""
    digits = F.regexp_extract(col(c), CUSTOMER_ID_PATTERN, 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def customer_id_text(n) -> Column:
    """``C%03d`` -- three digits at least, growing past C999."""
    return F.format_string("C%03d", col(n).cast("bigint"))


def money_text(c) -> Column:
    """Two-decimal money text of a DECIMAL(10,2) value."""
    return col(c).cast("decimal(10,2)").cast("string")


def label(*parts) -> Column:
    """Label templates via null-propagating concat."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
