"""Scalar operators over loosely typed customer text.

Each function maps Columns to a Column made only of built-in expressions,
so Catalyst can fold, push down and code-generate them.  The text semantics
follow the dashboard's pandas code: ``astype(str)`` turns a null into the
text ``None``, ``str.strip()`` removes Unicode whitespace, and
``to_numeric(errors='coerce')`` accepts plain decimal numbers only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

__all__ = [
    "col_or", "ustrip", "urstrip", "as_text", "norm_token", "to_number",
    "parse_ts", "format_date", "format_dates", "format_reminder",
    "is_meaningful", "clean_display", "format_phone", "normalize_city",
    "last_note_ts", "warranty_label", "warranty_status", "goal_progress",
    "goal_met", "customer_tooltip", "log_tooltip", "map_hover", "geo_jitter",
    "station_name", "note_line", "current_year",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def col_or(df: DataFrame, name: str, default=None) -> Column:
    """``safe_col``: the column when it exists, else a constant."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def ustrip(c) -> Column:
    """Python ``str.strip()``: trims Unicode whitespace (Spark's one-argument
    ``trim`` only trims spaces).  A character-set trim, no regex."""
    return F.btrim(_c(c), F.lit(K.WS_CHARS))


def urstrip(c) -> Column:
    """Python ``str.rstrip()``."""
    return F.rtrim(_c(c), F.lit(K.WS_CHARS))


def as_text(c) -> Column:
    """pandas ``astype(str)`` on an object column: null becomes 'None'."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def norm_token(c) -> Column:
    """to text -> strip -> lower."""
    return F.lower(ustrip(as_text(c)))


def to_number(c, default=None) -> Column:
    """Numeric text to double; anything else (junk, NaN text, null,
    overflow) to ``default``, as pandas.to_numeric(errors='coerce').  The
    guard regex keeps Spark's wider cast rules ('1d', padded 'inf') out.
    Literals beyond ~1e22 may differ from pandas in the last binary digit
    (Spark rounds correctly, pandas' fast parser does not)."""
    c = _c(c).cast("string")
    num = F.when(c.rlike(K.NUMERIC_PATTERN), F.trim(c).try_cast("double"))
    # a finite literal that overflows is not a number for pandas (Spark
    # would give +-Infinity); only the inf/infinity words give infinities
    num = F.when(~(F.abs(num) == F.lit(float("inf"))) | F.lower(c).contains("inf"), num)
    if default is None:
        return num
    if not isinstance(default, Column):
        default = F.lit(float(default))
    return F.coalesce(num, default.cast("double"))


def _shape(fmt: str) -> str:
    """Regex of the text shape a datetime pattern parses ('yyyy' -> 4
    digits, other letters -> 2 digits, quoted text literally)."""
    out, i = [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        run = len(fmt[i:]) - len(fmt[i:].lstrip(ch))
        out.append(r"\d{%d}" % (4 if ch == "y" else run) if ch.isalpha() else re.escape(ch * run))
        i += run
    return "(?i)^" + "".join(out) + "$"


def parse_ts(c, formats=None) -> Column:
    """Text to TIMESTAMP_NTZ using the format whose shape the value has;
    unparsable -> null.  The shape test runs first, so each value is parsed
    at most once (a failed parse attempt is far more costly than a regex
    test)."""
    formats = formats or K.DATE_FORMATS
    c = _c(c).cast("string")
    return F.coalesce(
        *[F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats]
    ).cast("timestamp_ntz")


def format_date(c) -> Column:
    """Date text -> 'dd-MM-yyyy', unparsable or null -> '-'."""
    return F.coalesce(F.date_format(parse_ts(c), K.DISPLAY_DATE_FORMAT), F.lit("-"))


def format_dates(df: DataFrame,
                 columns=("action_date", "birth_date", "last_service_date")) -> DataFrame:
    """Reformat the date columns that exist; others are left alone."""
    present = {c: format_date(c) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def format_reminder(c) -> Column:
    """'yyyy-MM-ddTHH:mm' -> 'dd-MM-yyyy HH:mm'."""
    return F.date_format(parse_ts(F.replace(_c(c), F.lit("T"), F.lit(" "))),
                         K.DISPLAY_REMINDER_FORMAT)


def is_meaningful(c, reject_dash: bool = True) -> Column:
    """Not null, not '-', not blank, not the text 'nan'."""
    c = _c(c)
    cond = c.isNotNull() & (ustrip(c) != "") & (F.lower(c) != "nan")
    if reject_dash:
        cond = cond & (c != "-")
    return cond


def clean_display(c) -> Column:
    """Profile field cleanup: midnight timestamps lose their time part;
    empty / none / nan / nat become '-'."""
    d = ustrip(as_text(c))
    return (
        F.when(d.contains("00:00:00"), F.substring_index(d, " ", 1))
        .when((d == "") | F.lower(d).isin("none", "nan", "nat"), F.lit("-"))
        .otherwise(d)
    )


def format_phone(c) -> Column:
    """Turkish phone layout '0 ddd ddd dd dd' when the digits allow it,
    else the original text; blank -> '-'."""
    c = _c(c).cast("string")
    digits = F.regexp_replace(c, r"(?U)\D", "")
    n = F.length(digits)
    d2 = (
        F.when((n == 12) & digits.startswith("90"), F.concat(F.lit("0"), F.substring(digits, 3, 1 << 30)))
        .when(n == 10, F.concat(F.lit("0"), digits))
        .otherwise(digits)
    )
    spaced = F.regexp_replace(
        d2, r"(?U)^(\d)(\d{3})(\d{3})(\d{2})(\d{2})$", "$1 $2 $3 $4 $5")
    return (
        F.when(c.isNull() | (ustrip(c) == ""), F.lit("-"))
        .when((F.length(d2) == 11) & d2.startswith("0"), spaced)
        .otherwise(c)
    )


def normalize_city(c) -> Column:
    """strip -> upper -> Turkish letters to ASCII."""
    return F.translate(F.upper(ustrip(as_text(c))), K.CITY_FROM, K.CITY_TO)


def last_note_ts(notes) -> Column:
    """Timestamp of the last 'dd.MM.yyyy HH:mm' match by position in the
    notes text; invalid dates -> null."""
    found = F.regexp_extract_all(_c(notes), F.lit(K.NOTE_TS_PATTERN), F.lit(0))
    return F.try_to_timestamp(F.try_element_at(found, F.lit(-1)),
                              F.lit(K.NOTE_TS_FORMAT)).cast("timestamp_ntz")


def current_year(as_of) -> Column:
    from ..session import as_of_col
    return F.year(as_of_col(as_of))


def warranty_label(year, as_of=None) -> Column:
    """Remaining years of a 6-year warranty as display text."""
    y = to_number(year)
    r = y + F.lit(K.WARRANTY_YEARS) - current_year(as_of)
    return (
        F.when(y.isNull(), F.lit("-"))
        .when(r > 0, F.concat(r.cast("bigint").cast("string"), F.lit(" " + K.WARRANTY_YEARS_LEFT)))
        .when(r == 0, F.lit(K.WARRANTY_ENDS_THIS_YEAR))
        .otherwise(F.lit(K.WARRANTY_EXPIRED))
    )


def warranty_status(label) -> Column:
    """Colour class of a warranty label: expired / ending / active."""
    label = _c(label)
    return (
        F.when(label == K.WARRANTY_EXPIRED, F.lit("expired"))
        .when(label == K.WARRANTY_ENDS_THIS_YEAR, F.lit("ending"))
        .when(label.contains(K.WARRANTY_YEARS_LEFT), F.lit("active"))
    )


def goal_progress(n, goal: int = K.DAILY_GOAL) -> Column:
    """Percent of the daily goal, capped at 100 (float math then
    truncation, as the progress bar does)."""
    pct = (_c(n).cast("double") / F.lit(float(goal))) * F.lit(100.0)
    return F.least(F.floor(pct), F.lit(100)).cast("bigint")


def goal_met(n, goal: int = K.DAILY_GOAL) -> Column:
    return _c(n) >= F.lit(goal)


def customer_tooltip(df: DataFrame) -> Column:
    """Contact / occupation / region text shown on hover.  A missing column
    shows '-', a null value shows 'None' (as the record dict did)."""
    def field(name):
        return as_text(F.col(name)) if name in df.columns else F.lit("-")
    return F.concat(
        F.lit("**İletişim:** "), field("phone"),
        F.lit("\n\n**Meslek:** "), field("occupation"),
        F.lit("\n\n**Bölge:** "), field("city"),
    )


def log_tooltip(detail) -> Column:
    d = _c(detail)
    return F.when(d.isNotNull() & (d != "") & (F.lower(d) != "nan"), d.cast("string"))


def map_hover(name, model, city) -> Column:
    """Null-propagating hover text of a map point."""
    return F.concat(_c(name), F.lit("<br>Model: "), _c(model), F.lit("<br>Şehir: "), _c(city))


def geo_jitter(key, salt: str) -> Column:
    """Deterministic uniform offset in [-0.008, 0.008) degrees per key
    (the dashboard used an unseeded random draw)."""
    digits = F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(salt)).cast("binary")), 1, 8)
    u = F.conv(digits, 16, 10).cast("double") / float(1 << 32)
    return (u * 2.0 - 1.0) * F.lit(K.GEO_JITTER_DEG)


def station_name(tags) -> Column:
    """operator -> brand -> name -> default, upper-cased.  Only a missing
    key falls through; an empty string is kept."""
    t = _c(tags)
    return F.upper(F.coalesce(
        F.try_element_at(t, F.lit("operator")),
        F.try_element_at(t, F.lit("brand")),
        F.try_element_at(t, F.lit("name")),
        F.lit(K.UNKNOWN_STATION),
    ))


def note_line(ts, author, text, reminder=None) -> Column:
    """'dd.MM.yyyy HH:mm | author | text' plus the reminder suffix when a
    reminder text is set."""
    line = F.concat(
        F.date_format(_c(ts), K.NOTE_TS_FORMAT), F.lit(" | "),
        as_text(author), F.lit(" | "), ustrip(_c(text)),
    )
    if reminder is None:
        return line
    r = _c(reminder)
    prefix, suffix = K.REMINDER_SUFFIX.split("{}")
    return F.concat(line, F.when(
        r.isNotNull() & (r != ""),
        F.concat(F.lit(prefix), F.replace(r, F.lit("T"), F.lit(" ")), F.lit(suffix)),
    ).otherwise(F.lit("")))
