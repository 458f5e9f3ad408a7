"""Column expressions (JVM-side unless stated) shared by the operators.

Each function takes and returns ``Column``s so it composes inside one
whole-stage-codegen span. Operator ids refer to the README's map.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from viewlens import schemas as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -------------------------------------------------------------------

@pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    # Arrow-batched; only rows holding '&' are sent non-null (see html_unescape).
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)


def html_unescape(c) -> Column:
    """HTML-entity decoding. The Python worker sees only rows with '&'."""
    c = col(c)
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def strip_space(c) -> Column:
    """Unicode-aware strip of leading/trailing white space (Python ``str.strip``)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean_title(c) -> Column:
    """Unescape, fold newlines to spaces, strip."""
    return strip_space(F.replace(html_unescape(c), F.lit("\n"), F.lit(" ")))


# --- urls -------------------------------------------------------------------

def query_param(url, name: str) -> Column:
    """First non-blank value of query parameter ``name``, percent/plus decoded.

    The query is the text after the first '?' and before any '#'. Pairs are
    split on '&'; a pair counts only when it has a non-empty raw value.
    """
    query = F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)
    # leftmost pair '<name>=<one or more non-&>': a regex match stays in codegen
    # (no per-row array and lambda)
    raw = F.nullif(F.regexp_extract(query, rf"(?:^|&){re.escape(name)}=([^&]+)", 1), F.lit(""))
    plus = F.replace(raw, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(plus), plus)


def video_id(url) -> Column:
    """The ``v`` parameter of a watch URL, NULL when absent or blank."""
    return query_param(url, "v")


# --- time -------------------------------------------------------------------


def export_timestamp_text(body) -> Column:
    """First timestamp text in a content cell, NULL when none."""
    return F.nullif(F.regexp_extract(col(body), S.EXPORT_TS_RE, 1), F.lit(""))


def parse_export_timestamp(text) -> Column:
    """P5+P6: drop the zone abbreviation and parse as wall-clock TIMESTAMP_NTZ.

    Unicode spaces (e.g. U+202F before AM/PM) are folded to ASCII first.
    A text that still does not parse (odd zone text) gives NULL.
    """
    t = F.regexp_replace(col(text), S.ZONE_RE, "")
    t = F.regexp_replace(t, r"(?U)\s", " ")
    return F.try_to_timestamp(t, F.lit(S.EXPORT_TS_FORMAT)).cast("timestamp_ntz")


def days_floor(start, end) -> Column:
    """Whole 24-hour periods from start to end (Python ``timedelta.days``)."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def add_seconds(ts, seconds) -> Column:
    """ts + seconds (may be fractional, microsecond precision)."""
    return F.timestamp_add("MICROSECOND", (col(seconds) * 1_000_000).cast("long"), col(ts))


# --- numbers ------------------------------------------------------------------

def to_double(c) -> Column:
    """Numeric coercion, NULL on anything unparsable."""
    return col(c).cast("string").try_cast("double")


def to_long(c) -> Column:
    return col(c).cast("string").try_cast("double").try_cast("bigint")


def iso_duration_seconds(iso) -> Column:
    """Seconds of an ISO 8601 time of day duration (hours, minutes and
    seconds, each optional, in this order); anything else, or what follows
    an unknown unit, counts as 0."""
    s = F.coalesce(col(iso), F.lit(""))
    before, total = "^PT", F.lit(0).cast("bigint")
    for unit, seconds in (("H", 3600), ("M", 60), ("S", 1)):
        digits = F.regexp_extract(s, f"{before}([0-9]+){unit}", 1)
        total = total + F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")) * seconds
        before += f"(?:[0-9]+{unit})?"
    return total


def canonical_category(c) -> Column:
    """P16: '24', '24.0', ' 24 ' -> '24'; blank, text, non-integral -> NULL."""
    d = col(c).cast("string").try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("bigint").cast("string"))


def category_map() -> Column:
    pairs = []
    for k, v in S.CATEGORIES:
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def category_name(category_id, default: str | None = "Unknown") -> Column:
    """Id -> name via a literal map (no join). ``default=None`` gives
    the evidence form P20 ("Category {id}")."""
    name = F.try_element_at(category_map(), col(category_id))
    if default is None:
        return F.coalesce(name, F.concat(F.lit("Category "), col(category_id)))
    return F.coalesce(name, F.lit(default))


def round_ratio(num, den, digits: int) -> Column:
    """Exact half-even rounding of the non-negative ratio num/den (integers).

    Integer arithmetic, so the result is the same double in every engine;
    NULL when den is 0 or NULL.
    """
    scale = 10 ** digits
    x = col(num).cast("long") * F.lit(scale)
    d = col(den).cast("long")
    r = x % d
    q = ((x - r) / d).cast("long")
    adj = (F.when(r * 2 > d, F.lit(1))
           .when(r * 2 == d, q % 2)
           .otherwise(F.lit(0)))
    return F.when(d != 0, (q + adj).cast("double") / F.lit(scale))


def count_text(c) -> Column:
    """Thousands-separated integer (toward zero) or 'N/A'."""
    d = col(c).cast("string").try_cast("double")
    n = d.try_cast("bigint")
    return F.coalesce(F.format_number(n, 0), F.lit("N/A"))


def duration_text(seconds) -> Column:
    """P33: '1h02m03s', '2m03s', or 'N/A' for NULL, bad or <= 0."""
    d = col(seconds).cast("string").try_cast("double")
    s = d.try_cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    with_h = F.format_string("%dh%02dm%02ds", h.cast("long"), m.cast("long"), sec)
    without_h = F.format_string("%dm%02ds", m.cast("long"), sec)
    return (F.when(d.isNull() | (d <= 0) | s.isNull(), F.lit("N/A"))
            .when(h > 0, with_h).otherwise(without_h))


def label_from_composite(composite) -> Column:
    """V6 fallback: thresholds on the composite score."""
    c = col(composite)
    expr = None
    for thr, name in S.LABEL_THRESHOLDS:
        expr = F.when(c >= thr, F.lit(name)) if expr is None else expr.when(c >= thr, F.lit(name))
    return expr.otherwise(F.lit(S.LABEL_FLOOR))


def md5_rank_key(key, seed: int = 42) -> Column:
    """60-bit integer from md5('<key>:<seed>'); its order equals the md5 hex order
    on the first 15 digits. Deterministic and partition-independent."""
    h = F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
