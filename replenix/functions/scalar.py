"""Column expressions (the B-series).  All are built-in Spark expressions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

GUID_PATTERN = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# B1
def region_of_warehouse(name, south: Iterable[str] = K.SOUTH_WAREHOUSES,
                        north: Iterable[str] = K.NORTH_WAREHOUSES, default: str = K.NORTH) -> Column:
    t = F.trim(_c(name))
    return (F.when(t.isin(*south), F.lit(K.SOUTH))
            .when(t.isin(*north), F.lit(K.NORTH))
            .otherwise(F.lit(default)))


# B2
def region_of_port(port_id, south_port: str = K.SOUTH_PORT_ID, north_port: str = K.NORTH_PORT_ID,
                   default: str = K.NORTH) -> Column:
    p = _c(port_id)
    return (F.when(p == south_port, F.lit(K.SOUTH))
            .when(p == north_port, F.lit(K.NORTH))
            .otherwise(F.lit(default)))


# B3
def sale_date(paid, created, policy: str = "paid") -> Column:
    """``paid``: coalesce(paid, created) as date; ``created``: created as date."""
    if policy == "paid":
        return F.to_date(F.coalesce(_c(paid), _c(created)))
    if policy == "created":
        return F.to_date(_c(created))
    raise ValueError(f"unknown date policy {policy!r}")


# B4
def json_first_warehouse(col) -> Column:
    """The first warehouse id of a stock snapshot; null unless the text is valid JSON."""
    c = _c(col)
    return F.when(is_json(c), F.get_json_object(c, "$[0].WarehouseId"))


# a JSON string token; the repeats are possessive, so a long text needs no stack
JSON_STRING = r'"[^"\\\x00-\x1F]*+(?:\\.[^"\\\x00-\x1F]*+)*+"'


# B5
def is_json(col) -> Column:
    """True for one whole JSON object or array and nothing after it (null: false).

    The text goes into an array before a mark that only this text has; it is whole if
    the mark is the array's second element.  Text after the document, a second document
    or a missing bracket breaks the array or moves the mark.  The parser also takes
    single quotes and raw control characters in strings, so texts that have any are
    looked at again without their strings.  Duplicate keys are allowed (the first counts)."""
    c = _c(col)
    mark = F.hex(F.xxhash64(c))
    whole = F.get_json_object(F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]')), "$[1]") == mark
    plain = ~c.rlike(r"['\x00-\x1F]") | ~F.regexp_replace(c, JSON_STRING, "").rlike(r"[\"'\\\x00-\x08\x0B\x0C\x0E-\x1F]")
    return F.coalesce(c.rlike(r"^[ \t\r\n]*[\[{]") & plain & whole, F.lit(False))


# B6
def try_guid(col) -> Column:
    c = F.trim(_c(col))
    return F.when(c.rlike(GUID_PATTERN), F.lower(c))


# B7
def strip(col) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.regexp_replace(_c(col).cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


# a plain decimal number; cast would also take 12f, 12d, inf and nan
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(col) -> Column:
    """The number that a cell holds, null for any other text."""
    s = strip(col)
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def channel_of(sku, width: int = 3) -> Column:
    """The channel of a SKU is its prefix (``918-054`` -> ``918``)."""
    return F.left(_c(sku), F.lit(width))


# B9
def day_span(start, end) -> Column:
    """Inclusive day count; 0 when the end lies before the start."""
    s, e = _c(start), _c(end)
    return F.when(e < s, F.lit(0)).otherwise(F.datediff(e, s) + 1)


# B12
def qty_div_days(qty, days) -> Column:
    return F.concat_ws(" / ", _c(qty).cast("string"), _c(days).cast("string"))


# B13
def to_number(col, default: float = 0.0) -> Column:
    """Lenient numeric parse: white space around is fine, true/false are 1/0; NaN,
    infinities and unparsable text become ``default``."""
    s = F.lower(strip(col))
    v = F.when(s == "true", F.lit(1.0)).when(s == "false", F.lit(0.0)).otherwise(parse_number(col))
    return F.coalesce(v, F.lit(float(default)))


def to_int_flag(col) -> Column:
    """Discontinued flag: numeric parse, bad -> 0, truncated toward zero."""
    return F.coalesce(to_number(col).try_cast("int"), F.lit(0))


# B15
def is_empty(col) -> Column:
    c = _c(col)
    return c.isNull() | F.lower(strip(c)).isin(*K.EMPTY_TOKENS)


# B16
def total_stock(on_hand="on_hand", in_transit="in_transit", in_production="in_production") -> Column:
    return _c(on_hand) + _c(in_transit) + _c(in_production)


# B17
def daily_demand(d8="demand_8_30", d15="demand_15", d30="demand_30") -> Column:
    return F.greatest(_c(d8), _c(d15), _c(d30))


# B18
def demand_source(d8="demand_8_30", d15="demand_15", d30="demand_30") -> Column:
    m = daily_demand(d8, d15, d30)
    joined = F.concat_ws(
        "/",
        F.when(_c(d8) == m, F.lit(K.SOURCE_8_30)),
        F.when(_c(d15) == m, F.lit(K.SOURCE_15)),
        F.when(_c(d30) == m, F.lit(K.SOURCE_30)),
    )
    return F.when(m == 0, F.lit(K.SOURCE_NONE)).otherwise(joined)


# B19
def source_tag(d8="demand_8_30", d15="demand_15", d30="demand_30") -> Column:
    m = daily_demand(d8, d15, d30)
    return (F.when(m == 0, F.lit("no_sales"))
            .when(_c(d15) == m, F.lit("use_15"))
            .when(_c(d8) == m, F.lit("use_8_30"))
            .otherwise(F.lit("use_30")))


# B25
def priority(decision="decision") -> Column:
    d = _c(decision)
    expr = None
    for code, p in K.PRIORITY.items():
        expr = (F.when(d == code, F.lit(p)) if expr is None else expr.when(d == code, F.lit(p)))
    return expr


# B26
def days_of_supply(total="total_stock", daily="daily_demand", none: float = 999.0) -> Column:
    return F.when(_c(daily) > 0, _c(total) / _c(daily)).otherwise(F.lit(float(none)))


# B27
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"


def image_full_url(col, base: str = K.IMAGE_BASE) -> Column:
    """Trim; a path not starting with ``http`` gets ``base`` with ``\\`` -> ``/``
    and leading ``/`` removed; empty stays empty."""
    raw = F.trim(F.coalesce(_c(col).cast("string"), F.lit("")))
    rel = F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), r"^/+", "")
    return (F.when(raw == "", F.lit(""))
            .when(F.lower(raw).startswith("http"), raw)
            .otherwise(F.concat(F.lit(base), rel)))


def quote_url_path(url) -> Column:
    """Percent-quote the path part of a URL keeping ``/``, ``:`` and ``%``
    (scheme://host and ?query#fragment untouched)."""
    u = _c(url)
    q = F.url_encode(F.regexp_extract(u, URL_PARTS, 2))
    # order matters: "%25" (a literal percent) must be restored last
    for enc, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A"), ("%25", "%")):
        q = F.replace(q, F.lit(enc), F.lit(plain))
    return F.when(u == "", F.lit("")).otherwise(
        F.concat(F.regexp_extract(u, URL_PARTS, 1), q, F.regexp_extract(u, URL_PARTS, 3)))


def normalize_image_url(col, base: str = K.IMAGE_BASE) -> Column:
    return quote_url_path(image_full_url(col, base))


# B29
def _tiny_ties(d: int) -> dict[float, str]:
    """Decimal ties below 1e-3 at ``d`` places (111 values for d <= 5), built
    by rule: the double nearest to each tie, mapped to Python's formatting of
    it.  ``format_number`` misrounds exactly these (its digit source switches
    to scientific notation below 1e-3)."""
    if d < 3:
        return {}
    return {(2 * n + 1) / (2 * 10 ** d): format((2 * n + 1) / (2 * 10 ** d), f".{d}f")
            for n in range(10 ** (d - 3))}


def py_fixed(col, decimals: int) -> Column:
    """``format(x, '.{d}f')`` as Python prints a double (the binary value
    rounded half-even), for 0 <= d <= 5: ``format_number`` (DecimalFormat,
    HALF_EVEN on the exact binary value) without grouping commas, plus the
    tie table for magnitudes below 1e-3."""
    x = _c(col).cast("double")
    d = int(decimals)
    fast = F.replace(F.format_number(x, d), F.lit(","), F.lit(""))
    ties = _tiny_ties(d)
    if not ties:
        return fast
    table = F.create_map(*[t for k, v in sorted(ties.items()) for t in (F.lit(k), F.lit(v))])
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.coalesce(F.when(F.abs(x) < 1e-3, F.concat(sign, table[F.abs(x)])), fast)


def with_fixed_texts(df, specs: dict) -> "DataFrame":
    """Add text columns ``name -> (column, decimals[, dash])`` formatted like
    ``py_fixed``; with ``dash`` a value that is not positive shows '-'."""
    cols = []
    for name, spec in specs.items():
        col, d = spec[0], int(spec[1])
        text = py_fixed(col, d)
        if len(spec) > 2 and spec[2]:
            text = F.when(_c(col) > 0, text).otherwise(F.lit("-"))
        cols.append(text.alias(name))
    return df.select("*", *cols)


def fmt_fixed(col, decimals: int, dash_when_not_positive: bool = False) -> Column:
    """Text with fixed decimals, rounded exactly as Python formats a float."""
    c = _c(col)
    txt = py_fixed(c, decimals)
    return F.when(c > 0, txt).otherwise(F.lit("-")) if dash_when_not_positive else txt


# B30
def decision_label(decision="decision", lang: str = "zh") -> Column:
    labels = K.DECISION_LABELS if lang == "zh" else K.DECISION_LABELS_EN
    d = _c(decision)
    expr = None
    for code, label in labels.items():
        expr = (F.when(d == code, F.lit(label)) if expr is None else expr.when(d == code, F.lit(label)))
    return expr


# B31
def round6(col) -> Column:
    """Numeric parse, then round to 6 places the way pandas does (x * 1e6,
    round half to even, / 1e6)."""
    return F.rint(parse_number(col) * 1e6) / 1e6


# B32
def container_gap(volume, threshold: float = K.CONTAINER_THRESHOLD) -> Column:
    return F.lit(float(threshold)) - _c(volume)


# B33
def norm_window_type(col) -> Column:
    return F.lower(strip(col))


def decimal6(numerator, denominator) -> Column:
    """``numerator / nullif(denominator, 0)`` as DECIMAL(18,6), rounded half-up."""
    num = _c(numerator).cast("decimal(28,6)")
    den = F.nullif(_c(denominator), F.lit(0))
    return (num / den).cast("decimal(18,6)")
