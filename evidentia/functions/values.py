"""Dates, numbers, units, addresses, geometry and identities as Column builders."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import found

#: Unit spellings: base unit and factor (fixed values).
UNITS = {
    "mm": ("mm", 1.0), "毫米": ("mm", 1.0), "cm": ("mm", 10.0), "厘米": ("mm", 10.0), "m": ("mm", 1000.0), "米": ("mm", 1000.0),
    "kg": ("kg", 1.0), "千克": ("kg", 1.0), "g": ("kg", 0.001), "克": ("kg", 0.001), "m²": ("m²", 1.0), "m2": ("m²", 1.0), "㎡": ("m²", 1.0),
    "元": ("CNY", 1.0), "万元": ("CNY", 10000.0), "亿元": ("CNY", 100000000.0), "cny": ("CNY", 1.0), "usd": ("USD", 1.0), "%": ("%", 1.0),
}
#: Metric names by metric (fixed values).
METRICS = {
    "thickness": ("thickness", "板厚", "厚度"), "width": ("width", "宽度", "板宽"), "length": ("length", "长度", "板长"),
    "weight": ("weight", "mass", "重量", "质量"), "cost": ("cost", "price", "单价", "价格", "成本"), "area": ("area", "面积"),
}


def period(text: Column, default_year: Column | None = None) -> Column:
    """F32. ``YYYY`` or ``YYYY-MM`` of a written period; null if it is none. A bare month takes ``default_year``."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    year, month = F.regexp_extract(t, r"(20[0-9]{2})年", 1), F.regexp_extract(t, r"20[0-9]{2}年(1[0-2]|0?[1-9])月", 1)
    alone = F.regexp_extract(t, r"^(1[0-2]|0?[1-9])月$", 1)
    out = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.when(F.substring(t, 6, 2).between("01", "12"), t))
    out = out.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).isNotNull(), F.substring(t, 1, 7)))
    out = out.when(t.rlike(r"^[0-9]{4}$"), t).when(year != "", F.when(month != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))).otherwise(year))
    if default_year is not None:
        out = out.when((alone != "") & default_year.rlike("^20[0-9]{2}$"), F.concat(default_year, F.lit("-"), F.lpad(alone, 2, "0")))
    return out


def previous_period(p: Column) -> Column:
    """W18. The year or month before."""
    y = F.substring(p, 1, 4).cast("int")
    m = F.try_to_number(F.substring(p, 6, 2), F.lit("99")).cast("int")
    before = F.when(m == 1, F.format_string("%04d-12", y - 1)).otherwise(F.format_string("%04d-%02d", y, m - 1))
    return F.when(p.rlike("^[0-9]{4}$"), (y - 1).cast("string")).when(p.rlike("^[0-9]{4}-[0-9]{2}$"), before)


def resolved_days(text: Column, today: str) -> Column:
    """F30. Relative days as dates; today's date is appended where the text asks for the current state."""
    out = F.trim(text)
    for words, shift in ((("今天", "今日", "本日", r"\btoday\b"), 0), (("昨天", "昨日", r"\byesterday\b"), -1), (("明天", "明日", r"\btomorrow\b"), 1)):
        day = F.date_format(F.date_add(F.lit(today).cast("date"), shift), "yyyy-MM-dd")
        out = F.regexp_replace(out, F.lit("(?i)" + "|".join(words)), day)
    return F.when(out.rlike(r"(?i)现在|当前|最新|\b(?:current|latest|now)\b"), F.concat(out, F.lit(f" 当前日期 {today}"))).otherwise(out)


#: A date: a year with month and day, a Chinese month and day, or a bare month and day; what stands before is checked by group.
DATE = r"(?:^|[^0-9])((?:19|20)[0-9]{2}(?:[-/][0-9]{1,2}[-/][0-9]{1,2}|年[0-9]{1,2}月[0-9]{1,2}日?))"


def mentioned_dates(text: Column, most: int = 16) -> Column:
    """F31. Distinct dates with a year as written, in order, ``most`` at most."""
    return F.slice(F.array_distinct(found(text, DATE, 1)), 1, most)


def recency(date: Column, profile: Column, this_year: int) -> Column:
    """F33. ``exp(-age / 3)``, 0.15 at least; 0.75 for standards, 0.45 without a year."""
    years = F.transform(found(F.coalesce(date, F.lit("")), r"20[0-9]{2}"), lambda y: y.cast("int"))
    age = F.greatest(F.lit(0), this_year - F.array_max(years))
    return F.when(profile == "construction_standard", 0.75).when(F.size(years) == 0, 0.45).otherwise(F.greatest(F.lit(0.15), F.exp(-age / 3.0)))


def box_distance(a: Column, b: Column) -> Column:
    """F40. Between boxes [left, top, right, bottom]; 0 if they meet, 900 if one is invalid."""
    side = lambda box, i: F.get(box, F.lit(i))
    valid = lambda box: F.coalesce((F.size(box) == 4) & (side(box, 0) < side(box, 2)) & (side(box, 1) < side(box, 3)), F.lit(False))

    def apart(axis: int) -> Column:
        """How far the later of the two intervals on an axis begins after the earlier one's end."""
        starts, ends = [side(x, axis) for x in (a, b)], [side(x, axis + 2) for x in (a, b)]
        return F.greatest(F.greatest(*starts) - F.least(*ends), F.lit(0.0))

    return F.when(valid(a) & valid(b), F.sqrt(apart(0) * apart(0) + apart(1) * apart(1))).otherwise(F.lit(900.0))


def link_score(same_heading: Column, nearby: Column, caption: Column, text: Column, distance: Column) -> Column:
    """F41. How well a text goes with an image on its page; ``nearby``, ``caption``, ``text`` compact."""

    def inside(x: Column, y: Column) -> Column:
        return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))

    near = F.when(distance <= 80, 3.0).when(distance <= 260, 1.5).when(distance <= 650, 0.5).otherwise(0.0)
    figure = F.when(F.contains(text, F.lit("图")), 1.0).otherwise(0.0)
    return F.lit(1.0) + F.when(same_heading, 4.0).otherwise(0.0) + F.when(inside(nearby, text), 6.0).otherwise(0.0) + F.when(inside(caption, text), 4.0).otherwise(0.0) + near + figure


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """F42. By the norm, 1e-12 at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def web_relevance(terms: Column, title: Column, body: Column) -> Column:
    """F44. Terms in the title count 1.8, in the body 1; by the number of terms between 4 and 12; 0.5 without terms."""
    hit = lambda t: F.when(F.contains(F.lower(title), t), 1.8).when(F.contains(F.lower(body), t), 1.0).otherwise(0.0)
    total = F.aggregate(F.transform(terms, hit), F.lit(0.0), lambda a, x: a + x)
    most = F.greatest(F.lit(4.0), F.least(F.size(terms).cast("double"), F.lit(12.0)))
    return F.when(F.size(terms) == 0, 0.5).otherwise(F.least(F.lit(1.0), total / most))


def number(text: Column) -> Column:
    """F45. Commas dropped, brackets as minus; null unless finite."""
    t = F.regexp_replace(F.trim(text), ",", "")
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    return F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?$"), t.cast("double"))


#: Factors of amounts by the unit that stands behind them; marks of currencies and scales: kind, pattern, currency, factor, certainty. A
#: bare dollar or yen sign names no currency (fixed values).
AMOUNTS = {"亿元": 100_000_000.0, "万元": 10_000.0, "元": 1.0, "亿": 100_000_000.0, "万": 10_000.0}
MARKS = (
    ("currency", r"\b(?:USD|US\$|U\.S\.\s*dollars?)\b", "USD", None, 0.98),
    ("currency", r"\bEUR\b|€", "EUR", None, 0.98),
    ("currency", r"\bGBP\b|£", "GBP", None, 0.98),
    ("currency", r"\bJPY\b", "JPY", None, 0.98),
    ("currency", r"(?:人民币|人民幣|RMB|CNY|Chinese\s+Yuan)", "CNY", None, 0.98),
    ("currency", r"[$¥]", None, None, 0.45),
    ("scale", r"(?:in\s+)?thousands?\b", None, 1_000.0, 0.95),
    ("scale", r"(?:in\s+)?millions?\b", None, 1_000_000.0, 0.95),
    ("scale", r"(?:in\s+)?billions?\b", None, 1_000_000_000.0, 0.95),
    ("scale", r"(?:万元|萬\s*元)", None, 10_000.0, 0.98),
    ("scale", r"(?:亿元|億\s*元)", None, 100_000_000.0, 0.98),
)
_SURFACE = r"\(?[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\)?"


def amount_candidates(text: Column) -> Column:
    """F46. array<struct<raw, value, unit, multiplier, normalised>>: numbers as they stand, in order. ``normalised`` only where a unit stands
    behind the number; what isn't a finite number, such as one with a single bracket, is left out. Null text has none."""
    units = "|".join(AMOUNTS)
    raw = found(F.coalesce(text, F.lit("")), rf"(?U)(?<![\w.]){_SURFACE}(?:\s*(?:{units}))?")

    factors = F.create_map(*(F.lit(v) for kv in AMOUNTS.items() for v in kv))
    unit_of = lambda x: F.nullif(F.regexp_extract(x, f"({units})$", 1), F.lit(""))
    seen = F.transform(raw, lambda x: F.struct(x.alias("raw"), number(F.regexp_extract(x, f"^{_SURFACE}", 0)).alias("value"), unit_of(x).alias("unit")))
    seen = F.filter(seen, lambda x: F.abs(x["value"]) < float("inf"))
    factor = lambda x: F.coalesce(F.try_element_at(factors, x["unit"]), F.lit(1.0))
    return F.transform(seen, lambda x: F.struct(x["raw"].alias("raw"), x["value"].alias("value"), x["unit"].alias("unit"), factor(x).alias("multiplier"), F.when(x["unit"].isNotNull(), x["value"] * factor(x)).alias("normalised")))


def _first_of(raw: Column, small: Column) -> Callable[[Column], Column]:
    return lambda k: F.element_at(raw, F.array_position(small, k).cast("int"))


def _marked(kind: str, facts: list[Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw"), *facts)


def unit_marks(text: Column, most: int | None = 16) -> Column:
    """F47. array<struct<kind, raw, currency, factor, certainty>>: marks of currencies and scales, by kind as listed, each spelling once whatever
    its case, ``most`` at most (None: all). They are observations: nothing is converted. Null text has none."""
    text = F.coalesce(text, F.lit(""))
    out = []
    for kind, pattern, currency, factor, certainty in MARKS:
        raw = found(text, f"(?iU){pattern}")
        small = F.transform(raw, F.lower)
        firsts = F.transform(F.array_distinct(small), _first_of(raw, small))
        facts = [F.lit(currency).cast("string").alias("currency"), F.lit(factor).cast("double").alias("factor"), F.lit(certainty).alias("certainty")]
        out.append(F.transform(firsts, _marked(kind, facts)))
    all_ = F.concat(*out)
    return all_ if most is None else F.slice(all_, 1, most)


def base_unit(unit: Column, value: Column) -> Column:
    """F48. struct<unit, value> in base units; null for an unknown spelling."""
    key = F.lower(unit)
    name, factor = F.lit(None).cast("string"), F.lit(None).cast("double")
    for u, (base, f) in UNITS.items():
        name, factor = F.when(key == u, base).otherwise(name), F.when(key == u, f).otherwise(factor)
    return F.when(name.isNotNull(), F.struct(name.alias("unit"), (value * factor).alias("value")))


def metric(name: Column) -> Column:
    """F49. The metric of a name, else the name folded."""
    key = F.lower(F.trim(name))
    out = key
    for m, names in METRICS.items():
        out = F.when(key.isin(*names), m).otherwise(out)
    return out


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_matches(h: Column, suffix: str) -> Column:
    """F22. The host itself or one below it."""
    s = suffix.lower().lstrip(".")
    return (h == s) | h.endswith("." + s)


#: Public suffixes of two parts (fixed values).
TWO_PARTS = ("com.cn", "gov.cn", "org.cn", "net.cn", "co.uk", "gov.uk", "org.uk", "com.au")


def publisher(url: Column) -> Column:
    """A12. The registered part of the host, approximately: its last two labels, or three."""
    parts = F.split(F.regexp_replace(host(url), r"\.+$", ""), r"\.")
    last = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(last.isin(*TWO_PARTS), three).otherwise(last)


#: Query keys that only track, besides utm_* (fixed values).
TRACKING = ("from", "spm", "source", "ref", "referrer")


def canonical_url(url: Column) -> Column:
    """U08. http and https only, no user; lower-case host, default ports, repeated slashes, tracking keys and fragment
    dropped, the query's keys and values encoded anew. Hosts beyond ASCII stay as they are: ``ascii_host`` writes them."""
    u = F.trim(url)
    scheme, h = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), host(u)
    port = F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    pairs = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(plain(x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    key = lambda p: plain(F.substring_index(p, "=", 1))
    kept = F.filter(pairs, lambda p: ~F.lower(key(p)).startswith("utm_") & ~F.lower(key(p)).isin(*TRACKING))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")
    query = F.array_join(F.transform(kept, lambda p: F.concat(coded(F.substring_index(p, "=", 1)), F.lit("="), coded(value(p)))), "&")
    out = F.concat(scheme, F.lit("://"), h, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    user = u.rlike(r"^[^:/?#]+://[^/?#]*@")
    return F.when(scheme.isin("http", "https") & (h != "") & ~user, out).otherwise("")


@F.pandas_udf(StringType())
def ascii_host(url: pd.Series) -> pd.Series:
    """Canonical addresses with their host's other scripts in ASCII; empty where a host can't be written so."""

    def one(u: str) -> str:
        scheme, _, rest = u.partition("://")
        name = re.split(r"[:/?#]", rest, maxsplit=1)[0]
        try:
            return f"{scheme}://{name.encode('idna').decode()}{rest[len(name) :]}"
        except UnicodeError:
            return ""

    return url.map(one)


def stable_id(*parts: Column, length: int = 24) -> Column:
    """F56. A prefix of the digest of parts joined by an unlikely sign; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)
