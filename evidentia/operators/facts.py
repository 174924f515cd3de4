"""Facts of written lines and table rows: an entity, a metric and a quantity that the text itself binds together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Headings of the columns that name a row's entity, period and version, the first that has a value (fixed values).
ENTITY = ("entity", "product", "product_name", "model", "产品", "产品名称", "品名", "型号")
PERIOD = ("period", "year", "期间", "年份")
VERSION = ("version", "source version", "date", "版本", "日期")

#: A heading line of columns, a column in it, a cell, and the wrapper of a block (fixed formats).
COLUMNS, COLUMN = r"(?m)^\[COLUMNS\][ \t]*([^\n]*)", r"(?:^|\|)\s*([A-Z]+)=([^|]+)"
CELL, BLOCK = r"\b([A-Z]+)[0-9]+(?:\[([^\]]+)\])?='([^']*)'", r"^\s*\[BLOCK\s+id=[^\n]*?\]\s*"

_NAMES = sorted((n for names in V.METRICS.values() for n in names), key=len, reverse=True)
_UNITS = sorted(V.UNITS, key=len, reverse=True)
#: Metric, value and unit as they stand together.
FACT = rf"(?i)({'|'.join(_NAMES)})\s*(?:为|是|[:：=]|\bis\b)?\s*['\"]?(-?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?)\s*({'|'.join(_UNITS)})(?![A-Za-z])"
#: Characters before a fact that may name its entity; a fact takes up 6 at least, so this many can follow one such text.
PREFIX = 80
_LATER = PREFIX // 6 + 1


def row_facts(docs: DataFrame, id: str = "doc_id", text: str = "text", entity: Column | None = None, scope: Column | None = None, version: Column | None = None) -> DataFrame:
    """D12. (id, line, ordinal, entity, metric, value, unit, scope, version) of every fact of a text, in base units.

    A row with a cell under a heading of ``ENTITY`` gives a fact for each cell under a metric's heading; a bare number takes the unit of
    the row's column ``unit``, and the row's own period and version go before the document's. Cells name their heading themselves or have
    it from the text's ``[COLUMNS]`` lines; of cells or headings of one name the last counts. Other text gives facts where metric, value
    and unit follow each other; their entity is ``entity``, or what stands before them in the line, in up to 80 characters that don't
    begin with a bracket. Without an entity there is no fact. Null and empty texts have none. All of it is columns; a text's lines are
    rows before anything is searched.
    """
    none = F.lit(None).cast("string")
    own, span, made = (none if c is None else c.cast("string") for c in (entity, scope, version))
    heads = F.array_join(T.found(F.col("text"), COLUMNS, 1), "|")
    labels = F.arrays_zip(T.found(heads, COLUMN, 1).alias("c"), F.transform(T.found(heads, COLUMN, 2), F.trim).alias("name"))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), own.alias("own"), F.coalesce(span, F.lit("")).alias("scope"), F.coalesce(made, F.lit("")).alias("version"))
    rows = rows.withColumn("labels", labels).select("id", "own", "scope", "version", "labels", F.posexplode(T.lines("text")).alias("line", "raw"))
    rows = rows.withColumn("said", F.regexp_replace("raw", BLOCK, "")).drop("raw")
    by_row = _statements(rows).withColumn("part", F.lit(0))
    prose = rows.select("id", "line", "scope", "version", F.col("own").alias("entity"), "said", F.lit(0).alias("cell"), F.lit(1).alias("part"))
    lines = by_row.unionByName(prose).where(F.col("said").rlike(FACT))
    lines = lines.select("*", F.split("said", FACT, -1).alias("between"), T.found(F.col("said"), FACT).alias("whole"), *(T.found(F.col("said"), FACT, g).alias(n) for g, n in ((1, "m"), (2, "v"), (3, "u"))))

    def before(k: Column) -> Column:
        pieces = F.zip_with(F.slice("between", 1, k + 1), F.slice("whole", 1, k), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(k < _LATER, F.array_join(pieces, ""))

    hits = lines.select("id", "line", "part", "cell", "entity", "scope", "version", "between", "whole", F.posexplode(F.arrays_zip("m", "v", "u")).alias("k", "f"))
    prefix = F.regexp_replace(before(F.col("k")), r"^[ \t:：|,，]+|[ \t:：|,，]+$", "")
    named = F.when((prefix != "") & ~prefix.startswith("[") & (F.length(prefix) <= PREFIX), F.regexp_replace(prefix, r"(?i)\s+(?:has|的)$", ""))
    name = F.lower(F.regexp_replace(F.coalesce(F.when(F.col("entity") != "", F.col("entity")), named), r"\s+", ""))
    base = V.base_unit(F.col("f.u"), V.number(F.col("f.v")))
    facts = hits.select("id", "line", "part", "cell", "k", name.alias("entity"), V.metric(F.col("f.m")).alias("metric"), base.alias("b"), "scope", "version").where("entity <> '' and b is not null")
    order = F.struct("part", "cell", "k")
    return facts.select("id", "line", order.alias("ordinal"), "entity", "metric", F.round("b.value", 10).alias("value"), F.col("b.unit").alias("unit"), "scope", "version")


def _statements(rows: DataFrame) -> DataFrame:
    """A line ``metric: value`` for each cell of a metric in a row that names its entity."""
    cells = F.arrays_zip(*(T.found(F.col("said"), CELL, g).alias(n) for g, n in ((1, "c"), (2, "own"), (3, "v"))))
    above = lambda c: F.coalesce(F.try_element_at(F.filter("labels", lambda x: x["c"] == c), F.lit(-1))["name"], F.lit(""))
    named = F.transform(cells, lambda x: F.struct(F.lower(F.trim(F.when(x["own"] != "", x["own"]).otherwise(above(x["c"])))).alias("key"), x["v"].alias("v")))
    rows = rows.where(F.col("said").rlike(CELL)).withColumn("cells", named)

    def of(*keys: str) -> Column:
        """The last cell of the first of the headings whose value isn't empty."""
        under = lambda k: F.try_element_at(F.filter("cells", lambda x: x["key"] == k), F.lit(-1))["v"]
        last = [under(k) for k in keys]
        return F.coalesce(*(F.when(v != "", v) for v in last))

    rows = rows.withColumn("entity", of(*ENTITY)).where("entity is not null")
    last = F.filter("cells", lambda x, i: V.metric(x["key"]).isin(*V.METRICS) & ~F.exists(F.slice("cells", i + 2, F.size("cells")), lambda y: y["key"] == x["key"]))
    unit = F.coalesce(of("unit"), F.lit(""))
    rows = rows.select("id", "line", F.coalesce(of(*PERIOD), "scope").alias("scope"), F.coalesce(of(*VERSION), "version").alias("version"), "entity", unit.alias("unit"), F.posexplode(last).alias("cell", "x"))
    value = F.concat("x.v", F.when(F.col("x.v").rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), F.col("unit")).otherwise(""))
    return rows.select("id", "line", "scope", "version", "entity", F.concat(V.metric(F.col("x.key")), F.lit(": "), value).alias("said"), "cell")
