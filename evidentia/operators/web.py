"""Web sources: admission, ranking, caches and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources import workspace
from .ranks import ranked_within


def rejection(url: Column, body: Column, blocked: list[str]) -> Column:
    """P09. Why a source is not admitted, empty if it is; of several reasons the last in the order unsafe, not public, blocked, empty."""
    h = V.host(url)
    unsafe = ~url.rlike("^https?://") | (h == "") | url.rlike("^[^:/?#]+://[^/?#]*@")
    inside = (h == "localhost") | h.rlike(r"\.(local|internal|localhost)$") | h.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    banned = F.lit(False)
    for b in blocked:
        banned = banned | V.host_matches(h, b)
    return F.when(F.trim(body) == "", "empty_source").when(banned, "blocked_domain").when(inside, "non_public_url").when(unsafe, "unsafe_url").otherwise("")


#: Landing pages without relation to a question that doesn't ask for them, and download bait, by patterns of their titles (fixed values).
ADULT_QUESTION = r"(?i)成人|色情|情色|A片|成人视频|porn|sex"
ADULT_PAGE = r"(?i)激情视频|成人视频|成人免费.*视频|一级片|色情网站|pornhub|xxx.?video"
BAIT_EDITION, BAIT = "成人版", r"(?i)最新版|安卓版|iphone版|下载"
#: Dates, which say nothing of what a question is about, and words of asking (fixed values).
DATED = r"20[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日|\b20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}\b"
ASKING = ("查询", "概括", "介绍", "最新", "实时", "今天", "今日", "当前", "现在", "请问")


def admission(question: Column, url: Column, title: Column, body: Column, blocked: list[str], spam: list[tuple[str, str]] = ()) -> Column:
    """P09. Why a source is not admitted to a question, empty if it is.

    Of several reasons the last of this order holds: unsafe address, inner host, blocked domain, landing page, download bait, the titles'
    patterns of ``spam`` (reason, pattern), no title and text. A source with none of them is refused for want of overlap if no term of the
    question stands in its title or text; a question without terms refuses nothing so. Nulls count as empty.
    """
    question, url, title, body = (F.coalesce(c, F.lit("")) for c in (question, url, title, body))
    port = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*:([^/?#:@]*)(?:[/?#]|$)", 1)
    base = rejection(url, F.lit("page"), blocked)
    reason = F.when((base == "") & ~port.isin("", "80", "443"), "unsafe_url").otherwise(base)
    decent = ~question.rlike(ADULT_QUESTION)
    reason = F.when(decent & title.rlike(ADULT_PAGE), "unrelated_adult_landing_page").otherwise(reason)
    reason = F.when(decent & F.contains(title, F.lit(BAIT_EDITION)) & title.rlike(BAIT), "seo_download_pollution").otherwise(reason)
    for name, pattern in spam:
        reason = F.when(title.rlike(pattern), name).otherwise(reason)
    reason = F.when((F.trim(title) == "") & (F.trim(body) == ""), "empty_source").otherwise(reason)
    terms = T.web_terms(F.regexp_replace(question, DATED, ""), stop=ASKING)
    related = F.exists(terms, lambda t: F.contains(T.folded(title), t)) | (V.web_relevance(terms, title, body) > 0)
    return F.when((reason == "") & (F.size(terms) > 0) & ~related, "no_query_overlap").otherwise(reason)


def invented_years(question: Column, rewrite: Column, allowed: list[str] | None = None) -> Column:
    """P19. Years that a rewrite has and its question hasn't; none are invented if the question names no year."""
    year = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?![0-9])"
    own = F.array_union(T.found(question, year, 1), F.array(*map(F.lit, allowed or [])).cast("array<string>"))
    return F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(F.array_except(T.found(rewrite, year, 1), own))


def first_seen(sources: DataFrame, rank: str, url: str = "url") -> DataFrame:
    """U08. Sources by canonical URL, the first of each; those without one go."""
    rows = sources.withColumn("canonical", V.canonical_url(F.col(url)))
    other = F.col("canonical").rlike(r"[^\x00-\x7F]")
    rows = rows.where(~other).unionByName(rows.where(other).withColumn("canonical", V.ascii_host("canonical"))).where("canonical <> ''")
    w = Window.partitionBy("canonical").orderBy(rank)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(sources: DataFrame, query: str, score: str, rank: str) -> DataFrame:
    """R21. Adds ``position``: by the provider's score if every score of the query is valid (0 to 1), else by its order."""
    s = F.col(score)
    valid = F.coalesce(s.isNotNull() & ~F.isnan(s) & s.between(0, 1), F.lit(False))
    rows = sources.withColumn("_all", F.bool_and(valid).over(Window.partitionBy(query)))
    w = Window.partitionBy(query).orderBy(F.when(F.col("_all"), -s).otherwise(F.lit(0.0)), rank)
    return rows.withColumn("position", F.row_number().over(w)).withColumnRenamed("_all", "by_score")


def deduplicated(pages: DataFrame, id: str, url: str, text: str) -> DataFrame:
    """U05. One row per page: its publisher and text key, the first id of both, and whether it is a duplicate of it. Members are rows, not
    lists, so a text that very many pages share is no row of all their ids."""
    rows = pages.select(V.publisher(F.col(url)).alias("publisher"), F.md5(T.squeezed(F.col(text))).alias("text_key"), F.col(id))
    first = rows.groupBy("publisher", "text_key").agg(F.min(id).alias("first_id"))
    return rows.join(first, ["publisher", "text_key"]).withColumn("duplicate", F.col(id) != F.col("first_id"))


#: Events whose steps are folded at once.
STEPS = 1024


def quota(events: DataFrame, ts: str, id: str, cap: int, offset_hours: int = 0, releases: Column | None = None) -> DataFrame:
    """A21, T04. Adds ``day``, ``used`` (the day's counter after the event) and ``admitted`` (whether a call found room; null for a release).
    Without releases ``used`` is the number of the day's calls so far, refused ones too.

    A call adds 1 while the counter is below ``cap``; a release takes 1 back, down to 0, so that a later call may find room again. Both
    steps clamp the counter, and clamps one after the other are a clamp again: runs of ``STEPS`` events fold to one, runs of runs
    likewise, and from these each run learns where it starts. So no task holds a day, however many events it has.
    """
    at = F.col(ts) + F.expr(f"INTERVAL {offset_hours} HOURS")
    if releases is None:
        return ranked_within(events.withColumn("day", F.to_date(at)), ["day"], [ts, id], "used").withColumn("admitted", F.col("used") <= cap)
    rows = ranked_within(events.withColumn("day", F.to_date(at)).withColumn("_gone", F.coalesce(releases, F.lit(False))), ["day"], [ts, id], "_n")
    rows = rows.withColumn("_run", F.floor((F.col("_n") - 1) / STEPS))
    step = F.struct(F.when(F.col("_gone"), -1).otherwise(1).cast("long").alias("add"), F.lit(0).cast("long").alias("low"), F.lit(cap).cast("long").alias("high"))
    starts = _starts(rows.select("day", F.col("_n").alias("at"), step.alias("step")), cap)
    runs = rows.groupBy("day", "_run").agg(F.array_sort(F.collect_list(F.struct("_n", "_gone"))).alias("events")).join(starts, ["day", "_run"])

    def after(acc: Column, e: Column) -> Column:
        x = F.when(e["_gone"], F.greatest(acc["x"] - 1, F.lit(0))).otherwise(F.least(acc["x"] + 1, F.lit(cap)))
        row = F.struct(e["_n"].alias("_n"), x.alias("used"), F.when(~e["_gone"], acc["x"] < cap).alias("admitted"))
        return F.struct(x.cast("long").alias("x"), F.concat(acc["out"], F.array(row)).alias("out"))

    none = F.struct(F.col("start").alias("x"), F.array().cast("array<struct<_n:bigint,used:bigint,admitted:boolean>>").alias("out"))
    told = runs.select("day", F.explode(F.aggregate("events", none, after, lambda acc: acc["out"])).alias("e")).select(F.col("day").alias("_day"), "e.*")
    return rows.join(told.withColumnRenamed("_n", "_k"), F.col("day").eqNullSafe(F.col("_day")) & (F.col("_n") == F.col("_k"))).drop("_n", "_k", "_day", "_gone", "_run")


def _then(a: Column, b: Column) -> Column:
    """The clamp that does ``a`` and then ``b``: x -> min(max(x + add, low), high)."""
    held = lambda x: F.least(F.greatest(x + b["add"], b["low"]), b["high"])
    return F.struct((a["add"] + b["add"]).alias("add"), held(a["low"]).alias("low"), held(a["high"]).alias("high"))


def _starts(steps: DataFrame, cap: int) -> DataFrame:
    """(day, _run, start): the counter before each run of ``STEPS`` steps (day, at from 1, step)."""
    same = F.struct(F.lit(0).cast("long").alias("add"), F.lit(0).cast("long").alias("low"), F.lit(cap).cast("long").alias("high"))
    runs = steps.groupBy("day", F.floor((F.col("at") - 1) / STEPS).alias("_run")).agg(F.array_sort(F.collect_list(F.struct("at", "step"))).alias("s"))
    runs = workspace.written(runs.select("day", "_run", F.aggregate("s", same, lambda acc, x: _then(acc, x["step"])).alias("step")), "runs")
    if (runs.agg(F.max("_run")).first()[0] or 0) < STEPS:
        above = runs.select("day", F.lit(0).cast("long").alias("_above"), "_run", "step").withColumn("start", F.lit(0).cast("long"))
    else:
        higher = _starts(runs.select("day", (F.col("_run") + 1).alias("at"), "step"), cap).withColumnRenamed("_run", "_above")
        above = runs.withColumn("_above", F.floor(F.col("_run") / STEPS)).join(higher, ["day", "_above"])
    groups = above.groupBy("day", "_above", "start").agg(F.array_sort(F.collect_list(F.struct("_run", "step"))).alias("s"))

    def go(acc: Column, x: Column) -> Column:
        y = F.least(F.greatest(acc["x"] + x["step"]["add"], x["step"]["low"]), x["step"]["high"])
        return F.struct(y.alias("x"), F.concat(acc["out"], F.array(F.struct(x["_run"].alias("_run"), acc["x"].alias("start")))).alias("out"))

    none = F.struct(F.col("start").alias("x"), F.array().cast("array<struct<_run:bigint,start:bigint>>").alias("out"))
    return groups.select("day", F.explode(F.aggregate("s", none, go, lambda acc: acc["out"])).alias("r")).select("day", "r._run", "r.start")
