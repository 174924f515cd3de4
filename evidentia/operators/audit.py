"""Checks of written answers against their evidence, and citations.

An answer's numbers are rows, with their place and the words around them; so are the numbers of its evidence, under each
key that may back a claim: as they are written, and rounded to fewer places. A claim is backed if it meets its evidence in
an equi join on such a key. Nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .spread import spread

#: A number with its sign, thousands and percent sign, not inside a word; spellings of percent; claims that only evidence may make;
#: words that say that a positive number is a loss; what ends a sentence (fixed values).
NUMBER = r"(?<![A-Za-z0-9])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
PERCENTS = (r"(?i)(\d+(?:\.\d+)?)\s*(?:per\s+cent|percent|pour\s+cent|prozent)\b", r"百分之\s*(\d+(?:\.\d+)?)", "()％")
PROMISES = (
    "绝对最好", "零风险", "永久", "完全替代", "必然通过", "无需维护", "免维护", "最耐久", "使用寿命更长",
    "维护成本更低", "适用范围更广", "性能更优", "明显优于", "最佳", "最优", "最高", "最强",
)
LOSS = ("亏损", "损失", "赤字", "负值", "净流出")
ENDS = "。！？；;：:.!?"
#: Characters around a number that say what it is; places that numbers are rounded to at most.
AROUND, PLACES = 24, 9
_NONE = "array<string>"


def terms(text: Column) -> Column:
    """Distinct Latin words of three letters, numbers, and pairs of Han characters."""
    return F.array_distinct(F.concat(T.found(F.lower(text), r"[a-z]{3,}|\d+(?:\.\d+)?%?"), T.found(text, f"(?=({T.HAN}{{2}}))", 1)))


def _plain(text: Column) -> Column:
    """One spelling of percentages, and escaped white space before a number as a blank."""
    return reduce(lambda t, p: F.regexp_replace(t, p, "$1%"), PERCENTS, F.regexp_replace(text, r"\\[nrt](?=[-+]?\d)", " "))


def numbers(text: Column) -> Column:
    """array<struct<at, token, before, after>> of a text's numbers, with the text on both sides of each."""
    pieces = F.arrays_zip(F.split(text, NUMBER, -1).alias("gap"), T.found(text, NUMBER).alias("token"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,token:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        row = F.struct(at.alias("at"), x["token"].alias("token"))
        return F.struct((at + F.coalesce(F.length(x["token"]), F.lit(0))).alias("at"), F.when(x["token"].isNotNull(), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    def seen(x: Column) -> Column:
        end = x["at"] + F.length(x["token"])
        return F.struct(x["at"].alias("at"), x["token"].alias("token"), F.substr(text, F.lit(1), x["at"]).alias("before"), F.substr(text, end + 1).alias("after"))

    return F.transform(F.aggregate(pieces, start, step, lambda acc: acc["out"]), seen)


def _only_numbers_an_item(x: Column) -> Column:
    """A number of one or two digits, before a sign of a list, where a line or sentence begins; a closing bracket may have its opening one."""
    begins = rf"(?:^|\n|[{ENDS}])\s*$"
    opened = rf"(?:^|\n|[{ENDS}])\s*[(（]\s*$"
    sign = F.substring(x["after"], 1, 1)
    return x["token"].rlike(r"^\d{1,2}$") & ((sign.isin(".", "、", ")", "）") & x["before"].rlike(begins)) | (sign.isin(")", "）") & x["before"].rlike(opened)))


def _place(x: Column) -> Column:
    """``row`` or ``page`` where the words beside a number make it that of one, else null."""
    near, next_ = F.lower(F.right(x["before"], F.lit(AROUND))), F.substring(x["after"], 1, 3)
    th = near.rlike(r"第\s*$")
    return F.when(near.rlike(r"\brow\s*$") | (th & next_.rlike(r"^\s*行")), "row").when(near.rlike(r"\bpage\s*$") | (th & next_.rlike(r"^\s*页")), "page")


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))


def _places(token: Column) -> Column:
    return F.length(F.regexp_extract(token, r"\.(\d+)", 1))


def _value(token: Column) -> Column:
    return F.when(~token.endswith("%"), token.try_cast("decimal(38,12)"))


def evidence_keys(token: Column) -> Column:
    """What a number of the evidence backs: itself as written; itself with fewer places, rounded half up; and, if it is negative, its
    size as a loss, with any places up to its own."""
    y = _value(token)
    rounded = lambda kind, v: F.array(*(F.when(_places(token) > p, _key(kind, F.lit(p), F.round(v, p).cast("decimal(38,12)"))) for p in range(PLACES)))
    size = F.when(y < 0, -y)
    return F.array_compact(F.concat(F.array(_key("as", token)), rounded("round", y), F.when(size.isNotNull(), F.concat(rounded("loss", size), F.array(_key("size", size)))).otherwise(F.array().cast(_NONE))))


def claim_keys(token: Column, loss: Column) -> Column:
    """Keys of the evidence, one of which backs this number. A percentage only as it is written."""
    x, p = _value(token), _places(token)
    rounded = F.array(_key("round", p, x))
    lost = F.when(loss & (x >= 0), F.array(_key("loss", p, x), _key("size", x))).otherwise(F.array().cast(_NONE))
    return F.concat(F.array(_key("as", token)), F.when(x.isNotNull(), F.concat(rounded, lost)).otherwise(F.array().cast(_NONE)))


def claims(answers: DataFrame) -> DataFrame:
    """(id, token, at, place, loss): the numbers that an answer claims, with what they are called; each as often as it stands there.
    answers: id, answer, names (array of source names, whose digits claim nothing)."""
    longest_first = F.array_sort(F.filter(F.coalesce("names", F.array().cast(_NONE)), lambda n: n != ""), lambda a, b: F.length(b) - F.length(a))
    view = F.aggregate(longest_first, F.coalesce("answer", F.lit("")), lambda t, n: F.replace(t, n, F.lit("[SOURCE]")))
    rows = answers.select("id", _plain(view).alias("view")).select("id", F.explode(F.filter(numbers(F.col("view")), lambda x: ~_only_numbers_an_item(x))).alias("x"))
    near = F.concat(F.right("x.before", F.lit(AROUND)), "x.token", F.substring("x.after", 1, AROUND))
    return rows.select("id", F.col("x.token").alias("token"), F.col("x.at").alias("at"), _place(F.col("x")).alias("place"), near.rlike("|".join(LOSS)).alias("loss"))


def unsupported_numbers(answers: DataFrame) -> DataFrame:
    """(id, token, at): the numbers of an answer that its evidence doesn't back, each once, at its first place.

    answers: id, answer, evidence, names. A number that names a row or page of the evidence needs no other backing there.
    """
    said = F.coalesce("evidence", F.lit(""))
    cells, pages = T.found(said, r"\b[A-Z]{1,3}(\d+)(?:\[[^\]]*\])?=", 1), T.found(said, r"(?i)\bpage(?:_number)?\s*[=:]\s*(\d+)", 1)
    places = answers.select("id", F.explode(F.array_distinct(F.concat(F.transform(cells, lambda n: _key("row", n)), F.transform(pages, lambda n: _key("page", n))))).alias("key"))
    asked = claims(answers).withColumn("key", F.when(F.col("place").isNotNull(), F.concat_ws(":", "place", "token")).otherwise(""))
    asked = asked.join(places, ["id", "key"], "left_anti")
    # a number is a loss wherever it stands if it is one somewhere
    asked = asked.groupBy("id", "token").agg(F.min("at").alias("at"), F.bool_or("loss").alias("loss")).withColumn("bare", F.replace("token", F.lit(","), F.lit("")))
    have = answers.select("id", F.explode(F.array_distinct(F.transform(T.found(_plain(said), NUMBER), lambda n: F.replace(n, F.lit(","), F.lit(""))))).alias("n"))
    have = have.select("id", F.explode(evidence_keys(F.col("n"))).alias("key")).distinct()
    backed = asked.select("id", "token", F.explode(claim_keys(F.col("bare"), F.col("loss"))).alias("key")).join(have, ["id", "key"], "left_semi")
    return asked.join(backed.select("id", "token").distinct(), ["id", "token"], "left_anti").select("id", "token", "at")


def support_audit(answers: DataFrame) -> DataFrame:
    """D23, D24. (id, overlap, numbers, promises, passed, kept): terms that answer and evidence share, numbers and promises that the cited
    evidence doesn't back, in order of the text and of ``PROMISES``, whether it passes, and the answer without clauses of such numbers.

    answers: id (its key), answer, evidence, names (array); nulls are empty.
    """
    answer, said = F.coalesce("answer", F.lit("")), F.coalesce("evidence", F.lit(""))
    bad = unsupported_numbers(answers).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("numbers"))
    promised = F.filter(F.array(*map(F.lit, PROMISES)), lambda p: F.contains(answer, p) & ~F.contains(said, p))
    rows = answers.join(bad, "id", "left").withColumn("numbers", F.coalesce("numbers", F.array().cast(_NONE)))
    rows = rows.withColumn("overlap", F.size(F.array_intersect(terms(answer), terms(said)))).withColumn("promises", promised)
    passed = (F.col("overlap") > 0) & (F.size("numbers") == 0) & (F.size("promises") == 0)
    return rows.select("id", "overlap", "numbers", "promises", passed.alias("passed"), without_clauses(answer, F.col("numbers")).alias("kept"))


#: Written between two clauses; no text has it.
_CUT = "\x01"
_ITEM = r"\d{1,2}\s*[.、)）]"


def _sentences(text: Column) -> Column:
    """Sentences with their ends: after a full stop of any script, or a dot between a word and what begins a sentence or item."""
    marked = F.regexp_replace(text, "([。！？!?；;])", "$1" + _CUT)
    marked = F.regexp_replace(marked, r"([A-Za-z]\.)(?=\s+[A-Z0-9])|(\.)(?=\s+\d{1,2}[.)]\s)", "$1$2" + _CUT)
    return F.filter(F.split(marked, _CUT), lambda s: F.trim(s) != "")


def without_clauses(answer: Column, unsupported: Column) -> Column:
    """D24. The answer without the clauses that hold one of the numbers: a numbered item but for its heading, else the parts between
    commas. What is left is punctuated and numbered anew; without such numbers it is the answer."""
    answer = F.coalesce(answer, F.lit(""))
    any_of = F.concat(F.lit(r"(?<![\d.])(?:"), F.array_join(F.transform(unsupported, lambda n: F.regexp_replace(n, r"([.+\-])", r"\\$1")), "|"), F.lit(r")(?!\d|\.\d)"))
    holds = lambda s: F.regexp_like(s, any_of)

    def left_of(s: Column, several: Column) -> Column:
        item = rf"^(.*?)(?:^|[:：]\s*){_ITEM}"
        heading = F.trim(F.regexp_extract(F.trim(s), rf"(?s)^(.*?)[:：]\s*{_ITEM}", 1))
        headed = F.when(heading != "", F.concat(heading, F.lit("："))).otherwise("")
        parts = F.filter(F.split(F.regexp_replace(s, r"(，)|(?<!\d)(,)(?!\d)", "$1$2" + _CUT), _CUT), lambda c: (F.trim(c) != "") & ~holds(c))
        commas = F.regexp_replace(F.array_join(parts, _CUT), "(?<!，)" + _CUT, "")
        return F.when(several & F.trim(s).rlike("(?s)" + item), headed).otherwise(F.replace(commas, F.lit(_CUT), F.lit("")))

    all_of = _sentences(answer)
    kept = F.array_join(F.transform(all_of, lambda s: F.when(holds(s), left_of(s, F.size(all_of) > 1)).otherwise(s)), "")
    out = F.regexp_replace(F.trim(kept), rf"(^|[:：；;。])\s*{_ITEM}\s*", "$1")
    out = F.regexp_replace(out, r"\s*[，,]$", "。")
    shown = F.transform(T.found(out, r"(?m)^\s*(\d+)[.、]\s*", 1), lambda n: n.cast("int"))
    in_order = (F.size(shown) == 0) | (shown == F.sequence(F.lit(1), F.greatest(F.size(shown), F.lit(1))))
    out = F.when(in_order, out).otherwise(F.regexp_replace(out, r"(?m)^\s*\d+[.、]\s*", "- "))
    return F.when(F.size(unsupported) == 0, answer).otherwise(out)


def coverage_contract(aspects: DataFrame, claims: DataFrame, answers: DataFrame, cited: DataFrame) -> DataFrame:
    """D25. (answer, aspect, state): ``covered`` where a claim on the aspect quotes the answer and all of its evidence is cited,
    ``missing`` where it quotes the answer's statement that evidence is missing, else ``unaccounted``.

    aspects: answer, aspect; claims: answer, aspect, position, quote, status (answered or evidence_missing), evidence (array);
    answers: answer, reply; cited: answer, evidence_id. The first valid claim by position counts.
    """
    rows = claims.join(answers, "answer").where((F.trim("quote") != "") & F.contains("reply", F.col("quote")))
    ids = rows.select("answer", "aspect", "position", F.explode("evidence").alias("evidence_id"))
    found = ids.join(cited.select("answer", "evidence_id").distinct().withColumn("in", F.lit(1)), ["answer", "evidence_id"], "left")
    backed = found.groupBy("answer", "aspect", "position").agg(F.bool_and(F.col("in").isNotNull()).alias("all"))
    rows = rows.join(backed, ["answer", "aspect", "position"], "left")
    state = F.when(F.col("status") == "evidence_missing", "missing").when((F.col("status") == "answered") & F.coalesce("all", F.lit(False)), "covered")
    first = rows.withColumn("state", state).where("state is not null").groupBy("answer", "aspect").agg(F.min_by("state", "position").alias("state"))
    return aspects.join(first, ["answer", "aspect"], "left").select("answer", "aspect", F.coalesce("state", F.lit("unaccounted")).alias("state"))


#: What makes two references one citation (fixed values).
CITATION = ("evidence_id", "document_name", "source_page", "sheet_name", "source_range", "section_heading")


def citations(requests: DataFrame, references: DataFrame, answer: str = "answer", like: DataFrame | None = None) -> DataFrame:
    """D26. Each answer's references in order of its requests, distinct by the six fields of ``CITATION`` (nulls are equal), the first of
    equals. requests: answer, evidence_id, position; references: evidence_id, ordinal and the other five. Adds ``n``, from 1.
    They are dealt out by answer once, in tasks by the rows of ``like`` (a table with as many rows as requests) if it is given."""
    rows = requests.join(references, "evidence_id")
    rows = spread(rows, like, answer, each=200_000) if like is not None else rows
    w = Window.partitionBy(answer, *CITATION).orderBy("position", "ordinal")
    one = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.withColumn("n", F.row_number().over(Window.partitionBy(answer).orderBy("position", "ordinal"))).select(answer, "n", *CITATION)


def located_citations(chunks: DataFrame, locations: DataFrame, most: int = 8) -> DataFrame:
    """D33. (chunk, n, page, sheet, range, heading): the known places of a chunk's references in order, distinct, ``most`` at most; a chunk
    without any gets one row that only names the chunk. chunks: chunk, refs (array); locations: ref, page, sheet, range, heading."""
    refs = chunks.select("chunk", F.posexplode("refs").alias("i", "ref")).join(locations, "ref")
    keys = ["page", "sheet", "range", "heading"]
    one = refs.groupBy("chunk", *keys).agg(F.min("i").alias("i")).withColumn("n", F.row_number().over(Window.partitionBy("chunk").orderBy("i"))).where(F.col("n") <= most)
    out = chunks.select("chunk").join(one, "chunk", "left")
    return out.select("chunk", F.coalesce("n", F.lit(1)).alias("n"), "page", "sheet", "range", F.when(F.col("n").isNull(), F.col("chunk").cast("string")).otherwise(F.col("heading")).alias("heading"))


#: Quantities asked for: marks of the question, marks that the evidence must share, and their values with units (fixed values).
DIMENSIONS = {
    "time": (("多久", "几天", "多少天", "多少小时", "养护期", "时间", "何时"), ("养护期", "养护", "干燥", "等待", "可使用时间"), r"\d+(?:\.\d+)?(?:\s*[～~\-—至]\s*\d+(?:\.\d+)?)?\s*(?:年|个?月|天|日|小时|分钟|秒|h|min|s)"),
    "length": (("宽度", "深度", "厚度", "间距", "尺寸", "长度", "高度", "直径"), ("宽度", "缝宽", "深度", "厚度", "间距", "尺寸", "长度", "高度", "直径"), r"\d+(?:\.\d+)?(?:\s*[～~\-—至]\s*\d+(?:\.\d+)?)?\s*(?:㎜|mm|cm|m(?![2²³])|毫米|厘米|米)"),
    "ratio": (("比例", "占比", "百分比", "坡度", "配比", "比率"), ("比例", "占比", "百分比", "坡度", "配比", "比率"), r"(?:\d+(?:\.\d+)?\s*(?:%|％)|\d+(?:\.\d+)?\s*[:：]\s*\d+(?:\.\d+)?)"),
    "count": (("数量", "多少个", "几个", "多少块", "几块", "多少支", "几支"), ("数量", "个", "块", "支", "套", "件", "根", "枚", "处", "项"), r"\d+(?:\.\d+)?\s*(?:个|块|支|套|件|根|枚|处|项)(?:\s*[/／]\s*(?:m[2²]|㎡|平方米|块))?"),
    "temperature": (("温度", "摄氏", "℃", "°c"), ("温度",), r"-?\d+(?:\.\d+)?\s*(?:℃|°\s*[Cc]|摄氏度)"),
    "area": (("面积", "多少平方米", "多少㎡", "多少m2", "多少m²"), ("面积", "平方米", "㎡"), r"\d+(?:\.\d+)?(?:\s*[～~\-—至]\s*\d+(?:\.\d+)?)?\s*(?:m[2²]|㎡|平方米)"),
}


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def dimension_values(question: Column, text: Column) -> Column:
    """P15. Values of the quantities that a question asks for: null if it asks for none; empty unless every quantity asked for has a value
    in the text, and the text one of the marks that the question uses for it."""
    q, t = F.lower(F.coalesce(question, F.lit(""))), F.coalesce(text, F.lit(""))
    asked, fits, values = F.lit(False), F.lit(True), []
    for marks, meaning, pattern in DIMENSIONS.values():
        own = _has(q, marks)
        shared = F.lit(False)
        for m in meaning:
            shared = shared | (F.contains(q, F.lit(m)) & F.contains(F.lower(t), F.lit(m)))
        found = F.regexp_extract_all(t, F.lit("(?i)" + pattern), F.lit(0))
        asked, fits = asked | own, fits & (~own | ((F.size(found) > 0) & (~_has(q, meaning) | shared)))
        values.append(F.when(own, found).otherwise(F.array().cast("array<string>")))
    return F.when(asked, F.when(fits, F.concat(*values)).otherwise(F.array().cast("array<string>")))


#: What a passage begins with that continues another, what that one ends with, and words that ask for two values (fixed values).
CONTINUES, LEADS, EACH = r"^[，,。；;：:]?的", r"(?:基层|墙体|混凝土)$", ("分别", "各自", "各是多少")


def numeric_passages(passages: DataFrame) -> DataFrame:
    """D36. (query_id, id, text): the first passage of each query, by rank, that has the values asked for (two where the question asks for
    each). A passage that begins as a continuation is first joined to the first one of its document, by rank, that ends as its start.

    passages: query_id, question, rank, id, document, text.
    """
    body = F.trim("text")
    leads = passages.where(body.rlike(LEADS)).groupBy("query_id", "document").agg(F.min_by(F.struct(F.col("id").alias("lead"), body.alias("before")), "rank").alias("l"))
    rows = passages.join(leads, ["query_id", "document"], "left")
    joins = body.rlike(CONTINUES) & F.col("l").isNotNull() & (F.col("l.lead") != F.col("id"))
    rows = rows.withColumn("text", F.when(joins, F.concat("l.before", body)).otherwise(F.col("text")))
    values = dimension_values(F.col("question"), F.col("text"))
    good = F.size(F.coalesce(values, F.array().cast("array<string>"))) >= F.when(_has(F.col("question"), EACH), 2).otherwise(1)
    return rows.where(good).groupBy("query_id").agg(F.min_by(F.struct("id", "text"), "rank").alias("p")).select("query_id", "p.id", "p.text")
