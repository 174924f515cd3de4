"""Text functions as Column builders: all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
#: Ideographs and word tokens of the token estimate; cue words of English; words that ask for the present (fixed values).
IDEOGRAPHS, WORD = "㐀-䶿一-鿿豈-﫿", r"[A-Za-z0-9_]+(?:[./%-][A-Za-z0-9_]+)*"
ENGLISH = r"(?i)\b(?:the|and|of|for|report|statement|total|amount|year|date|income|balance)\b"
PRESENT = "今天|今日|现在|当前|实时|最新|本周|本月|today|current|latest|real.?time"
#: Tokens of the index, of contexts and of sessions; standard numbers (fixed values).
INDEX_TOKEN, CONTEXT_TOKEN, SESSION_TOKEN = r"[a-z0-9]+(?:[×*./-][a-z0-9]+)*", r"[a-z0-9]+(?:[._/-][a-z0-9]+)*", r"[a-z0-9_./%-]+"
STANDARD = r"\b(?:[A-Z]{2,4}(?:/[A-Z])?)\s?[0-9]{2,6}(?:\.[0-9]+)?(?:-[0-9]{4})?\b"
#: Stop words of the session's terms (fixed values).
STOP = "the a an of in on at to for from and or is are was were be by with this that it its what which how".split()


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def counted(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def grams(run: Column, n: int, least: int = 0) -> Column:
    """All runs of n characters; ``least``: that many positions at least, even if they are shorter."""
    last = F.greatest(F.length(run) - (n - 1), F.lit(least))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(run, i, n))).otherwise(F.array().cast("array<string>"))


def folded(text: Column) -> Column:
    """Case folding of Latin text: lower case, and the sharp s as two."""
    return F.regexp_replace(F.lower(text), "ß", "ss")


def tokens(text: Column) -> Column:
    """F01. The index's tokens, repeats kept: Latin runs joined by ``×*./-``, then each Han character and pair."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[®™©]", ""), "㎜", "mm")
    han = F.transform(found(low, HAN + "+"), lambda run: F.concat(grams(run, 1), grams(run, 2)))
    return F.concat(found(low, INDEX_TOKEN), F.flatten(han))


def context_terms(text: Column) -> Column:
    """F02. Folded Latin tokens of 2 or more, Han runs of up to 4 whole and all pairs; distinct."""
    value = folded(F.coalesce(text, F.lit("")))
    latin = F.filter(found(value, CONTEXT_TOKEN), lambda t: F.length(t) >= 2)
    runs = found(value, HAN + "+")
    return F.array_distinct(F.concat(latin, F.filter(runs, lambda r: F.length(r) <= 4), F.flatten(F.transform(runs, lambda r: grams(r, 2)))))


def session_terms(text: Column) -> Column:
    """F03. Lower-case Latin runs with ``_./%-``, without stop words; Han runs of 2 or more, and their pairs; distinct."""
    text = F.coalesce(text, F.lit(""))
    latin = F.filter(found(F.lower(text), SESSION_TOKEN), lambda t: ~t.isin(STOP))
    runs = found(text, HAN + "{2,}")
    return F.array_distinct(F.concat(latin, runs, F.flatten(F.transform(runs, lambda r: grams(r, 2)))))


def plain_terms(text: Column, least: int = 1, pairs_of_one: bool = True, more: Column | None = None) -> Column:
    """F04. Folded ``[a-z0-9]`` runs of ``least`` or more and Han pairs (of one character: itself, if asked); distinct."""
    text = F.coalesce(text, F.lit(""))
    runs = found(text, HAN + "+")
    pairs = F.flatten(F.transform(runs, lambda r: grams(r, 2, 1 if pairs_of_one else 0)))
    return F.array_distinct(F.concat(found(folded(text), f"[a-z0-9]{{{least},}}"), pairs))


def web_terms(text: Column, synonyms: list[list[str]] = (), stop: list[str] = ()) -> Column:
    """F04. Folded Latin tokens of 2 or more, Han pairs and triples, all of a synonym group if one occurs; without ``stop``."""
    text = F.coalesce(text, F.lit(""))
    runs = found(text, HAN + "+")
    parts = [found(folded(text), r"[a-z0-9][a-z0-9._/-]{1,}"), F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3))))]
    for group in synonyms:
        some = F.lit(False)
        for term in group:
            some = some | F.contains(text, F.lit(term))
        parts.append(F.when(some, F.array(*map(F.lit, group))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.concat(*parts), lambda t: (F.length(t) >= 2) & (~t.isin(list(stop)) if stop else F.lit(True))))


def specific_pairs(text: Column, generic: list[str]) -> Column:
    """F05. Distinct Han pairs that aren't generic."""
    return F.array_except(F.flatten(F.transform(found(text, HAN + "+"), lambda r: grams(r, 2))), F.array(*map(F.lit, generic)).cast("array<string>"))


def with_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """F06. The text, and the name of each alias that occurs in it where the name doesn't."""
    extra = [F.when(F.contains(F.lower(text), F.lit(a.lower())) & ~F.contains(F.lower(text), F.lit(name.lower())), F.lit(name)) for a, name in aliases.items()]
    return F.concat_ws(" ", text, F.array_distinct(F.filter(F.array(*extra), lambda x: x.isNotNull())))


def compact(text: Column) -> Column:
    """F07. Lower case without white space and ®."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s®]+", "")


def bare(text: Column) -> Column:
    """F07. Lower case, Latin letters, digits and Han only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def squeezed(text: Column) -> Column:
    """F09. White space squeezed, none between Han characters."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.regexp_replace(one, f"(?<={HAN}) (?={HAN})", "")


def estimated_tokens(text: Column) -> Column:
    """F10. Han characters, quarters of Latin tokens rounded up, half the other signs rounded up; 1 at least, 0 if empty."""
    han = IDEOGRAPHS
    latin = F.aggregate(found(text, WORD), F.lit(0).cast("long"), lambda a, t: a + F.ceil(F.length(t) / 4))
    total = counted(text, f"[{han}]") + latin + F.ceil(counted(text, rf"[^\sA-Za-z0-9_{han}]") / 2)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1), total).cast("long"))


#: Scripts: code, name, pattern (fixed values).
SCRIPTS = [
    ("zh", "Hani", r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"),
    ("ja", "Jpan", r"[\x{3040}-\x{30ff}]"),
    ("ko", "Hang", r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]"),
    ("ar", "Arab", r"[\x{0600}-\x{06ff}\x{0750}-\x{077f}]"),
    ("he", "Hebr", r"[\x{0590}-\x{05ff}]"),
    ("und", "Deva", r"[\x{0900}-\x{097f}]"),
    ("th", "Thai", r"[\x{0e00}-\x{0e7f}]"),
    ("und", "Cyrl", r"[\x{0400}-\x{052f}]"),
    ("und", "Grek", r"[\x{0370}-\x{03ff}]"),
    ("und", "Latn", r"[A-Za-zÀ-ÖØ-öø-ÿ]"),
]


def scripts(text: Column) -> Column:
    """F11. array<struct<n, order, code, script, confidence>> of up to 3 scripts, the most frequent first; Han counts as
    Japanese where there is kana, Latin as English only with cue words; a text of other signs is ``und``."""
    text = F.coalesce(text, F.lit(""))
    read = F.struct(*(counted(text, p).alias(name) for _, name, p in SCRIPTS), text.rlike(ENGLISH).alias("english"))
    return F.when(F.trim(text) == "", F.array().cast("array<struct<n:int,order:int,code:string,script:string,confidence:double>>")).otherwise(F.get(F.transform(F.array(read), _ranked), F.lit(0)))


def _ranked(read: Column) -> Column:
    """What ``scripts`` makes of the numbers of signs, which are counted once."""
    n = {name: read[name] for _, name, _ in SCRIPTS}
    both = n["Jpan"] > 0
    n["Hani"], n["Jpan"] = F.when(both, 0).otherwise(n["Hani"]), F.when(both, n["Jpan"] + n["Hani"]).otherwise(0)
    total = sum(n.values(), F.lit(0))
    rows = []
    for order, (code, name, _) in enumerate(SCRIPTS):
        code = F.when(read["english"], "en").otherwise("und") if name == "Latn" else F.lit(code)
        # folded kana and Han come last among equals
        place = 99 if name == "Jpan" else order
        share = F.least(F.lit(0.99), F.greatest(F.lit(0.2), n[name] / F.greatest(total, F.lit(1))))
        rows.append(F.struct((-n[name]).alias("n"), F.lit(place).alias("order"), code.alias("code"), F.lit(name).alias("script"), F.round(share, 3).alias("confidence")))
    ranked = F.slice(F.array_sort(F.filter(F.array(*rows), lambda r: r["n"] < 0)), 1, 3)
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("order"), F.lit("und").alias("code"), F.lit("Zyyy").alias("script"), F.lit(0.2).alias("confidence")))
    return F.when(F.size(ranked) == 0, none).otherwise(ranked)


def excerpt(html: Column) -> Column:
    """S10. Table cells end in `` | ``, rows, paragraphs and divisions in a line feed; tags go, common entities are read, blanks squeezed."""
    x = F.regexp_replace(html, r"(?i)</(?:td|th)>", " | ")
    x = F.regexp_replace(x, r"(?i)</(?:tr|p|div)>", "\n")
    x = unescaped(F.regexp_replace(x, r"<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")


def unescaped(x: Column) -> Column:
    """The five entities of XML and the no-break space."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return x


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def standard_codes(text: Column) -> Column:
    """F21. Standard numbers such as ``GB/T 1234-2020``, upper case, without blanks; distinct in order."""
    codes = found(F.upper(text), STANDARD)
    return F.array_distinct(F.transform(codes, lambda c: F.regexp_replace(c, r"\s", "")))


def blocks(text: Column) -> Column:
    """F26. Paragraphs with list marks, ``|`` or table marks whole; others by sentence, the end sign kept."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    whole = lambda p: p.rlike(r"^\s*(?:[0-9]+[.、)]|[一二三四五六七八九十]+[、.]|\[ROW|\[TABLE)") | F.contains(p, F.lit("|"))
    sentences = lambda p: F.filter(F.transform(F.split(p, r"(?<=[。！？!?])\s*"), lambda x: F.trim(x)), lambda s: s != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(whole(p), F.array(p)).otherwise(sentences(p))))


def heading_only(text: Column) -> Column:
    """P17. One line of up to 60 characters without sentence signs or quantities that looks like a numbered heading."""
    t = F.trim(F.coalesce(text, F.lit("")))
    plain = ~t.rlike(r"[。！？.!?；;：:]|[0-9]+\s*(?:mm|kg|%|℃)")
    return (t != "") & (F.length(t) <= 60) & ~F.contains(t, F.lit("\n")) & plain & t.rlike(r"^(?:[一二三四五六七八九十]+[、.]|[0-9]+[.、]\s*|第.+[章节])")
