"""Secrets in texts: stated patterns, and tokens that look random by a battery of tests.

Everything here is columns and SQL functions. Positions come from the pieces that
a pattern matches and the pieces between them: their lengths add up to offsets in
code points.

The battery measures how far each candidate token is from characters drawn at
random from the alphabet of its inferred encoding: a chi-squared test of uniformity,
a runs test about the alphabet's middle, and a test of serial correlation, combined
by Fisher's method. A key is near, words and identifiers are far.

What is reported is controlled, by decoys. The null hypothesis is that a token is
an ordinary identifier; its decoys are identifiers made of the document's own words
in the usual styles, as long as the token and with its digits and its case. The share
of decoys of the token's class of length that look as random as it does is its
p-value, so short tokens, of which the battery can say little, need to stand out as
much as long ones; Benjamini and Hochberg's procedure on these p-values bounds the
false discoveries among the tokens reported in each class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Patterns, in the order of the kinds. The last two are maximal runs, so a least length drops the same ones.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Candidates of the battery; the shortest, classes of length, and the false-discovery rate.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
CLASSES = (20, 28, 40, 64)
RATE = 0.05
#: Decoys of a token, whatever its length and however many its document has.
DECOYS = 24
#: Words for decoys in a document that has fewer than ``LEAST`` (fixed).
LEAST = 12
PLAIN = "it was a bright morning and the people of the town were going to the market to buy bread and fruit for the long winter that was to come "
#: Pieces that positions are summed over at once, and code points of a text that are replaced at once.
CHUNK, WIDE = 256, 4096
KINDS = ("assign", "access", "hex", "random")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets by encoding, the narrowest first.
ALPHABETS = {"hex": _DIGITS + "abcdef", "upper hex": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "upper base36": _DIGITS + _UPPER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _DIGITS + _UPPER + _LOWER + "+/", "base64url": _DIGITS + _UPPER + _LOWER + "-_", "any": _DIGITS + _UPPER + _LOWER + "+/-_"}
#: Bins of -log2 p, eighths, up to 2 ** -128.
_BINS = 1024


_NONE = "array<struct<s:int,e:int,kind:int,token:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """array<struct<s, e, kind, token>> of the leftmost matches that don't overlap; offsets in code points, the end
    excluded. ``least``: characters of ``group`` at least; matches that fail it are passed over.

    Positions are summed within chunks of pieces and over chunks, so a text with very
    many matches costs in proportion to them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), inner.alias("own"))
    none = F.array().cast(_NONE)
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        row = F.struct(s.alias("s"), (acc["at"] + size(x)).alias("e"), F.lit(kind).alias("kind"), x["hit"].alias("token"))
        good = x["hit"].isNotNull() & (F.length(x["own"]) >= least)
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(good, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    def summed(chunks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        first = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + size(x))), zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, first, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    chunks = _let(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(CHUNK)), lambda i: F.slice(p, i, F.lit(CHUNK))))
    return F.when(text.rlike(pattern), _let(chunks, summed)).otherwise(none)


def _phi(z: Column) -> Column:
    """The chance that a normal value is as far from 0 as z, to three digits."""
    z = F.abs(z)
    return F.least(F.lit(1.0), 2 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(600.0)))))


def _above(z: Column) -> Column:
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-600.0)), F.lit(600.0))))


def _with(x: Column, *keep: str, **more: Column) -> Column:
    return F.struct(*(x[k].alias(k) for k in keep), *(v.alias(k) for k, v in more.items()))


def _tested(tokens: Column) -> Column:
    """Spans (s, e, kind, token) with the battery's p-value and the class of length.

    Step by step, each naming what the next uses, so that the expression grows with
    the steps and an alphabet is inferred once a token.
    """

    def encoding(x: Column) -> Column:
        alphabet = F.lit(ALPHABETS["any"])
        for name in reversed(list(ALPHABETS)[:-1]):
            alphabet = F.when(F.translate(x["token"], ALPHABETS[name], "") == "", F.lit(ALPHABETS[name])).otherwise(alphabet)
        return _with(x, "s", "e", "kind", "token", alphabet=alphabet)

    def counts(x: Column) -> Column:
        k = F.length(x["alphabet"]).cast("double")
        values = F.transform(F.split(x["token"], ""), lambda c: (F.instr(x["alphabet"], c) - 0.5) / F.length(x["alphabet"]))
        each = F.transform(F.split(x["alphabet"], ""), lambda c: (F.length(x["token"]) - F.length(F.replace(x["token"], c, F.lit("")))).cast("double"))
        return _with(x, "s", "e", "kind", n=F.length(x["token"]).cast("double"), k=k, values=F.filter(values, lambda v: v > 0), squares=F.aggregate(each, F.lit(0.0), lambda acc, c: acc + c * c))

    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("runs", "high", "sum", "square", "lag")), F.lit(-1.0).alias("last"), F.lit(-1.0).alias("first"))

    def step(acc: Column, v: Column) -> Column:
        begins, side = acc["last"] < 0, v >= 0.5
        return F.struct(
            (acc["runs"] + F.when(begins | (side != (acc["last"] >= 0.5)), 1.0).otherwise(0.0)).alias("runs"),
            (acc["high"] + F.when(side, 1.0).otherwise(0.0)).alias("high"),
            (acc["sum"] + v).alias("sum"),
            (acc["square"] + v * v).alias("square"),
            F.when(begins, F.lit(0.0)).otherwise(acc["lag"] + v * acc["last"]).alias("lag"),
            v.alias("last"),
            F.when(begins, v).otherwise(acc["first"]).alias("first"),
        )

    def sums(x: Column) -> Column:
        return _with(x, "s", "e", "kind", "n", "k", "squares", t=F.aggregate(x["values"], zero, step))

    def scores(x: Column) -> Column:
        n, t, dof = x["n"], x["t"], x["k"] - 1
        # chi-squared by Wilson and Hilferty's cube root; runs about the middle; serial correlation around the circle
        cube = F.pow(F.greatest(x["squares"] * x["k"] / n - n, F.lit(0.0)) / dof, F.lit(1 / 3))
        mean = 2 * t["high"] * (n - t["high"]) / n + 1
        spread = n * t["square"] - t["sum"] * t["sum"]
        lag = n * (t["lag"] + t["last"] * t["first"]) - t["sum"] * t["sum"]
        return _with(x, "s", "e", "kind", "n", chi=(cube - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof)), off=t["runs"] - mean, var=(mean - 1) * (mean - 2) / (n - 1), serial=F.when(spread > 1e-9, (lag / spread + 1 / (n - 1)) * F.sqrt(n)))

    def parts(x: Column) -> Column:
        runs = F.when(x["var"] > 0, _phi(x["off"] / F.sqrt(x["var"]))).otherwise(F.lit(0.0))
        tiny = F.lit(1e-30)
        logs = F.log(F.greatest(_above(x["chi"]), tiny)) + F.log(F.greatest(runs, tiny)) + F.log(F.greatest(F.coalesce(_phi(x["serial"]), F.lit(0.0)), tiny))
        return _with(x, "s", "e", "kind", "n", y=-logs)

    def combined(x: Column) -> Column:
        p = F.exp(-x["y"]) * (1 + x["y"] + x["y"] * x["y"] / 2)  # Fisher's method for three tests
        of = sum((F.when(x["n"] >= c, 1).otherwise(0) for c in CLASSES[1:]), F.lit(0))
        return _with(x, "s", "e", "kind", t=F.struct(p.alias("p"), of.alias("class")))

    for f in (encoding, counts, sums, scores, parts, combined):
        tokens = F.transform(tokens, f)
    return tokens


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log2(F.greatest(p, F.lit(2.0**-130))) * 8), F.lit(_BINS - 1)).cast("int")


def _decoys(tokens: Column, text: Column) -> Column:
    """Class and bin of ``DECOYS`` decoys of each token: words of the whole text from a place that a hash picks, glued in the token's case
    (mixed: each with a capital), as long as the token, its digits in the middle and at the end.

    Each decoy is made and tested by itself, so a task holds one at a time.
    """
    prose = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, TOKEN, " ")), "[^a-z]+", " "))

    def made(x: Column, own: Column, turn: Column) -> Column:
        token = x["token"]
        digits = F.regexp_replace(token, "[^0-9]", "")
        rest = F.length(token) - F.length(digits)
        begin = F.pmod(F.xxhash64(token, turn), F.size(own).cast("long")).cast("int")
        # a word is a letter at least, so as many words as letters are always enough; the sequence of a token without letters is unused
        said = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(rest - 1, F.lit(0))), lambda i: F.get(own, F.pmod(begin + i, F.size(own)))), " ")
        styled = F.when(~token.rlike("[A-Z]"), said).when(~token.rlike("[a-z]"), F.upper(said)).otherwise(F.initcap(said))
        glue = F.when(token.rlike("[_-]"), F.regexp_extract(token, "[_-]", 0)).otherwise("")
        body = F.substr(F.regexp_replace(styled, " ", glue), F.lit(1), rest)
        half, mid = F.floor(F.length(digits) / 2).cast("int"), F.floor(rest / 2).cast("int")
        out = F.concat(F.substr(body, F.lit(1), mid), F.substr(digits, F.lit(1), half), F.substr(body, mid + 1), F.substr(digits, half + 1))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), out.alias("token"))

    def binned(x: Column) -> Column:
        return F.struct(x["t"]["class"].alias("class"), _bin(x["t"]["p"]).alias("bin"))

    turns = F.sequence(F.lit(1), F.lit(DECOYS))
    every = lambda own: F.flatten(F.transform(tokens, lambda x: F.transform(turns, lambda turn: F.transform(_tested(F.array(made(x, own, turn))), binned)[0])))
    said, plain = F.split(prose, " "), F.split(F.lit(PLAIN.strip()), " ")
    return F.when(F.size(tokens) > 0, _let(F.when(F.size(said) >= LEAST, said).otherwise(plain), every)).otherwise(F.array().cast("array<struct<class:int,bin:int>>"))


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__base`` (spans of the stated patterns), ``__candidates`` (tokens with p and class) and ``__decoys`` (class
    and bin of each decoy).

    A candidate has a letter and a digit and overlaps no stated span.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.when(F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), _spans(t, ASSIGN, 0, 12, 2))
    access = F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1))
    none = F.array().cast(_NONE)
    base = F.concat(*(F.coalesce(x, none) for x in (assign, access, _spans(t, HEX, 2))))
    rows = docs.withColumn("__base", F.array_sort(base)).withColumn("__tokens", _spans(t, TOKEN, 3))
    # a run of the tokens' alphabet overlaps an access key or a hexadecimal run only if it holds it; assignments may reach further
    mixed = lambda x: x["token"].rlike("[A-Za-z]") & x["token"].rlike("[0-9]") & ~x["token"].rlike(f"{ACCESS}|{HEX}")
    rows = rows.withColumn("__tokens", F.filter("__tokens", mixed)).withColumn("__assigned", F.filter("__base", lambda b: b["kind"] == 0))
    apart = lambda x: ~F.exists("__assigned", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    rows = rows.withColumn("__tokens", F.filter("__tokens", apart))
    return rows.withColumn("__candidates", _tested(F.col("__tokens"))).withColumn("__decoys", _decoys(F.col("__tokens"), t)).drop("__tokens", "__assigned")


def limits(rows: DataFrame, rate: float = RATE) -> list[int]:
    """By class of length: the first bin of -log2 p (the battery's) whose tokens are not reported, so that the share of ordinary
    ones among those reported stays within the rate.

    The driver gets counts of ``_BINS`` bins of 4 classes, however many tokens there are.
    """
    tokens = rows.select(F.explode("__candidates").alias("c")).select(F.lit(0).alias("decoy"), F.col("c.t.class").alias("class"), _bin(F.col("c.t.p")).alias("bin"))
    decoys = rows.select(F.explode("__decoys").alias("c")).select(F.lit(1).alias("decoy"), "c.class", "c.bin")
    counts = {(r["decoy"], r["class"], r["bin"]): r["n"] for r in tokens.union(decoys).groupBy("decoy", "class", "bin").agg(F.count("*").alias("n")).collect()}
    out = []
    for c in range(len(CLASSES)):
        n, m = (sum(v for (d, k, _), v in counts.items() if (d, k) == (side, c)) for side in (0, 1))
        cut = reported = as_random = 0
        for b in range(_BINS):
            reported += counts.get((0, c, b), 0)
            as_random += counts.get((1, c, b), 0)
            if reported and (1 + as_random) / (1 + m) <= rate * reported / n:
                cut = b + 1
        out.append(cut)
    return out


def spans(rows: DataFrame, cuts: list[int]) -> Column:
    """All spans (s, e, kind) of ``found``'s rows, by start and then kind."""
    cut = F.array(*map(F.lit, cuts))
    added = F.filter("__candidates", lambda x: _bin(x["t"]["p"]) < F.get(cut, x["t"]["class"]))
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    return F.array_sort(F.concat(plain(F.col("__base")), plain(added)))


def listed(xs: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are code points of the whole text, the end excluded; spans of different
    kinds may overlap. A null or empty text has none (an empty list; its digest is
    that of the empty string). Null and repeated ids are judged row by row. Further
    columns are not read. No rows give no rows. Every token has ``DECOYS`` decoys, made of
    words of its whole text; in a text of under ``LEAST`` words they are made of ``PLAIN``.
    """
    rows = scratch.written(found(docs.select("doc_id", "text")).drop("text"), "secrets")
    base = F.transform("__base", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    n = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.array_sort(base)), 256).alias("base_sha256"), listed(spans(rows, limits(rows))).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (overlapping ones by one); all else as it is, nulls too.

    Texts are put together from parts of ``WIDE`` code points, so a long text with
    very many secrets is not copied again for each of them.
    """
    named, back = scratch.plain(docs, text)
    rows = scratch.written(found(named, text), "secrets")
    rows = rows.withColumn("__spans", spans(rows, limits(rows)))
    rows = rows.withColumn("__parts", F.when(F.size("__spans") > 0, F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % WIDE), F.lit(0))))

    def cut(part: Column, i: Column) -> Column:
        low, high = i * WIDE, i * WIDE + F.length(part)
        own = F.filter("__spans", lambda x: (x["e"] > low) & (x["s"] < high))
        # what earlier spans cover of this part; those that begin in it are marked where nothing covers their start
        start = F.struct(F.greatest(low, F.coalesce(F.array_max(F.transform(F.filter(own, lambda x: x["s"] < low), lambda x: x["e"])), low)).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            before = F.substr(part, acc["at"] - low + 1, x["s"] - acc["at"])
            fresh = x["s"] >= acc["at"]
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(before, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

        rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.when(acc["at"] < high, F.substr(part, acc["at"] - low + 1)).otherwise(""))
        return F.aggregate(F.filter(own, lambda x: x["s"] >= low), start, step, rest)

    clean = F.array_join(F.transform("__parts", cut), "")
    return back(rows.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))))
