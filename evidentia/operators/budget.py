"""A question's evidence within the budgets of two prompts: what leaves, in which order, and what stays whatever it costs (R14).

Every step of the relaxation is a place in one order of leaving per question, so running sums tell who leaves; no step is a loop over
rows. Only the choice of representatives and of the last holders of requirements goes in rounds, for all questions at once. Questions of
up to ``WHOLE`` rows are fitted in blocks of whole questions, after one shuffle; larger ones by joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D

from ..sources import workspace
from . import fitting
from .catalog import sized_broadcast
from .greedy import _running, set_cover
from .ranks import ranked_within

#: The steps in which units leave, first to last.
STEPS = ("group", "cell", "conflict", "source")
#: Places of representatives are below this, places of other rows above.
REST = 1 << 40
#: Rows of a question that a task holds at once; larger questions are many tasks' work.
WHOLE = 1 << 16


def fit(rows: DataFrame, audit: int, final: int, members: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """R14. (query_id, id, kept, step, reduced, members_left) for every row. A question whose rows fit both budgets keeps all of them.

    rows: query_id, id (unique in a question), group (rows of one leave together; null: the row alone), source, document, score,
    tokens (in the audit prompt), final_tokens (in the final one), requirements (array), factual, listed (a list that was asked for),
    mandatory (of a file that was asked for), conflict (one side of a conflict), reduced_tokens (of a shorter text, null if there is none; one that saves nothing counts as none).
    carry: columns of ``rows`` that the result has too.
    Nulls count as 0, none and false. members: query_id, id, place, tokens of the members of lists, each a part of its row's tokens.

    Order: representatives that cover the requirements, picked by what they add, then by score. Of each source (each file, if it is
    mandatory) the best factual row is reserved. While a prompt is too long, the last unit of the first step that has one leaves:
    ``group`` units that hold nothing reserved, listed, mandatory or conflicting, and no requirement's last holder;
    ``cell``  last holders of requirements, if they are single rows;
    ``conflict`` whole groups of conflicts without mandatory or listed rows, by their first row;
    ``source`` reserved single rows, if no conflict stays.
    A factual row stays if there is one, else any row. If that isn't enough, longest first, rows that aren't in conflicts take their
    reduced text, then lists lose their last member, one at a time from the longest; a first member always stays.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    asked = F.coalesce("requirements", F.array().cast("array<string>"))
    held = [F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), number("tokens"), number("final_tokens"), F.array_distinct(F.array_compact(asked)).alias("requirements"), flag("factual"), flag("listed"), flag("mandatory"), flag("conflict"), F.col("reduced_tokens").cast("long").alias("reduced_tokens")]
    all_ = rows.select("query_id", "id", "group", "source", "document", *held, *(F.col(c).alias(f"_carry_{c}") for c in carry))
    large = workspace.written(rows.groupBy("query_id").count().where(F.col("count") > WHOLE).select(F.struct("query_id").alias("_q")), "large")
    if large.isEmpty():
        out = _in_blocks(all_, audit, final)
    else:
        of = lambda how: all_.join(sized_broadcast(large), F.struct("query_id") == F.col("_q"), how)
        out = _in_blocks(of("left_anti"), audit, final).unionByName(_by_joins(of("left_semi"), audit, final))
    if members is None:
        out = out.withColumn("members_left", F.lit(None).cast("long"))
    else:
        out = workspace.written(out, "evicted")
        partial = _listed(out.withColumn("q", F.struct("query_id")), audit, final, members)
        out = out.join(partial, (F.struct("query_id") == F.col("_mq")) & (F.col("id") == F.col("_mid")), "left")
    return out.select("query_id", "id", F.col("step").isNull().alias("kept"), "step", "reduced", "members_left", *(F.col(f"_carry_{c}").alias(c) for c in carry))


def _in_blocks(all_: DataFrame, audit: int, final: int) -> DataFrame:
    """``all_`` with step and reduced. Rows are dealt out by question and sorted by id; tasks take blocks of whole questions."""
    asked = all_.select(F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("n"), "*")
    names = [c for c in all_.columns if c in ("query_id", "id", "tokens", "final_tokens", "reduced_tokens", "conflict") or c.startswith("_carry_")]
    schema = D.StructType([*(all_.schema[c] for c in names), D.StructField("step", D.StringType()), D.StructField("reduced", D.BooleanType())])
    steps = pa.array([*STEPS, None], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in fitting.blocks(batches):
            step, reduced = fitting.evicted(table, audit, final)
            done = table.select(names).append_column("step", steps.take(pa.array(np.where(step < 0, len(STEPS), step))))
            yield from done.append_column("reduced", pa.array(reduced)).to_batches()

    return asked.mapInArrow(run, schema)


def _by_joins(all_: DataFrame, audit: int, final: int) -> DataFrame:
    """``all_`` with step and reduced, for questions of any size."""
    all_ = all_.withColumn("q", F.struct("query_id"))
    totals = all_.groupBy(F.col("q").alias("_q")).agg(F.sum("tokens").alias("total"), F.sum("final_tokens").alias("final_total"))
    over = workspace.written(totals.where((F.col("total") > audit) | (F.col("final_total") > final)), "over")
    held = all_.join(sized_broadcast(over), F.col("q") == F.col("_q"), "left_semi")
    ranked = workspace.written(ranked_within(held, ["q"], ["-score", "id"], "n"), "ranked")
    placed = workspace.written(_placed(ranked), "placed")
    units = workspace.written(_units(placed), "units")
    gone = workspace.written(_leaving(units, placed, over, audit, final), "leaving")
    out = placed.join(gone.withColumnRenamed("q", "_q").withColumnRenamed("unit", "_unit"), (F.col("q") == F.col("_q")) & (F.col("unit") == F.col("_unit")), "left")
    out = workspace.written(out.select("q", "id", "tokens", "final_tokens", "reduced_tokens", "conflict", "step"), "evicted")
    shorter = _shortened(out, audit, final)
    changes = out.select(F.col("q").alias("_q"), F.col("id").alias("_id"), "step").where("step is not null")
    keys = lambda a, b: (F.col("q") == F.col(a)) & (F.col("id") == F.col(b))
    done = all_.join(changes, keys("_q", "_id"), "left").join(shorter, keys("_sq", "_sid"), "left")
    carried = [c for c in all_.columns if c.startswith("_carry_")]
    return done.select("query_id", "id", "tokens", "final_tokens", "reduced_tokens", "conflict", *carried, "step", F.col("_sid").isNotNull().alias("reduced"))


def _placed(ranked: DataFrame) -> DataFrame:
    """Rows with ``place``, representatives first, ``reserved``, and ``unit``."""
    edges = ranked.where("factual").select(F.col("q").alias("query_id"), F.col("n").alias("evidence_id"), F.explode("requirements").alias("requirement_id"))
    picks = set_cover(edges, REST).select(F.col("query_id").alias("_q"), F.col("evidence_id").alias("_n"), "position")
    at = (F.col("q") == F.col("_q")) & (F.col("n") == F.col("_n"))
    out = ranked.join(picks, at, "left").withColumn("place", F.coalesce(F.col("position").cast("long"), F.col("n") + REST)).drop("_q", "_n", "position")
    file = F.when(F.col("mandatory"), F.struct("document"))
    best = out.where("factual and not listed").groupBy(F.col("q").alias("_q"), "source", file.alias("file"))
    best = best.agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "n"))["n"].alias("_n")).select("_q", "_n", F.lit(True).alias("reserved"))
    out = out.join(best, at, "left").withColumn("reserved", F.coalesce("reserved", F.lit(False))).drop("_q", "_n")
    return out.withColumn("unit", F.struct(F.col("group").alias("g"), F.when(F.col("group").isNull(), F.col("n")).alias("n")))


def _units(placed: DataFrame) -> DataFrame:
    any_ = lambda c: F.max(c).alias(c)
    return placed.groupBy("q", "unit").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.sum("final_tokens").alias("final_tokens"), F.min("place").alias("first"), F.max("place").alias("place"), *map(any_, ("reserved", "listed", "mandatory", "conflict", "factual")))


def last_holders(edges: DataFrame) -> DataFrame:
    """(q, place): of units that leave last to first unless they hold what none of the others then holds, those that stay.

    edges: q, requirement, place (the unit's), fixed (a unit that stays anyway). The earliest holders of open requirements are the only ones
    that can stay. One of them stays surely if no later one of them has that requirement too; what it holds is no longer open. The latest
    always does, so rounds end, and most are settled in the first.
    """
    free = edges.where("not fixed").select("q", "requirement", "place").distinct()
    covered = edges.where("fixed").select("q", "requirement").distinct()
    open_ = workspace.written(free.join(covered, ["q", "requirement"], "left_anti"), "open")
    out = workspace.written(open_.select("q", "place").limit(0), "holders")
    while not open_.isEmpty():
        first = workspace.written(open_.groupBy("q", "requirement").agg(F.min("place").alias("place")), "first")
        open_ = open_.join(first.select("q", "place").distinct(), ["q", "place"], "left_semi")
        last = open_.groupBy("q", "requirement").agg(F.max("place").alias("place"))
        stay = workspace.written(first.join(last, ["q", "requirement", "place"]).select("q", "place").distinct(), "holders")
        out = out.union(stay)
        met = open_.join(stay, ["q", "place"], "left_semi").select("q", "requirement").distinct()
        open_ = workspace.written(open_.join(met, ["q", "requirement"], "left_anti"), "open")
    return out


def _leaving(units: DataFrame, placed: DataFrame, over: DataFrame, audit: int, final: int) -> DataFrame:
    """(q, unit, step) of the units that leave."""
    fixed = F.col("reserved") | F.col("listed") | F.col("mandatory") | F.col("conflict")
    asked = placed.where(F.size("requirements") > 0).select("q", "unit", F.explode("requirements").alias("requirement"))
    stay = last_holders(asked.join(units.select("q", "unit", "place", fixed.alias("fixed")), ["q", "unit"])).withColumn("holder", F.lit(True))
    bound = F.col("listed") | F.col("mandatory")
    stuck = units.groupBy("q").agg(F.max(F.col("conflict") & bound).alias("stuck"))
    alone = F.col("rows") == 1
    step = F.when(bound, None).when(F.col("conflict"), 2).when(F.col("reserved"), F.when(alone & ~F.col("stuck"), 3)).when(F.col("holder"), F.when(alone, 1)).otherwise(0)
    stepped = workspace.written(units.join(stay, ["q", "place"], "left").join(sized_broadcast(stuck), "q").withColumn("step", step.cast("int")), "steps")
    kept = stepped.groupBy("q").agg(F.max(F.col("step").isNull()).alias("some"), F.max(F.col("step").isNull() & F.col("factual")).alias("fact"))
    at = F.when(F.col("conflict"), F.col("first")).otherwise(F.col("place"))
    order = ranked_within(stepped.where("step is not null").select("q", "unit", "step", "tokens", "final_tokens", "factual", at.alias("at")), ["q"], ["step", "-at"], "i")
    order = workspace.written(order, "order")
    anchor = order.groupBy("q").agg(F.max("i").alias("end"), F.max(F.when(F.col("factual"), F.col("i"))).alias("fact_end")).join(kept, "q")
    spared = F.when(~F.col("fact"), F.coalesce("fact_end", F.when(~F.col("some"), F.col("end")))).when(~F.col("some"), F.col("end"))
    order = order.join(sized_broadcast(anchor.select("q", spared.alias("anchor"))), "q").withColumn("stays", F.col("i").eqNullSafe(F.col("anchor")))
    freed = lambda c: F.when(F.col("stays"), 0).otherwise(F.col(c)).cast("long").alias(c)
    order = order.select("q", "unit", "step", "i", "stays", freed("tokens"), freed("final_tokens"))
    sums = _running(_running(order, "q", "i", "tokens").withColumnRenamed("before", "gone"), "q", "i", "final_tokens").withColumnRenamed("before", "final_gone")
    sums = sums.join(sized_broadcast(over), F.col("q") == F.col("_q"))
    long_ = (F.col("total") - F.col("gone") > audit) | (F.col("final_total") - F.col("final_gone") > final)
    return sums.where(long_ & ~F.col("stays")).select("q", "unit", F.element_at(F.array(*map(F.lit, STEPS)), F.col("step") + 1).alias("step"))


def _excess(sums: DataFrame, audit: int, final: int) -> DataFrame:
    """(_q, excess): by how much a prompt is too long."""
    return sums.select(F.col("q").alias("_q"), F.greatest(F.col("a") - audit, F.col("f") - final).alias("excess")).where("excess > 0")


def _until(events: DataFrame, order: list[str], excess: DataFrame) -> DataFrame:
    """Those of a question's events, in order, that come before their ``saved`` tokens add up to the excess."""
    ranked = ranked_within(events.join(sized_broadcast(excess), F.col("q") == F.col("_q")).drop("_q"), ["q"], order, "i")
    return _running(workspace.written(ranked, "events"), "q", "i", "saved").where("before < excess")


def _shortened(out: DataFrame, audit: int, final: int) -> DataFrame:
    """(_sq, _sid) of the rows that take their reduced text."""
    kept = out.where("step is null")
    sums = kept.groupBy("q").agg(F.sum("tokens").alias("a"), F.sum("final_tokens").alias("f"))
    saved = F.col("tokens") - F.col("reduced_tokens")
    shorter = _until(kept.where((saved > 0) & ~F.col("conflict")).select("q", "id", "tokens", saved.alias("saved")), ["-tokens", "id"], _excess(sums, audit, final))
    return workspace.written(shorter.select(F.col("q").alias("_sq"), F.col("id").alias("_sid")), "shorter")


def _listed(out: DataFrame, audit: int, final: int, members: DataFrame) -> DataFrame:
    """(_mq, _mid, members_left) of lists that lose members. out: q, id, step, reduced and the tokens of rows."""
    kept = out.where("step is null")
    less = F.coalesce(F.sum(F.when(F.col("reduced"), F.col("tokens") - F.col("reduced_tokens"))), F.lit(0))
    sums = kept.groupBy("q").agg((F.sum("tokens") - less).alias("a"), (F.sum("final_tokens") - less).alias("f"))
    whole = kept.where("not reduced").select("q", "id")
    own = members.select(F.struct("query_id").alias("q"), "id", "place", F.coalesce("tokens", F.lit(0)).cast("long").alias("saved")).join(whole, ["q", "id"])
    own = ranked_within(own.select(F.struct("q", "id").alias("list"), "place", "saved"), ["list"], ["place"], "k", "all")
    long_ = _running(workspace.written(own, "members"), "list", "k", "saved").withColumn("length", F.col("before") + F.col("saved")).drop("before")
    events = long_.where("k > 1").select("list.q", F.col("list.id").alias("id"), "k", "all", "length", "saved")
    cut = _until(events, ["-length", "id", "-k"], _excess(sums, audit, final))
    partial = cut.groupBy(F.col("q").alias("_mq"), F.col("id").alias("_mid")).agg((F.max("all") - F.count("*")).alias("members_left"))
    return workspace.written(partial, "partial")


def requirement_coverage(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """R14. (query_id, requirement, offered, kept, covered): how many rows hold each requirement, and how many of them stay.

    fitted: the result of ``fit``; if it carries the requirements, ``rows`` aren't read again."""
    stays: Column = F.col("kept").cast("int")
    held = lambda df, *also: df.select("query_id", "id", *also, F.explode(F.array_distinct(F.array_compact("requirements"))).alias("requirement"))
    both = held(fitted, "kept") if "requirements" in fitted.columns else held(rows).join(fitted.select("query_id", "id", "kept"), ["query_id", "id"])
    out = both.groupBy("query_id", "requirement")
    return out.agg(F.count("*").alias("offered"), F.sum(stays).alias("kept")).withColumn("covered", F.col("kept") > 0)
