"""A table laid out in files by day, and its days overwritten when rows arrive late.

Stored rows, the ids that leave and the rows that come in meet by (day, fixed time slice): each carries the sort key that
it has in the layout, so they are dealt out together in ranges of (day, slice, time, id), and in each range one sorted
pass drops the stored rows whose id leaves. Rows of a range and slice are counted, and the prefix sums of these counts
say in which file of its day a row stands: no task holds a day, and a slice with very many rows is cut like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import ranks, scratch

#: Files that all rows would fill, about (of the contract), and microseconds of a time slice.
FILES, SLICE = 700, 3_600_000_000
DAY = 86_400_000_000
_STORED, _LEAVES, _COMES = 0, 1, 2


def micros(c: Column, kind: str) -> Column:
    """Microseconds since 1970 of a time of this type; one without a zone is read as UTC, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(c)
    minutes = F.hour(c) * 60 + F.minute(c)
    return F.unix_date(c.cast("date")).cast("long") * DAY + minutes.cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def day_of(t: Column) -> Column:
    """Whole days since 1970 of a time in microseconds; null: -1."""
    return F.coalesce(F.floor(t / F.lit(DAY)), F.lit(-1)).cast("long")



def _came(c: str) -> Column:
    """A time to compare by; null is before all."""
    return F.coalesce(c, F.lit(-(1 << 62)))


class Layout:
    """A table in Parquet files of ``per_file`` rows, below ``root`` by day and number; a row stands where its id's latest arrival puts it.

    ``like``: a frame with the table's columns, whatever their names; ``id``, ``time`` and ``arrived`` are three of them. Of the rows of one
    id, the one that arrived last stays (a null arrival is earlier than any other; of equal arrivals the later time, then the larger digest
    of the row); rows with a null id are one id's. A null time is day -1; within a day rows stand by time, then id. Files hold the
    table's columns only, in order. No rows leave the root without files.
    """

    def __init__(self, like: DataFrame, root: str, per_file: int, id: str = "sale_id", time: str = "sold_at", arrived: str = "arrived_at"):
        self.spark, self.root, self.per_file = like.sparkSession, root, per_file
        self.columns, self.kinds = like.columns, {f.name: f.dataType.simpleString() for f in like.schema}
        self.id, self.time, self.arrived = id, time, arrived
        self.day, self.no, self.at = (scratch.fresh(like.columns, n) for n in ("day", "file_no", "place"))
        self.schema = StructType([*like.schema.fields, StructField(self.day, LongType()), StructField(self.no, LongType())])

    def _micros(self, column: str) -> Column:
        return micros(F.col(f"x.{column}"), self.kinds[column])

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """Rows (x) with the day, slice, time and id that they are sorted by, and their arrival."""
        t = self._micros(self.time)
        return rows.select("x", day_of(t).alias("day"), F.coalesce(F.floor(t / F.lit(SLICE)), F.lit(-1)).cast("long").alias("slice"), t.alias("t"), F.col(f"x.{self.id}").alias("id"), self._micros(self.arrived).alias("came"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The row of each id that arrived last, keyed."""
        keyed = self._keyed(rows.select(F.struct(*map(F.col, self.columns)).alias("x")))
        order = F.struct(_came("came"), _came("t"), F.xxhash64("x"))
        return keyed.groupBy("id").agg(F.max_by(F.struct("x", "day", "slice", "t", "came"), order).alias("r")).select("id", "r.*")

    def _number(self) -> Column:
        return F.floor(F.col("at") / self.per_file)

    def _write(self, placed: DataFrame, mode: str) -> None:
        """Writes rows (x, day, at) into the files that their places name, each by one task, streaming."""
        rows = placed.select("x.*", F.col("day").alias(self.day), self._number().alias(self.no), F.col("at").alias(self.at))
        rows = rows.repartition(self.day, self.no).sortWithinPartitions(self.day, self.no, self.at).drop(self.at)
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(self.day, self.no).parquet(self.root)

    def start(self, rows: DataFrame) -> None:
        """Writes the layout of ``rows`` into the root, which must be new."""
        self._write(ranks.placed(self._latest(rows).drop("came"), "day", ["slice", "t", "id"]), "append")

    def stored(self) -> DataFrame:
        """The rows in the files (x), with their file's day, number (file_no) and path, and their number in it (row_index)."""
        files = self.spark.read.schema(self.schema).parquet(self.root)
        return files.select(F.struct(*map(F.col, self.columns)).alias("x"), F.col(self.day).alias("day"), F.col(self.no).alias("file_no"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))

    def update(self, late: DataFrame) -> list[int]:
        """Makes the layout that of the stored rows and ``late`` ones; returns the days whose files were written again.

        A day is written again where a late row that stays stands now, or its id stood before; files of other days aren't touched, and
        files that are left over are removed. The new rows are a table of their own before a file changes, so lost executors cost
        nothing but time. The driver learns days and numbers of files, of which there are as many as the calendar and ``per_file`` allow.
        """
        stood = self._keyed(self.stored()).select(F.col("id").alias("i"), F.col("day").alias("d"), F.col("slice").alias("s"), F.col("t").alias("u"), F.col("came").alias("c"))
        met = self._latest(late).join(stood, F.col("id").eqNullSafe(F.col("i")), "left")
        newer = _came("came") >= _came("c")
        comes = scratch.written(met.where(F.col("d").isNull() | newer), "incoming")
        days = sorted(r[0] for r in comes.select(F.explode(F.array_compact(F.array("day", "d")))).distinct().collect())
        if not days:
            return days
        keys = ["day", "slice", "t", "id"]
        kept = self._keyed(self.stored().where(F.col("day").isin(days))).select("x", *keys, F.lit(_STORED).alias("side"))
        leaves = comes.where("d is not null").select(F.lit(None).cast(kept.schema["x"].dataType).alias("x"), F.col("d").alias("day"), F.col("s").alias("slice"), F.col("u").alias("t"), F.col("i").alias("id"), F.lit(_LEAVES).alias("side"))
        both = kept.union(leaves).union(comes.select("x", *keys, F.lit(_COMES).alias("side")))
        # the window asks for rows of a key together, which ranges of the same key give: no second shuffle
        gone = F.bool_or(F.col("side") == _LEAVES).over(Window.partitionBy(*keys))
        merged = both.repartitionByRange(*keys).withColumn("gone", gone).where((F.col("side") == _COMES) | (F.col("side") == _STORED) & ~F.col("gone"))
        ordered = merged.select("x", *keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id())
        placed = scratch.written(ranks.after(scratch.written(ordered, "merged"), "day"), "placed")
        before = self._files(days)
        self._write(placed, "overwrite")
        now = {tuple(r) for r in placed.select("day", self._number()).distinct().collect()}
        with_files = {d for d, _ in now}
        scratch.drop(self.spark, *(self._folder(*f) for f in before - now if f[0] in with_files), *(self._folder(d) for d in days if d not in with_files))
        return days

    def _folder(self, day: int, no: int | None = None) -> str:
        return f"{self.root}/{self.day}={day}" + (f"/{self.no}={no}" if no is not None else "")

    def _files(self, days: list[int]) -> set[tuple[int, int]]:
        """(day, number) of the files of these days, by listing their folders."""
        sc = self.spark.sparkContext
        out = set()
        for day in days:
            at = sc._jvm.org.apache.hadoop.fs.Path(self._folder(day))
            fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
            if fs.exists(at):
                out |= {(day, int(s.getPath().getName().partition("=")[2])) for s in fs.listStatus(at)}
        return out

    def report(self, rewritten: list[int], amount: str = "total") -> DataFrame:
        """One row per file: day, file_no, n_rows, cents, rows_crc, path, columns, ids_sha256, rewritten, all read from the files.

        Rows are read in whatever parts Spark cuts a file into; a file's ids come together in the order of their numbers in one task,
        which digests them as they stream by. ``columns`` are those that the files' own schemas have, merged.
        """
        rows = self.stored()
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        own = text(F.col(f"x.{self.id}"))
        line = F.concat_ws(":", own, text(self._micros(self.time)), text(self._micros(self.arrived)))
        cents = F.coalesce(F.floor(F.col(f"x.{amount}") * 100 + 0.5), F.lit(0)).cast("long")
        sums = rows.groupBy("day", "file_no", "path").agg(F.count("*").alias("n_rows"), F.sum(cents).alias("cents"), F.sum(F.crc32(line)).alias("rows_crc"))
        ids = rows.select("path", "row_index", own.alias("id")).repartition("path").sortWithinPartitions("path", "row_index")
        digests = ids.select("path", "id").mapInArrow(_digests, "at string, ids_sha256 string")
        names = [c for c in self.spark.read.option("mergeSchema", True).parquet(self.root).columns if c not in (self.day, self.no)] if rows.inputFiles() else self.columns
        again = F.col("day").isin(rewritten) if rewritten else F.lit(False)
        return sums.join(digests, F.col("path") == F.col("at")).select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(",".join(names)).alias("columns"), "ids_sha256", again.alias("rewritten"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each path's ids, joined by commas, as they stream by."""
    last, state = None, hashlib.sha256()
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([state.hexdigest()])], names=["at", "ids_sha256"])
    for batch in batches:
        paths, ids = batch.column(0), batch.column(1)
        cuts = [0, *(np.flatnonzero(paths.slice(1).to_numpy(zero_copy_only=False) != paths.slice(0, len(paths) - 1).to_numpy(zero_copy_only=False)) + 1).tolist(), len(paths)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z == a:
                continue
            path = paths[a].as_py()
            if path != last:
                if last is not None:
                    yield out()
                last, state = path, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(ids.slice(a, z - a).to_pylist()).encode())
    if last is not None:
        yield out()
