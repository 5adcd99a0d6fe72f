"""Lowered streams and their order: positions, running aggregates and neighbours, on one task or many."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQ, TIE, TS, ERR, KEY = "__df_seq", "__df_tie", "__df_ts", "__df_err", "__df_key"
RESERVED = "__df_"
#: Rows of a block in a two-phase running aggregate.
BLOCK = 1 << 20
#: Estimated bytes of a plan's result, or rows of the files below it, from which positions are found by ranges over many
#: tasks. The estimate is of compressed columns, so that a few MB may be millions of rows.
LARGE_BYTES, LARGE_ROWS = 64 << 20, 1 << 20
LAST = (1 << 62) - 1


@dataclass(frozen=True)
class Stream:
    """A DataFrame with a total order. Internal columns begin with RESERVED.

    order: the columns that order it; dense: SEQ counts its rows from 0; part: a private stream for each value of
    these columns; timed: TS holds microseconds; err: a row may carry a failure, and nothing follows it; endless: the rows are
    one round of a stream that repeats them for ever."""

    df: DataFrame
    order: tuple[str, ...]
    dense: bool = False
    part: tuple[str, ...] = ()
    timed: bool = False
    err: bool = False
    endless: bool = False

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(RESERVED)]

    @property
    def internal(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(RESERVED)]

    def with_df(self, df: DataFrame, **changes) -> Stream:
        return replace(self, df=df, **changes)

    def key(self) -> Column:
        return F.struct(*self.order)

    def window(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def ok(self) -> Column:
        return F.col(ERR).isNull() if self.err else F.lit(True)


def checkpoint_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in spark.checkpoint.dir, which executors share; a temporary one serves single-JVM local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Written once as a table and read back: the plan is computed once and its lineage is cut."""
    path = checkpoint_folder(df.sparkSession, "stream")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Context:
    """How a run is lowered. large: None decides by the plan's estimated size."""

    def __init__(self, spark: SparkSession, large: bool | None = None, block: int = BLOCK):
        self.spark, self.forced, self.block = spark, large, block
        #: What stages did to elements beside passing them on, by name; None: nobody asks.
        self.counted: Counter | None = None
        self.file_rows: dict[tuple[str, ...], int] = {}

    def count(self, name: str, df: DataFrame) -> None:
        """Count rows under a name, if anybody asks."""
        if self.counted is not None:
            self.counted[name] += df.count()

    def large(self, s: Stream) -> bool:
        if self.forced is not None:
            return self.forced
        if int(str(s.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > LARGE_BYTES:
            return True
        return self.rows_below(s.df) > LARGE_ROWS

    def rows_below(self, df: DataFrame) -> int:
        """Rows of the Parquet files that a plan reads, by their footers."""
        files = tuple(sorted(f for f in df.inputFiles() if f.endswith(".parquet")))
        if files and files not in self.file_rows:
            self.file_rows[files] = self.spark.read.parquet(*files).count()
        return self.file_rows.get(files, 0)

    def settled(self, s: Stream) -> Stream:
        """A large stream, stored: a guard reads it twice, and guards in a chain would else read what is above them as
        often as two to their number."""
        return s.with_df(checkpointed(s.df)) if self.large(s) else s

    def dense(self, s: Stream) -> Stream:
        """SEQ counts the rows from 0 (of each part). A large stream is dealt by ranges of its order; each task counts its rows and a
        small table of the tasks' counts shifts them."""
        if s.dense:
            return s
        if s.part or not self.large(s):
            return self._named(s, F.row_number().over(s.window()).cast("long") - 1, s.df)
        ranged = checkpointed(s.df.repartitionByRange(*s.order).sortWithinPartitions(*s.order).withColumn("__df_m", F.monotonically_increasing_id()))
        ranged = ranged.withColumn("__df_p", F.shiftrightunsigned("__df_m", 33))
        counts = ranged.groupBy("__df_p").agg(F.count(F.lit(1)).alias("__df_n"))
        before = counts.select("__df_p", F.coalesce(F.sum("__df_n").over(Window.orderBy("__df_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__df_b"))
        joined = ranged.join(F.broadcast(before), "__df_p")
        return self._named(s, F.col("__df_b") + F.col("__df_m").bitwiseAND(F.lit((1 << 33) - 1)), joined)

    def _named(self, s: Stream, position: Column, df: DataFrame) -> Stream:
        keep = [*s.columns, *(c for c in s.internal if c == TS or (c != SEQ and c not in s.order))]
        return s.with_df(df.select(*keep, position.alias(SEQ)), order=(SEQ,), dense=True)

    def running(self, s: Stream, outs: dict[str, tuple[str, Column, bool]]) -> Stream:
        """Adds running aggregates: name -> (sum, count, min or max; of what; whether the row itself counts).

        On a large stream in two phases: within blocks of positions, then over one row for each block."""
        calls = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        if not self.large(s) or s.part and s.order != (SEQ,):
            w = s.window()
            add = {n: calls[how](x).over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)) for n, (how, x, own) in outs.items()}
            return s.with_df(s.df.withColumns(add))
        if not s.part:
            s = self.dense(s)
        # a private stream keeps the positions of the whole one, so that a key with very many rows has many blocks too
        df = s.df.withColumn("__df_block", F.expr(f"{SEQ} div {self.block}")).withColumns({f"__df_x_{n}": x for n, (_, x, _) in outs.items()})
        w = Window.partitionBy(*s.part, "__df_block").orderBy(SEQ)
        df2 = df.withColumns({n: calls[how](f"__df_x_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)) for n, (how, _, own) in outs.items()})
        over = Window.partitionBy(*s.part).orderBy("__df_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy(*s.part, "__df_block").agg(*[calls[how](f"__df_x_{n}").alias(f"__df_y_{n}") for n, (how, _, _) in outs.items()])
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        carry = sums.select(*[F.col(c).alias(f"__df_c{i}") for i, c in enumerate((*s.part, "__df_block"))], *[merge[how](f"__df_y_{n}").over(over).alias(f"__df_z_{n}") for n, (how, _, _) in outs.items()])
        same = [F.col(c).eqNullSafe(F.col(f"__df_c{i}")) for i, c in enumerate((*s.part, "__df_block"))]
        df2 = df2.join(carry if s.part else F.broadcast(carry), same)
        for n, (how, _, _) in outs.items():
            a, b = F.col(n), F.col(f"__df_z_{n}")
            df2 = df2.withColumn(n, {"min": F.least, "max": F.greatest}[how](a, b) if how in ("min", "max") else F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
        return s.with_df(df2.select(*s.df.columns, *outs))

    def previous(self, s: Stream, outs: dict[str, Column]) -> Stream:
        """Adds values of the row before; null for the first."""
        if s.part or not self.large(s):
            return s.with_df(s.df.withColumns({n: F.lag(x).over(s.window()) for n, x in outs.items()}))
        s = self.dense(s)
        df = s.df.withColumn("__df_block", F.expr(f"{SEQ} div {self.block}")).withColumns({f"__df_x_{n}": x for n, x in outs.items()})
        last = df.groupBy("__df_block").agg(*[F.max_by(F.struct(f"__df_x_{n}"), SEQ).alias(f"__df_y_{n}") for n in outs])
        last = last.select((F.col("__df_block") + 1).alias("__df_block"), *[F.col(f"__df_y_{n}") for n in outs])
        w = Window.partitionBy("__df_block").orderBy(SEQ)
        df = df.withColumns({n: F.lag(F.struct(f"__df_x_{n}")).over(w) for n in outs}).join(F.broadcast(last), "__df_block", "left")
        return s.with_df(df.select(*s.df.columns, *[F.coalesce(n, f"__df_y_{n}")[f"__df_x_{n}"].alias(n) for n in outs]))

    def fail_at(self, s: Stream, cond: Column, code: str, message: Column) -> Stream:
        """The first row where cond holds becomes a failure and the rows behind it go. Whether it fails the run is
        settled at the terminal: a take before it ends the stream first."""
        s = self.settled(s)
        df = s.df.withColumn("__df_bad", F.coalesce(cond, F.lit(False)) & s.ok())
        first = df.where("__df_bad").agg(F.min(s.key()).alias("k")).scalar()
        text = F.concat(F.lit(f"{code}: "), message.cast("string"))
        err = F.when(F.col("__df_bad"), text).otherwise(F.col(ERR) if s.err else F.lit(None).cast("string"))
        df = df.where(F.coalesce(s.key() <= first, F.lit(True))).withColumn(ERR, err).drop("__df_bad")
        return s.with_df(df, err=True)
