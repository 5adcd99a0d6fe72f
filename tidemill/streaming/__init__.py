"""Long-running pipelines: Structured Streaming forms of the stages, durable runs and their checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.engine import Engine
from tidemill.errors import CheckpointConflictError, PipelineResumeRefusedError
from tidemill.functions import Fold
from tidemill.operators import lower
from tidemill.operators.order import Context, Stream, checkpointed
from tidemill.options import DurableRunOptions, at_least, positive
from tidemill.plans import canonical, identity
from tidemill.stream import Graph


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files that are dropped into a folder. files_per_trigger is the backpressure: what one batch admits."""
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", at_least("files_per_trigger", files_per_trigger, 1)) if files_per_trigger else r).load(path)


def never(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of an empty folder: it neither emits nor ends."""
    return file_stream(spark, folder, schema)


def ticks(spark: SparkSession, interval_micros: int) -> DataFrame:
    """Tick numbers for as long as the query runs; ticks that fall in one trigger are one element with the latest
    number, so missed ticks are skipped and the number jumps."""
    positive("interval_micros", interval_micros)
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return rate.select(F.expr(f"(unix_micros(timestamp) div {interval_micros})").alias("value"), "timestamp")


class DropFolder:
    """A push ingress for streaming queries: offers collect until flush() writes them as one file the query picks up."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, capacity: int):
        self.spark, self.folder, self.schema, self.capacity = spark, folder, schema, at_least("capacity", capacity, 1)
        self.held: list[tuple] = []
        self.closed = False

    def offer(self, row: tuple) -> str:
        if self.closed:
            return "closed"
        if len(self.held) >= self.capacity:
            return "full"
        self.held.append(row)
        return "accepted"

    def flush(self) -> int:
        rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        return len(rows)

    def complete(self) -> None:
        self.flush()
        self.closed = True


def keyed_fold(stream: DataFrame, key: str, order: str, step: Callable[[Any, dict], Any], seed: Any, state: str, out: str) -> DataFrame:
    """A running fold for each key over a stream: every state comes out, and the state lives in the state store.

    Rows of one batch are taken in `order` within their key; state and out are DDL, step(state, row) gives the next
    state as a tuple of the state's columns."""
    out_type, state_type = T._parse_datatype_string(out), T._parse_datatype_string(state)
    names = [f.name for f in out_type]

    def run(k: tuple, frames: Iterator, store) -> Iterator:
        import pandas as pd

        value = tuple(store.get) if store.exists else seed
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows = []
        for r in pdf.to_dict("records"):
            value = step(value, r)
            rows.append((*k, r[order], *value))
        store.update(value)
        yield pd.DataFrame(rows, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, out_type, state_type, "append", "NoTimeout")


def distinct_within(stream: DataFrame, columns: list[str], time: str, delay: str) -> DataFrame:
    """First occurrences, with keys remembered for as long as the watermark allows."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(columns)


def counts_within(stream: DataFrame, time: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts in fixed windows of event time; a window comes out when the watermark has passed it."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


class Folder:
    """Small texts in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, where: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(where)
        self.fs = self.root.getFileSystem(self.conf)
        self.where = where

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.root)) if self.fs.exists(self.root) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A reader sees the whole text or none: it is written beside and moved into place."""
        beside = self._path(f".{name}.new")
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(beside, self._path(name)):
            raise OSError(f"could not move {name} into place")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), False)


class Checkpoints:
    """The documents of a durable run, one after each batch: fingerprint, revision, states of durable scopes, marks.

    The document of a batch is made from that of the batch before, so a batch that runs again gives the same one. The last
    two are kept."""

    def __init__(self, folder: Folder, fingerprint: str, revision: int):
        self.folder, self.fingerprint, self.revision = folder, fingerprint, revision

    @staticmethod
    def _name(batch: int) -> str:
        return f"run-{batch + 1:012d}.json"

    def known(self) -> list[int]:
        return [int(n[4:-5]) - 1 for n in self.folder.names() if n.startswith("run-") and n.endswith(".json")]

    def open(self, run_id: str, resume: bool) -> None:
        """Refuse a place that is taken, or a checkpoint of another graph or revision."""
        known = self.known()
        if not resume:
            if known:
                raise CheckpointConflictError(f"{run_id} has a checkpoint already")
            self.save(-1, {}, {})
            return
        if not known:
            raise PipelineResumeRefusedError(f"there is no checkpoint of {run_id}")
        document = canonical.read(self.folder.read(self._name(max(known))))
        if document["fingerprint"] != self.fingerprint or document["revision"] != self.revision:
            raise PipelineResumeRefusedError("the checkpoint belongs to another graph or revision")

    def states_before(self, batch: int) -> dict:
        before = [i for i in self.known() if i < batch]
        return canonical.read(self.folder.read(self._name(max(before))))["states"]

    def save(self, batch: int, states: dict, marks: dict) -> None:
        document = {"cursors": {}, "fingerprint": self.fingerprint, "marks": marks, "revision": self.revision, "states": states}
        self.folder.write(self._name(batch), canonical.write(document))
        for old in self.known():
            if old < batch - 1:
                self.folder.delete(self._name(old))


@dataclass
class DurableRun:
    """A streaming query with a name and a checkpoint that knows which graph it belongs to."""

    query: Any
    checkpoints: Checkpoints

    def process_all(self) -> None:
        self.query.processAllAvailable()

    def shutdown(self) -> None:
        """Drains what is available, then stops."""
        self.query.processAllAvailable()
        self.query.stop()

    def cancel(self) -> None:
        """Stops where it stands; what was not committed is read again by a resume."""
        self.query.stop()

    pause = cancel

    @property
    def snapshot(self) -> dict:
        done = self.query.recentProgress
        failed = self.query.exception()
        status = "failed" if failed else "running" if self.query.isActive else "stopped"
        return {"status": status, "batch": done[-1]["batchId"] if done else None, "rows": sum(p["numInputRows"] for p in done), "checkpoints": len(self.checkpoints.known())}


def _start(spark: SparkSession, frame: DataFrame, options: DurableRunOptions, fingerprint: str, revision: int, resume: bool, output_mode: str, batch: Callable[[DataFrame, int, dict], dict]) -> DurableRun:
    options.check()
    if options.every_elements is not None:
        raise ValueError("a stream of files is checkpointed after each batch; bound batches by files_per_trigger instead of every_elements")
    name = identity.segment("run id", options.run_id)
    where = f"{options.location.rstrip('/')}/{name}"
    checkpoints = Checkpoints(Folder(spark, where), fingerprint, revision)
    checkpoints.open(name, resume)

    def one(df: DataFrame, i: int) -> None:
        states = batch(df, i, checkpoints.states_before(i))
        checkpoints.save(i, states, {"sink": {"acknowledged": i + 1}})

    w = frame.writeStream.foreachBatch(one).outputMode(output_mode).option("checkpointLocation", f"{where}/spark").queryName(name)
    if options.interval_micros:
        w = w.trigger(processingTime=f"{options.interval_micros / 1e6} seconds")
    return DurableRun(w.start(), checkpoints)


def start_durable(frame: DataFrame, write: Callable[[DataFrame, int], None], options: DurableRunOptions, fingerprint: str, revision: int, resume: bool = False, output_mode: str = "append") -> DurableRun:
    """Start or resume a durable run of a streaming DataFrame, whose state Spark's own checkpoint holds.

    Its checkpoint holds a document with the graph's fingerprint and revision. A new run refuses a place that is taken;
    a resume refuses another graph or revision. write(batch, batch id) may see a batch again after a failure: state
    is exact, effects are at least once between marks, so a sink should be keyed by the batch id."""

    def batch(df: DataFrame, i: int, states: dict) -> dict:
        write(df, i)
        return states

    return _start(frame.sparkSession, frame, options, fingerprint, revision, resume, output_mode, batch)


#: Stages that carry nothing from one batch to the next, so a durable run may have them outside its durable scopes.
STATELESS = (*lower.STATELESS, "fault-point")


def durable_steps(ctx: Context, s: Stream, steps: list[tuple[str, dict]], name: str, states: dict) -> tuple[Stream, dict]:
    """A durable scope over one batch: every stage goes on from its state, and gives its next one."""
    after: dict[str, Any] = {}
    for i, (kind, b) in enumerate(steps):
        key, known = f"{name}/{i}", states.get(f"{name}/{i}")
        if kind in ("take", "skip"):
            seen = known or 0
            left = max(0, b["n"] - seen)
            n = s.df.limit(left).count() if left else 0
            after[key] = seen + n
            if kind == "take":
                s = lower.LOWER["take"](ctx, s, {"n": n})
            elif n:
                s = lower.LOWER["skip"](ctx, s, {"n": n})
        elif kind == "scan":
            f: Fold = b["fold"]
            export, restore = b.get("export", lambda x: x), b.get("restore", lambda x: x)
            now = None if known is None else restore(known["value"])
            s = lower.LOWER["scan"](ctx, s, b | {"fold": replace(f, seed=now) if known is not None and f.kind in ("sum", "count", "python") else f})
            if known is not None and f.kind in ("min", "max") and now is not None:
                s = s.with_df(s.df.withColumn("value", {"min": F.least, "max": F.greatest}[f.kind](F.col("value"), F.lit(now))))
            s = s.with_df(checkpointed(s.df))
            last = s.df.where(s.ok()).agg(F.max_by(F.struct("value"), s.key())).first()[0]
            if last is not None:
                after[key] = {"value": export(last["value"])}
            elif known is not None:
                after[key] = known
        else:
            s = lower.LOWER[kind](ctx, s, b)
    return s, after


def run_durable(engine: Engine, graph: Graph, options: DurableRunOptions, write: Callable[[DataFrame, int], None], resume: bool = False, files_per_trigger: int | None = None) -> DurableRun:
    """Start or resume a durable run of a graph: one source of files with a schema, stages, a terminal that write stands for.

    Every batch runs the stages over the files it admits, in the source's order. Durable scopes go on from the states in the
    checkpoint document, in which each is a canonical value (`scan_durable` gives a fold's codec); a batch that runs again
    after a failure starts from the same states. Stages outside durable scopes must carry nothing between batches."""
    engine.check(graph)
    chain = graph.nodes()
    if len(graph.terminals) != 1 or any(len(n.inputs) > 1 for n in chain) or "stream" not in chain[0].bind:
        raise ValueError("a durable run needs one chain from a source of files that has a schema")
    names = [n.node_id for n in graph.document.nodes]
    for n in chain[1:-1]:
        if n.kind not in (*STATELESS, "durable"):
            raise ValueError(f"{n.kind} carries state between batches: put it in a durable scope")

    def batch(df: DataFrame, i: int, states: dict) -> dict:
        s = engine.placed(chain[0], df)
        after: dict[str, Any] = {}
        for node, name in zip(chain[1:-1], names[1:-1], strict=True):
            if node.kind == "durable":
                s, kept = durable_steps(engine.ctx, s, node.bind["steps"], name, states)
                after |= kept
            else:
                s = lower.LOWER[node.kind](engine.ctx, s, node.bind)
        engine._fail(s)
        write(s.df.where(s.ok()).orderBy(*s.order).select(*s.columns), i)
        return after

    stream = chain[0].bind["stream"](engine.spark, files_per_trigger)
    return _start(engine.spark, stream, options, graph.fingerprint, graph.revision, resume, "append", batch)
