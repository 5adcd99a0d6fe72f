"""Sources: in-memory rows, tables and files, generators, queues, and named providers."""

from __future__ import annotations

import asyncio
import collections
import threading
from collections.abc import AsyncIterable, Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import BufferOverflowError, SourceFailedError, UnboundedSourceError
from tidemill.operators.order import ERR, SEQ
from tidemill.options import BufferOptions, OverflowPolicy, at_least, positive
from tidemill.stream import Node, Source, frame_source

_AT = "__df_at"


def _rows(spark: SparkSession, rows: Iterable[Any], schema: str) -> DataFrame:
    fields = T._parse_datatype_string(schema)
    if not isinstance(fields, T.StructType):
        fields = T.StructType([T.StructField("value", fields)])
    full = T.StructType([*fields, T.StructField(_AT, T.LongType())])
    data = [((*r, i) if isinstance(r, (tuple, list)) and len(fields) > 1 else (r, i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, full)


def _memory(kind: str, make: Callable[[], Iterable[Any]], schema: str, params: dict | None = None) -> Source:
    return frame_source(lambda spark: _rows(spark, make(), schema), [_AT], kind, params, maker=make, dense=_AT)


def from_rows(rows: Iterable[Any], schema: str, time: str | None = None) -> Source:
    """The elements in the order given; each run reads them again."""
    rows = list(rows)
    s = _memory("from-enumerable", lambda: rows, schema)
    return Source(Node(s.node.kind, s.node.params, s.node.bind | {"time": time}))


def from_frame(make: DataFrame | Callable[[SparkSession], DataFrame], order: list[str], time: str | None = None) -> Source:
    """The rows of a DataFrame in the order of some of its columns, which should order it wholly."""
    return frame_source(make if callable(make) else lambda spark: make, order, "from-enumerable", {"order": list(order)}, time)


def files(fmt: str, path: str, order: list[str], time: str | None = None, schema: str | None = None, **options) -> Source:
    """Files that Spark reads: parquet, orc, json, csv, text, jdbc and others."""

    def make(spark: SparkSession) -> DataFrame:
        r = spark.read.format(fmt).options(**options)
        return (r.schema(schema) if schema else r).load(path)

    def stream(spark: SparkSession, files_per_trigger: int | None) -> DataFrame:
        r = spark.readStream.format(fmt).options(**options).schema(schema)
        return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)

    live = {"stream": stream} if schema else {}
    return frame_source(make, order, "from-enumerable", {"format": fmt, "path": path, "order": list(order)}, time, **live)


def parquet(path: str, order: list[str], time: str | None = None) -> Source:
    return files("parquet", path, order, time)


def from_async_iterable(make: Callable[[], AsyncIterable[Any]], schema: str) -> Source:
    def read() -> list:
        async def drain() -> list:
            return [x async for x in make()]

        return asyncio.run(drain())

    return _memory("from-async-enumerable", read, schema)


def single(value: Any, schema: str) -> Source:
    return _memory("single", lambda: [value], schema)


def empty(schema: str) -> Source:
    return _memory("empty", lambda: [], schema)


def never(schema: str) -> Source:
    """Neither emits nor ends; only a streaming run has it (see tidemill.streaming)."""

    def refuse(spark: SparkSession) -> DataFrame:
        raise UnboundedSourceError("a batch run of a source that never ends would not end")

    return frame_source(refuse, [_AT], "never", {"schema": schema}, schema=schema)


def failed(message: str, schema: str) -> Source:
    def make(spark: SparkSession) -> DataFrame:
        df = _rows(spark, [None], schema) if not schema.count(",") else _rows(spark, [tuple(None for _ in schema.split(","))], schema)
        return df.withColumn(ERR, F.lit(f"{SourceFailedError.__name__}: {message}"))

    return frame_source(make, [_AT], "failed", {"message": message}, err=True)


def range_(start: int, count: int) -> Source:
    """Consecutive 32-bit integers, up to the largest."""
    at_least("count", count, 0)
    if count and start + count - 1 > 2**31 - 1:
        raise ValueError("count reaches past the largest 32-bit integer")
    make = lambda spark: spark.range(count).select((F.col("id") + start).cast("int").alias("value"), F.col("id").alias(SEQ))
    return frame_source(make, [SEQ], "range", {"start": start, "count": count}, dense=SEQ)


def repeat(value: Any, count: int, schema: str = "int") -> Source:
    at_least("count", count, 0)
    make = lambda spark: spark.range(count).select(F.lit(value).cast(schema).alias("value"), F.col("id").alias(SEQ))
    return frame_source(make, [SEQ], "repeat", {"count": count}, dense=SEQ, fn=None if isinstance(value, (int, str)) else value)


def cycle(elements: Iterable[Any], schema: str) -> Source:
    """Repeats forever; a run needs a take, before which only stages that carry no state may stand."""
    rows = list(elements)
    return _memory("cycle", lambda: rows, schema)


def from_task(task: Any, schema: str) -> Source:
    """One value of a future, waited for when the run starts; its failure is the run's."""
    return _memory("from-task", lambda: [task.result()], schema)


def from_factory(factory: Callable[[], Any], schema: str) -> Source:
    """One value, made once in each run."""
    return _memory("from-factory", lambda: [factory()], schema)


def from_async_factory(factory: Callable[[], Any], schema: str) -> Source:
    async def call() -> Any:
        return await factory()

    return _memory("from-async-factory", lambda: [asyncio.run(call())], schema)


def unfold(seed: Any, generator: Callable[[Any], tuple[Any, Any] | None], schema: str) -> Source:
    """generator(state) gives (value, next state), or None at the end. It runs in one task; a take directly behind it
    bounds it, which one that never ends needs."""
    fields = T._parse_datatype_string(schema)
    full = T.StructType([T.StructField("value", fields if not isinstance(fields, T.StructType) else fields), T.StructField(SEQ, T.LongType())])

    def make(spark: SparkSession, most: int | None = None) -> DataFrame:
        def run(batches):
            import pandas as pd

            for _ in batches:
                state, at, rows = seed, 0, []
                while at != most and (step := generator(state)) is not None:
                    value, state = step
                    rows.append((value, at))
                    at += 1
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=["value", SEQ])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["value", SEQ])

        return spark.range(1).coalesce(1).mapInPandas(run, full)

    return frame_source(make, [SEQ], "unfold", {}, maker=generator, dense=SEQ)


def unfold_async(seed: Any, generator: Callable[[Any], Any], schema: str) -> Source:
    def step(state: Any) -> Any:
        async def call() -> Any:
            return await generator(state)

        return asyncio.run(call())

    s = unfold(seed, step, schema)
    return Source(Node("unfold-async", s.node.params, s.node.bind))


def from_channel(channel, schema: str) -> Source:
    """What a queue.Queue holds when the run starts, up to a None that ends it. Two runs compete for its elements."""

    def drain() -> list:
        import queue

        out = []
        while True:
            try:
                x = channel.get_nowait()
            except queue.Empty:
                return out
            if x is None:
                return out
            out.append(x)

    return _memory("from-channel", drain, schema)


class IngressQueue:
    """A bounded queue that is offered elements from outside. Accepted does not mean processed."""

    def __init__(self, options: BufferOptions):
        self.options = options
        self.items: collections.deque = collections.deque()
        self.dropped, self.closed, self.failure = 0, False, None
        self.lock = threading.Lock()

    def offer(self, x: Any) -> str:
        """accepted, dropped, full (try again), closed or failed."""
        with self.lock:
            if self.failure:
                return "failed"
            if self.closed:
                return "closed"
            if len(self.items) >= self.options.capacity:
                match self.options.overflow_policy:
                    case OverflowPolicy.BACKPRESSURE:
                        return "full"
                    case OverflowPolicy.DROP_NEWEST:
                        self.dropped += 1
                        return "dropped"
                    case OverflowPolicy.DROP_OLDEST:
                        self.items.popleft()
                        self.dropped += 1
                    case OverflowPolicy.DROP_BUFFER:
                        self.dropped += len(self.items)
                        self.items.clear()
                    case OverflowPolicy.FAIL:
                        self.failure = BufferOverflowError(f"more than {self.options.capacity} elements are waiting")
                        return "failed"
            self.items.append(x)
            return "accepted"

    def complete(self) -> None:
        self.closed = True

    def drain(self) -> list:
        with self.lock:
            if self.failure:
                raise self.failure
            out = list(self.items)
            self.items.clear()
            return out


def queue_(options: BufferOptions, schema: str) -> tuple[Source, IngressQueue]:
    options.check()
    q = IngressQueue(options)
    s = _memory("queue", q.drain, schema, {"capacity": options.capacity, "overflowPolicy": str(options.overflow_policy)})
    return Source(Node(s.node.kind, s.node.params, s.node.bind | {"queue": q})), q


def tick(initial_delay_micros: int, interval_micros: int, count: int, t0: int = 0) -> Source:
    """Tick numbers with their times; a streaming run has the endless form."""
    at_least("initial_delay_micros", initial_delay_micros, 0)
    positive("interval_micros", interval_micros)

    def make(spark: SparkSession) -> DataFrame:
        return spark.range(count).select(F.col("id").alias("value"), (F.lit(t0 + initial_delay_micros) + F.col("id") * interval_micros).alias("__df_ts"), F.col("id").alias(SEQ))

    return frame_source(make, [SEQ], "tick", {"initialDelayTicks": 10 * initial_delay_micros, "intervalTicks": 10 * interval_micros}, timed=True, dense=SEQ)


def from_registered(registry, stage: str, name: str, **params) -> Source:
    entry = registry.source(stage)
    make, order = entry.fn(**params)
    return Source(Node("registered", params, {"frame": make, "order": order, "time": None}, name=name, ref=entry.ref))
