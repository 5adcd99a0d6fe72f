"""Standard registered stages: timers, pushes, shared streams and topics, calls to services."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.lower import per_row
from tidemill.operators.order import SEQ, Context, Stream
from tidemill.options import OverflowPolicy
from tidemill.plans.registry import Registry

from . import IngressQueue, _rows


def _whole(name: str, least: int) -> Callable[[Any], str | None]:
    def check(params: Any) -> str | None:
        n = params.get(name)
        return None if isinstance(n, int) and not isinstance(n, bool) and n >= least else f"{name} must be a whole number of at least {least}"

    return check


def timer(period_micros: int, tick_limit: int, start_micros: int = 0):
    """Ticks that are never dropped, tick_limit of them. The endless form is tidemill.streaming.ticks."""
    make = lambda spark: spark.range(tick_limit).select(F.col("id").alias("value"), (F.lit(start_micros) + F.col("id") * period_micros).alias("at"), F.col("id").alias(SEQ))
    return make, [SEQ]


def pushed(queues: dict[str, tuple[IngressQueue, str]]):
    """What a named queue was offered from outside."""

    def source(queue: str):
        q, schema = queues[queue]
        return (lambda spark: _rows(spark, q.drain(), schema)), ["__df_at"]

    return source


def stream_source(path: str, order: str, cursor: int | None = None):
    """A shared stream in a folder, from a cursor on; replay includes the cursor's own element."""

    def make(spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(path)
        return df if cursor is None else df.where(F.col(order) >= cursor)

    return make, [order]


def stream_sink(df: DataFrame, params: dict) -> None:
    df.write.mode("append").parquet(params["path"])


def enumerable(makers: dict[str, tuple[Callable[[], Any], str]]):
    """Elements that a named callable yields, made once in each run."""

    def source(name: str):
        make, schema = makers[name]
        return (lambda spark: _rows(spark, list(make()), schema)), ["__df_at"]

    return source


class Timed:
    """A call that is given up after a time; it is made at most once for each offer."""

    def __init__(self, fn: Callable[[dict], Any], seconds: float):
        self.fn, self.seconds = fn, seconds

    def __call__(self, r: dict) -> Any:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.fn, r).result(self.seconds)
        finally:
            pool.shutdown(wait=False)


def call(services: dict[str, tuple[Callable[[dict], Any], str]]):
    """Calls a named service for each element, in order, with up to max_in_flight calls at once in a task."""

    def flow(ctx: Context, s: Stream, params: dict) -> Stream:
        fn, schema = services[params["service"]]
        seconds = params.get("timeout_micros", 30_000_000) / 1e6
        return per_row(s, Timed(fn, seconds), schema, params["max_in_flight"])

    return flow


def call_keyed(services: dict[str, tuple[Callable[[dict], Any], str]]):
    """As call, with one call at a time for each key and a key's elements in order: a key stays in one task."""

    def flow(ctx: Context, s: Stream, params: dict) -> Stream:
        fn, schema = services[params["service"]]
        s = ctx.dense(s)
        dealt = s.df.repartition(params["key"]).sortWithinPartitions(SEQ)
        return per_row(s.with_df(dealt), Timed(fn, params.get("timeout_micros", 30_000_000) / 1e6), schema, 1)

    return flow


class CallSink:
    """Calls a service for each element and keeps the mark of what it acknowledged."""

    def __init__(self, services: dict[str, Callable[[dict], Any]]):
        self.services, self.marks = services, {}

    def __call__(self, df: DataFrame, params: dict) -> None:
        fn, n = self.services[params["service"]], params["max_in_flight"]

        def each(batches):
            import pandas as pd

            with ThreadPoolExecutor(n) as pool:
                for pdf in batches:
                    rows = pdf.to_dict("records")
                    for _ in pool.map(fn, rows):
                        pass
                    yield pd.DataFrame({"n": [len(rows)]})

        done = df.mapInPandas(each, T.StructType([T.StructField("n", T.LongType())])).agg(F.sum("n")).head()[0] or 0
        self.marks[params["service"]] = {"acknowledged": self.marks.get(params["service"], {}).get("acknowledged", 0) + done}


def reminder(period_micros: int, minimum_micros: int, until_micros: int, start_micros: int = 0):
    """A trigger with a least period; ticks that were missed are gone, so only those until a time exist."""
    if period_micros < minimum_micros:
        raise ValueError(f"period_micros must be at least {minimum_micros}")
    return timer(period_micros, max(0, (until_micros - start_micros) // period_micros), start_micros)


def standard(queues: dict | None = None, makers: dict | None = None, services: dict | None = None, sinks: dict | None = None, policy: OverflowPolicy = OverflowPolicy.DROP_OLDEST) -> Registry:
    """A registry of all standard stages over the given queues, callables and services."""
    if policy == OverflowPolicy.BACKPRESSURE:
        raise ValueError("a clock or a topic cannot be slowed by one listener")
    r = Registry()
    r.add_source("spark/timer@v1", timer, _whole("period_micros", 1))
    r.add_source("spark/reminder@v1", reminder, _whole("period_micros", 1))
    r.add_source("spark/observable@v1", pushed(queues or {}))
    r.add_source("spark/observer@v1", pushed(queues or {}))
    r.add_source("spark/stream-source@v1", stream_source)
    r.add_source("spark/topic-source@v1", stream_source)
    r.add_source("spark/enumerable@v1", enumerable(makers or {}))
    r.add_flow("spark/call@v1", call(services or {}), _whole("max_in_flight", 1))
    r.add_flow("spark/call-keyed@v1", call_keyed(services or {}))
    r.add_sink("spark/stream-sink@v1", stream_sink)
    r.add_sink("spark/topic-sink@v1", stream_sink)
    r.add_sink("spark/call-sink@v1", CallSink(sinks or {}), _whole("max_in_flight", 1))
    return r

