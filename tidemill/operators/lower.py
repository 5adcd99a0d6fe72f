"""Lowering of stages to DataFrames: one function for each stage kind."""

from __future__ import annotations

import asyncio
import inspect
import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import UnboundedSourceError
from tidemill.functions import Fold, Py, column
from tidemill.options import ActiveKeyOverflowPolicy, KeyOverflowPolicy, OverflowPolicy, RetryExhaustion, SupervisionForm, ThrottleMode

from .interpreter import Chain, Substreams, Supervised, sequential
from .order import ERR, KEY, LAST, SEQ, TIE, TS, Context, Stream, checkpointed

Lower = Callable[[Context, Stream, dict], Stream]
LOWER: dict[str, Lower] = {}


def stage(*kinds: str) -> Callable[[Lower], Lower]:
    def add(f: Lower) -> Lower:
        for k in kinds:
            LOWER[k] = f
        return f

    return add


def apply(ctx: Context, s: Stream, steps: list[tuple[str, dict]]) -> Stream:
    for kind, b in steps:
        s = LOWER[kind](ctx, s, b)
    return s


def projected(s: Stream, what: Any) -> list[Column]:
    """Columns of a selection: a mapping of names, or one expression named value."""
    items = what.items() if isinstance(what, dict) else [("value", what)]
    out = []
    for name, e in items:
        c = column(e)
        out.append((F.when(s.ok(), c) if s.err else c).alias(name))
    return out


def element(s: Stream) -> Column:
    return F.struct(*s.columns)


def where(s: Stream, cond: Column) -> Stream:
    """Rows where cond is true, and failures."""
    keep = F.coalesce(cond, F.lit(False))
    return s.with_df(s.df.where(keep | F.col(ERR).isNotNull() if s.err else keep), dense=False)


async def awaited(x: Any) -> Any:
    """x, or what it stands for if it has to be awaited; the elements of an asynchronous iterable as a list."""
    if inspect.isawaitable(x):
        x = await x
    return [y async for y in x] if hasattr(x, "__aiter__") else x


def called(fn: Callable[[dict], Any], records: list[dict], workers: int, ordered: bool) -> Iterator[tuple[int, Any]]:
    """(place, result) of a function of each record, `workers` calls at once: threads, or tasks of one event loop where
    the function is a coroutine function or gives an asynchronous iterable."""

    async def all_at_once() -> list[tuple[int, Any]]:
        gate, done = asyncio.Semaphore(workers), []

        async def one(i: int) -> None:
            async with gate:
                done.append((i, await awaited(fn(records[i]))))

        async with asyncio.TaskGroup() as group:
            for i in range(len(records)):
                group.create_task(one(i))
        return done

    body = getattr(fn, "func", fn)
    if inspect.iscoroutinefunction(body) or inspect.isasyncgenfunction(body):
        try:
            done = asyncio.run(all_at_once())
        except ExceptionGroup as e:
            raise e.exceptions[0] from None  # the first failure is the run's
        yield from sorted(done, key=lambda x: x[0]) if ordered else done
        return
    with ThreadPoolExecutor(workers) as pool:
        if ordered:
            yield from enumerate(pool.map(fn, records))
        else:
            waiting = {pool.submit(fn, r): i for i, r in enumerate(records)}
            for f in as_completed(waiting):
                yield waiting[f], f.result()


def per_row(s: Stream, fn: Callable[[dict], Any], schema: str, workers: int = 1, ordered: bool = True, each: Callable[[dict, Any], Any] | None = None) -> Stream:
    """A Python function of each element, in Arrow batches, with up to `workers` calls at once in a task. each(record,
    result) makes the element that comes out; by default the result is that."""
    names, internal = s.columns, s.internal
    fields = T._parse_datatype_string(schema)
    if not isinstance(fields, T.StructType):
        fields = T.StructType([T.StructField("value", fields)])
    outs = [f.name for f in fields]
    full = T.StructType([*fields, *(f for f in s.df.schema if f.name in internal)])
    has_err = s.err

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            records = pdf[names].astype(object).where(pdf[names].notna(), None).to_dict("records")
            todo = [i for i in range(len(records)) if not has_err or pd.isna(pdf[ERR].iloc[i])]
            done = {todo[i]: each(records[todo[i]], y) if each else y for i, y in called(fn, [records[i] for i in todo], workers, ordered)}
            at = list(range(len(records))) if ordered else list(done) + [i for i in range(len(records)) if i not in done]
            found = [done.get(i) for i in at]
            found = [y if isinstance(y, dict) else {"value": y} for y in found]
            out = pd.DataFrame({n: pd.Series([y.get(n) for y in found], dtype=object) for n in outs})
            yield pd.concat([out, pdf[internal].iloc[at].reset_index(drop=True)], axis=1)

    return s.with_df(s.df.mapInPandas(run, full))


#: Stages that carry nothing from one element to the next.
STATELESS = ("select", "where", "select-many", "merge-map", "select-async", "select-async-unordered", "select-value-task-async", "select-value-task-async-unordered")

# B: stateless


@stage("select")
def select(ctx: Context, s: Stream, b: dict) -> Stream:
    if isinstance(b.get("fn"), Py):
        return per_row(s, b["fn"].fn, b["fn"].schema)
    return s.with_df(s.df.select(*projected(s, b["fn"]), *s.internal))


@stage("where")
def filter_(ctx: Context, s: Stream, b: dict) -> Stream:
    if isinstance(b["fn"], Py):
        kept = per_row(s, b["fn"].fn, f"{ddl(s)}, __keep boolean", each=lambda r, y: {**r, "__keep": bool(y)})
        kept = where(kept, F.col("__keep"))
        return kept.with_df(kept.df.drop("__keep"))
    return where(s, column(b["fn"]))


@stage("select-many", "merge-map")
def select_many(ctx: Context, s: Stream, b: dict) -> Stream:
    """Flatten an array, or what a function gives: an iterable, or an asynchronous one, of which merge-map reads
    max_concurrency at once in a task; a null array fails. The order is that of the element and then the place in its array."""
    if isinstance(b["fn"], Py):
        workers = b["options"].max_concurrency if "options" in b else 1
        s2 = per_row(s, b["fn"].fn, f"value array<{b['fn'].schema}>", workers, each=lambda _, y: {"value": None if y is None else list(y)})
        array = F.col("value")
    else:
        s2, array = s, column(b["fn"])
    s2 = s2 if s2.order == (SEQ,) else ctx.dense(s2)
    s2 = s2.with_df(s2.df.withColumn("__df_array", array))
    checked = ctx.fail_at(s2, F.col("__df_array").isNull(), "DataflowError", F.lit("the sequence of an element is null")) if b.get("check", True) else s2
    inner = F.posexplode_outer("__df_array") if checked.err else F.posexplode("__df_array")
    keep = [c for c in checked.internal if c not in (TIE, "__df_array")]
    df = checked.df.select(*keep, F.size("__df_array").alias("__df_n"), inner.alias("__df_pos", "value"))
    if checked.err:
        df = df.where(F.col(ERR).isNotNull() | (F.col("__df_n") > 0))
    df = df.withColumn(TIE, F.coalesce(F.col("__df_pos"), F.lit(0)).cast("long")).drop("__df_pos", "__df_n")
    if isinstance(checked_type := dict(df.dtypes).get("value"), str) and checked_type.startswith("struct<") and b.get("spread", True):
        df = df.select("value.*", *[c for c in df.columns if c != "value"])
    return checked.with_df(df, order=(SEQ, TIE), dense=False)


@stage("select-async", "select-value-task-async")
def select_async(ctx: Context, s: Stream, b: dict) -> Stream:
    if not isinstance(b["fn"], Py):
        return select(ctx, s, b)
    return per_row(s, b["fn"].fn, b["fn"].schema, b["options"].max_concurrency)


@stage("select-async-unordered", "select-value-task-async-unordered")
def select_async_unordered(ctx: Context, s: Stream, b: dict) -> Stream:
    if not isinstance(b["fn"], Py):
        return select(ctx, s, b)
    return per_row(s, b["fn"].fn, b["fn"].schema, b["options"].max_concurrency, ordered=False)


@stage("registered")
def registered(ctx: Context, s: Stream, b: dict) -> Stream:
    return b["flow"](ctx, s, b["params"])


@stage("fault-point")
def fault_point(ctx: Context, s: Stream, b: dict) -> Stream:
    """Fails the run at the first element where the condition holds."""
    return ctx.fail_at(s, column(b["fn"]), "DataflowError", F.lit("fault point"))


# C: positional


@stage("take")
def take(ctx: Context, s: Stream, b: dict) -> Stream:
    if s.part:
        ranked = s.df.withColumn("__df_r", F.row_number().over(s.window())).where(F.col("__df_r") <= b["n"]).drop("__df_r")
        return s.with_df(ranked)
    if s.dense and not s.err:
        return s.with_df(s.df.where(F.col(SEQ) < b["n"]))
    return s.with_df(s.df.orderBy(*s.order).limit(b["n"]))


@stage("skip")
def skip(ctx: Context, s: Stream, b: dict) -> Stream:
    s = ctx.dense(s)
    return where(s, F.col(SEQ) >= b["n"])


def first_where(s: Stream, cond: Column) -> Column:
    """The order key of the first row where cond holds; null if none does."""
    return s.df.where(cond).agg(F.min(s.key()).alias("k")).scalar()


def stops(s: Stream, e: Any) -> Column:
    return ~F.coalesce(column(e), F.lit(False)) & s.ok()


@stage("take-while")
def take_while(ctx: Context, s: Stream, b: dict) -> Stream:
    if not s.part:  # the end is one key, found by an aggregate: no task sees the whole stream
        s = ctx.settled(s)
        return s.with_df(s.df.where(F.coalesce(s.key() < first_where(s, stops(s, b["fn"])), F.lit(True))))
    r = ctx.running(s, {"__df_stop": ("max", stops(s, b["fn"]), True)})
    return r.with_df(r.df.where(~F.coalesce("__df_stop", F.lit(False))).drop("__df_stop"))


@stage("take-through")
def take_through(ctx: Context, s: Stream, b: dict) -> Stream:
    if not s.part:
        s = ctx.settled(s)
        return s.with_df(s.df.where(F.coalesce(s.key() <= first_where(s, stops(s, b["fn"])), F.lit(True))))
    r = ctx.running(s, {"__df_stop": ("max", stops(s, b["fn"]), False)})
    return r.with_df(r.df.where(~F.coalesce("__df_stop", F.lit(False))).drop("__df_stop"))


@stage("skip-while")
def skip_while(ctx: Context, s: Stream, b: dict) -> Stream:
    if not s.part:
        s = ctx.settled(s)
        return where(s, F.coalesce(s.key() >= first_where(s, stops(s, b["fn"])), F.lit(False)))
    r = ctx.running(s, {"__df_stop": ("max", stops(s, b["fn"]), True)})
    r = where(r, F.col("__df_stop"))
    return r.with_df(r.df.drop("__df_stop"))


@stage("distinct")
def distinct(ctx: Context, s: Stream, b: dict) -> Stream:
    """First occurrences. The key past the bound fails, or the key that arrived first is forgotten."""
    o = b["options"]
    if o.overflow_policy == KeyOverflowPolicy.EVICT_OLDEST:
        steps = [("distinct", {"options": o})]
        return sequential(ctx, s, lambda: Chain(steps), ddl(s))
    by = [*s.part, *s.columns, *([ERR] if s.err else [])]
    rest = [c for c in s.internal if c not in by]
    # an aggregate, so that a value with very many rows is reduced where they stand
    firsts = s.df.groupBy(*by).agg(F.min_by(F.struct(*rest), s.key()).alias("__df_first"))
    s = s.with_df(firsts.select(*by, *[F.col("__df_first")[c].alias(c) for c in rest]), dense=False)
    s = ctx.dense(s)
    if s.part:
        return bounded_part(ctx, s, F.col(SEQ) >= o.max_tracked_keys, f"more than {o.max_tracked_keys} keys")
    return ctx.fail_at(s, F.col(SEQ) >= o.max_tracked_keys, "TrackedKeyOverflowError", F.lit(f"more than {o.max_tracked_keys} keys"))


def bounded_part(ctx: Context, s: Stream, cond: Column, message: str) -> Stream:
    err = F.when(cond & s.ok(), F.lit(f"TrackedKeyOverflowError: {message}")).otherwise(F.col(ERR) if s.err else F.lit(None).cast("string"))
    return s.with_df(s.df.withColumn(ERR, err), err=True)


def ddl(s: Stream) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.df.schema if f.name in s.columns)


@stage("deduplicate-consecutive")
def deduplicate_consecutive(ctx: Context, s: Stream, b: dict) -> Stream:
    r = ctx.previous(s, {"__df_before": F.struct(element(s).alias("e"))})
    r = where(r, ~(F.col("__df_before").isNotNull() & F.col("__df_before.e").eqNullSafe(element(s))))
    return r.with_df(r.df.drop("__df_before"))


# D: folds


@stage("scan", "scan-async")
def scan(ctx: Context, s: Stream, b: dict) -> Stream:
    """Every state, never the seed."""
    f: Fold = b["fold"]
    if f.kind == "python":
        return sequential(ctx, s, lambda: Chain([("scan", b)]), f"value {f.schema}")
    if f.kind == "last":
        return s.with_df(s.df.select(column(f.value).alias("value"), *s.internal))
    if f.kind == "count" and not s.part:
        s = ctx.dense(s)
        return s.with_df(s.df.select((F.col(SEQ) + 1 + f.seed).alias("value"), *s.internal))
    value = F.lit(1) if f.kind == "count" else column(f.value)
    r = ctx.running(s, {"__df_run": ({"sum": "sum", "count": "count", "min": "min", "max": "max"}[f.kind], value, True)})
    state = F.col("__df_run")
    if f.kind in ("sum", "count"):
        state = F.coalesce(state, F.lit(0)) + F.lit(f.seed) if f.seed else F.coalesce(state, F.lit(0))
    return r.with_df(r.df.select(state.alias("value"), *r.internal).drop("__df_run"))


# E: batches and substreams


def listed(s: Stream) -> Column:
    """The elements of a group in order."""
    e = F.col(s.columns[0]) if s.columns == ["value"] else element(s)
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(SEQ).alias("s"), e.alias("v")))), lambda x: x["v"]).alias("value")


def errors_of(s: Stream) -> DataFrame | None:
    return s.df.where(F.col(ERR).isNotNull()) if s.err else None


def with_errors(s: Stream, df: DataFrame, errors: DataFrame | None) -> DataFrame:
    """Failures join what a batch stage made of the other rows."""
    if errors is None:
        return df
    lines = errors.select(*s.part, F.col(SEQ), F.lit(0).cast("long").alias(TIE), ERR)
    return df.unionByName(lines, allowMissingColumns=True)


@stage("grouped")
def grouped(ctx: Context, s: Stream, b: dict) -> Stream:
    size = b["size"]
    outer = SEQ if not s.part else "__df_outer"
    if s.part:
        s = s if s.order == (SEQ,) else ctx.dense(replace(s, part=()))
        s = s.with_df(s.df.withColumn(outer, F.col(SEQ)), dense=False)
        s = s.with_df(s.df.withColumns({"__df_place": F.row_number().over(s.window()) - 1, "__df_open": F.min(SEQ).over(Window.partitionBy(*s.part))}))
    else:
        s = ctx.dense(s)
        s = s.with_df(s.df.withColumns({"__df_place": F.col(SEQ), "__df_open": F.lit(0).cast("long")}))
    rows = s.df.where(s.ok()).withColumn("__df_g", F.expr(f"__df_place div {size}"))
    made = rows.groupBy(*s.part, "__df_g").agg(listed(s), F.max(SEQ).alias("__df_last"), F.count(F.lit(1)).alias("__df_c"), F.min("__df_open").alias("__df_open"))
    full = F.col("__df_c") == size
    made = made.select("value", *s.part, F.when(full, F.col("__df_last")).otherwise(LAST).alias(SEQ), F.when(full, F.lit(0)).otherwise(F.col("__df_open")).cast("long").alias(TIE))
    return s.with_df(with_errors(s, made, errors_of(s)), order=(SEQ, TIE), dense=False, timed=False)


@stage("sliding")
def sliding(ctx: Context, s: Stream, b: dict) -> Stream:
    """Windows [k*step, k*step+size); a rest only if it holds an element that no full window carried."""
    size, step = b["size"], b["step"]
    outer = s.part
    s = s if s.order == (SEQ,) else ctx.dense(replace(s, part=()))
    s = replace(s, part=outer, dense=False)
    rows = s.df.where(s.ok())
    if outer:
        w = Window.partitionBy(*outer)
        rows = rows.withColumns({"__df_place": F.row_number().over(w.orderBy(SEQ)) - 1, "__df_n": F.count(F.lit(1)).over(w), "__df_open": F.min(SEQ).over(w)})
    else:
        d = ctx.dense(s.with_df(rows))
        rows = d.df.withColumns({"__df_place": F.col(SEQ), "__df_n": d.df.agg(F.count(F.lit(1)).alias("n")).scalar(), "__df_open": F.lit(0).cast("long")})
    rows = rows.withColumn("__df_full", F.expr(f"CASE WHEN __df_n < {size} THEN 0 ELSE (__df_n - {size}) div {step} + 1 END"))
    first = f"greatest(0, (__df_place - {size}) div {step} + IF(__df_place >= {size}, 1, 0))"
    rows = rows.withColumn("__df_g", F.explode(F.expr(f"filter(sequence(least({first}, __df_place div {step}), __df_place div {step}), w -> __df_place < w * {step} + {size})")))
    reach = f"CASE WHEN __df_full > 0 THEN (__df_full - 1) * {step} + {size} ELSE 0 END"
    rows = rows.where(F.expr(f"__df_g < __df_full OR (__df_g = __df_full AND __df_n > greatest(__df_full * {step}, {reach}))"))
    made = rows.groupBy(*outer, "__df_g").agg(listed(s), F.max(SEQ).alias("__df_last"), (F.min("__df_g") < F.min("__df_full")).alias("__df_whole"), F.min("__df_open").alias("__df_open"))
    made = made.select("value", *outer, F.when(F.col("__df_whole"), F.col("__df_last")).otherwise(LAST).alias(SEQ), F.when(F.col("__df_whole"), F.lit(0)).otherwise(F.col("__df_open")).cast("long").alias(TIE))
    return s.with_df(with_errors(s, made, errors_of(s)), order=(SEQ, TIE), dense=False, timed=False)


class Within:
    """Groups that close on count, on weight or when the time since their first element is over."""

    ended = False

    def __init__(self, size: int, window: int, max_weight: int | None = None, cost=None, scalar: bool = False):
        self.size, self.window, self.max_weight, self.cost, self.scalar = size, window, max_weight, cost, scalar
        self.open: list = []
        self.since = self.weight = 0

    def _close(self) -> list:
        out, self.open, self.weight = [{"value": self.open}], [], 0
        return out

    def offer(self, x: dict) -> list:
        now = x.pop("__ts")
        out: list = []
        if self.open and now >= self.since + self.window:
            out += self._close()
        weight = 0
        if self.max_weight is not None:
            weight = self.cost(x)
            if weight < 0 or weight > self.max_weight:
                raise ValueError(f"a weight of {weight} is not within 0..{self.max_weight}")
            if self.open and self.weight + weight > self.max_weight:
                out += self._close()
        if not self.open:
            self.since = now
        self.open.append(x["value"] if self.scalar else x)
        self.weight += weight
        if len(self.open) >= self.size:
            out += self._close()
        return out

    def flush(self) -> list:
        return self._close() if self.open else []


@stage("grouped-within", "grouped-weighted-within")
def grouped_within(ctx: Context, s: Stream, b: dict) -> Stream:
    need_time(s)
    scalar = s.columns == ["value"]
    inner = dict(s.df.dtypes)["value"] if scalar else "struct<" + ",".join(f"`{n}`:{t}" for n, t in s.df.dtypes if n in s.columns) + ">"
    s = s if s.dense else ctx.dense(s)
    if ctx.large(s) and not s.part and not s.err and b["size"] <= ctx.block:
        return within_blocks(ctx, s, b, inner)
    s = s.with_df(s.df.withColumn("__ts", F.col(TS)))
    args = (b["size"], b["window"], b.get("max_weight"), b.get("cost"), scalar)
    return sequential(ctx, s, lambda: Within(*args), f"value array<{inner}>")


def next_starts(ts, weight, size: int, window: int, most: int | None):
    """For a group that begins at each place, where the next one begins: behind `size` elements, at the first that comes
    when the time is over, or at the first that makes it too heavy. Past the end: the group is still open."""
    import numpy as np

    n = len(ts)
    out = np.minimum(np.arange(n) + size, n + size)
    if n and (np.diff(ts) >= 0).all():
        late = np.searchsorted(ts, ts + window, side="left")
        out = np.minimum(out, np.where(late < n, late, n + size))
    else:
        for i in range(n):
            for j in range(i + 1, min(i + size, n)):
                if ts[j] >= ts[i] + window:
                    out[i] = j
                    break
    if most is not None:
        total = np.cumsum(weight)
        heavy = np.searchsorted(total, total - weight + most, side="right")
        out = np.minimum(out, np.where(heavy < n, heavy, n + size))
    return np.where(out > n, n + size, np.maximum(out, np.arange(n) + 1))


def within_blocks(ctx: Context, s: Stream, b: dict, inner: str) -> Stream:
    """Groups of a large stream in three phases. Each block of positions, with as many rows of the next as a group can hold,
    tells for each place at which a group may begin in it where the first one of the next block begins; one small row for
    each block is composed in order; then each block makes its groups."""
    size, window, most, cost = b["size"], b["window"], b.get("max_weight"), b.get("cost")
    names, block, scalar = s.columns, ctx.block, s.columns == ["value"]
    if most is not None:
        s = per_row(s, cost, f"{ddl(s)}, __weight long", each=lambda r, y: {**r, "__weight": y})
        outside = (F.col("__weight") < 0) | (F.col("__weight") > most)
        s = ctx.fail_at(s, outside, "ValueError", F.concat(F.lit("a weight of "), F.col("__weight").cast("string"), F.lit(f" is not within 0..{most}")))
    errors = errors_of(s)
    rows = s.df.where(s.ok()).withColumn("__df_home", F.expr(f"{SEQ} div {block}"))
    reach = F.when((F.col(SEQ) % block < size) & (F.col("__df_home") > 0), F.array(F.col("__df_home"), F.col("__df_home") - 1)).otherwise(F.array("__df_home"))
    rows = checkpointed(rows.withColumn("__df_block", F.explode(reach)))

    def arrays(pdf):
        pdf = pdf.sort_values(SEQ)
        own = int((pdf["__df_home"] == pdf["__df_block"]).sum())
        weight = pdf["__weight"].to_numpy() if most is not None else None
        return pdf, own, next_starts(pdf[TS].to_numpy(), weight, size, window, most)

    def lead(pdf):
        import pandas as pd

        pdf, own, nxt = arrays(pdf)
        ends = [0] * own
        for i in range(own - 1, -1, -1):
            ends[i] = int(nxt[i]) - own if nxt[i] >= own else ends[nxt[i]]
        return pd.DataFrame({"__df_block": [int(pdf["__df_block"].iloc[0])], "own": [own], "ends": [ends[:size]]})

    def compose(batches):
        import pandas as pd

        at = 0
        for pdf in batches:
            begin = []
            for own, ends in zip(pdf["own"], pdf["ends"], strict=True):
                begin.append(at)
                at = int(ends[at]) if at < own else at - int(own)
            yield pd.DataFrame({"__df_b": pdf["__df_block"], "begin": begin})

    leads = rows.groupBy("__df_block").applyInPandas(lead, "__df_block long, own long, ends array<long>")
    begins = checkpointed(leads.repartition(1).sortWithinPartitions("__df_block").mapInPandas(compose, "__df_b long, begin long"))

    def make(pdf):
        import pandas as pd

        begin = int(pdf["begin"].iloc[0])
        pdf, own, nxt = arrays(pdf)
        n, seq = len(pdf), pdf[SEQ].to_numpy()
        found, at = [], begin
        values = pdf["value"].tolist() if scalar else pdf[names].astype(object).where(pdf[names].notna(), None).to_dict("records")
        while at < own:
            end = int(nxt[at])
            last = min(end, n)
            set_free = int(seq[last - 1]) if last - at == size else int(seq[end]) if end < n else LAST
            found.append((values[at:last], set_free, 0))
            at = end
        return pd.DataFrame(found, columns=["value", SEQ, TIE]).astype({SEQ: "int64", TIE: "int64"})

    made = rows.join(begins, F.col("__df_block") == F.col("__df_b")).groupBy("__df_block").applyInPandas(make, f"value array<{inner}>, {SEQ} long, {TIE} long")
    return s.with_df(with_errors(s, made, errors), order=(SEQ, TIE), dense=False, timed=False)


def placed(ctx: Context, s: Stream) -> Stream:
    """SEQ orders the stream, without gaps or not: one whole-numbered order column of a small stream does as it is."""
    if len(s.order) == 1 and not ctx.large(s) and dict(s.df.dtypes)[s.order[0]] in ("int", "bigint"):
        return s.with_df(s.df.withColumn(SEQ, F.col(s.order[0]).cast("long")).drop(s.order[0]), order=(SEQ,), dense=False)
    return ctx.dense(s)


@stage("group-by")
def group_by(ctx: Context, s: Stream, b: dict) -> Stream:
    """One private instance of the flow for each key. Without eviction, every key is a partition of the flow's windows."""
    o = b["options"]
    python = any(isinstance(x.get("fn"), Py) or isinstance(x.get("fold"), Fold) and x["fold"].kind == "python" for _, x in b["steps"])
    if o.overflow_policy == ActiveKeyOverflowPolicy.EVICT_IDLE or isinstance(b["key"], Py) and b["key"].schema is None:
        key = b["key"].fn if isinstance(b["key"], Py) else (lambda r, k=b["key"]: r[k])
        steps = python_steps(b["steps"])
        return sequential(ctx, s, lambda: Substreams(key, steps, o), b.get("schema") or ddl(s))
    if isinstance(b["key"], Py):
        names = s.columns
        s = per_row(s, b["key"].fn, f"{ddl(s)}, __key {b['key'].schema}", each=lambda r, y: {**r, "__key": y})
        s = s.with_df(s.df.withColumn(KEY, F.col("__key")).select(*names, KEY, *s.internal))
    else:
        s = s.with_df(s.df.withColumn(KEY, column(b["key"])))
    if s.order != (SEQ,):
        s = placed(ctx, s)
    # the key past the bound arrives at the bound's place among the keys' first positions
    firsts = s.df.where(s.ok()).groupBy(KEY).agg(F.min(SEQ).alias("first"))
    counted = ctx.dense(Stream(firsts.select("first", F.col("first").alias("__df_o0")), ("__df_o0",))).df
    past_at = counted.where(F.col(SEQ) == o.max_active_keys).agg(F.min("first").alias("k")).scalar()
    message = F.concat(F.lit("TrackedKeyOverflowError: key "), F.coalesce(F.col(KEY).cast("string"), F.lit("null")), F.lit(f" is one more than {o.max_active_keys}"))
    err = F.when(F.coalesce(F.col(SEQ) == past_at, F.lit(False)), message).otherwise(F.col(ERR) if s.err else F.lit(None).cast("string"))
    s = s.with_df(s.df.where(F.coalesce(F.col(SEQ) <= past_at, F.lit(True))).withColumn(ERR, err), err=True, dense=False, part=(KEY,))
    if python:  # keys are independent: one machine for each, in the task of its key
        steps = python_steps(b["steps"])
        out = sequential(ctx, s.with_df(s.df, dense=True), lambda: Chain(steps), b.get("schema") or ddl(s))
    else:
        out = apply(ctx, s, b["steps"])
    named = b.get("key_name")
    df = out.df.withColumn(named, F.col(KEY)) if named else out.df
    return out.with_df(df.drop(KEY), part=(), dense=False)


def python_steps(steps: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """Steps with their Python functions, for the interpreter."""
    out = []
    for kind, b in steps:
        fn = b.get("fn")
        if fn is not None and not isinstance(fn, Py):
            raise ValueError(f"{kind} needs a Python function (Py) here")
        out.append((kind, b | ({"py": fn.fn} if fn is not None else {})))
    return out


# F: time


def need_time(s: Stream) -> None:
    if not s.timed:
        raise ValueError("this stage needs a source with a time column")


def start(s: Stream, b: dict) -> Column:
    """When the run starts: given, or the first arrival."""
    return F.lit(b["t0"]) if b.get("t0") is not None else s.df.agg(F.min(TS).alias("t")).scalar()


@stage("initial-delay")
def initial_delay(ctx: Context, s: Stream, b: dict) -> Stream:
    need_time(s)
    return s.with_df(s.df.withColumn(TS, F.greatest(TS, start(s, b) + b["delay"])))


@stage("delay")
def delay(ctx: Context, s: Stream, b: dict) -> Stream:
    """Shifts every element; with a holdback that overflows, its policy."""
    need_time(s)
    o = b.get("options")
    if o is None or o.overflow_policy == OverflowPolicy.BACKPRESSURE:
        return s.with_df(s.df.withColumn(TS, F.col(TS) + b["delay"]))
    return lossy(ctx, s, o, lambda: FixedDelay(b["delay"], o))


@stage("timeout")
def timeout(ctx: Context, s: Stream, b: dict) -> Stream:
    need_time(s)
    t0 = start(s, b)
    r = ctx.previous(s, {"__df_was": F.col(TS)})
    gap = F.col(TS) - F.coalesce(F.col("__df_was"), t0)
    r = ctx.fail_at(r, gap >= b["gap"], "StreamTimeoutError", F.concat(F.lit("nothing for "), gap.cast("string"), F.lit(" microseconds")))
    return r.with_df(r.df.drop("__df_was"))


@stage("take-within")
def take_within(ctx: Context, s: Stream, b: dict) -> Stream:
    need_time(s)
    return s.with_df(s.df.where(F.col(TS) < start(s, b) + b["window"]))


@stage("skip-within")
def skip_within(ctx: Context, s: Stream, b: dict) -> Stream:
    need_time(s)
    return where(s, F.col(TS) >= start(s, b) + b["window"])


@stage("throttle")
def throttle(ctx: Context, s: Stream, b: dict) -> Stream:
    """Token bucket as two running maxima, in whole microseconds times the rate.

    With C the cost up to a row, c its own, R units in P microseconds and a bucket of B that is full at t0, the row can go
    at v = P*C + max(R*t0 - P*B, max over rows j up to it of R*ts_j - P*B - P*C_(j-1)), over R, and leaves after those before it."""
    need_time(s)
    o = b["options"]
    r, p, burst = o.elements, o.per_micros, o.burst
    cost = column(b["cost"]).cast("long") if b.get("cost") is not None else F.lit(1).cast("long")
    t0 = start(s, b)
    s = s.with_df(s.df.withColumn("__df_cost", cost))
    s = ctx.fail_at(s, (F.col("__df_cost") < 0) | (F.col("__df_cost") > burst), "RateLimitExceededError", F.concat(F.lit("a cost of "), F.col("__df_cost").cast("string"), F.lit(f" is not within 0..{burst}"))) if b.get("cost") is not None else s
    s = ctx.running(s, {"__df_sum": ("sum", F.col("__df_cost"), True)})
    s = ctx.settled(s)  # each running aggregate reads its stream twice
    s = ctx.running(s, {"__df_peak": ("max", F.col(TS) * r - p * burst - (F.col("__df_sum") - F.col("__df_cost")) * p, True)})
    v = F.ceil((F.col("__df_sum") * p + F.greatest(t0 * r - p * burst, F.col("__df_peak"))) / r).cast("long") if r != 1 else F.col("__df_sum") * p + F.greatest(t0 - p * burst, F.col("__df_peak"))
    v = F.when(F.col("__df_cost") == 0, F.col(TS)).otherwise(v)
    s = s.with_df(s.df.withColumn("__df_v", v))
    if o.mode == ThrottleMode.ENFORCING:
        s = ctx.fail_at(s, F.col("__df_v") > F.col(TS), "RateLimitExceededError", F.lit(f"more than {r} in {p} microseconds"))
    else:
        s = ctx.running(ctx.settled(s), {"__df_out": ("max", F.greatest(TS, "__df_v"), True)})
        s = s.with_df(s.df.withColumn(TS, F.col("__df_out")))
    return s.with_df(s.df.drop("__df_cost", "__df_sum", "__df_peak", "__df_v", "__df_out"))


class Held:
    """A bounded buffer in virtual time: elements arrive at their time and leave when the consumer is free again."""

    ended = False

    def __init__(self, service: int, o):
        self.service, self.o = service, o
        self.counts = {"dropped": 0}
        self.held: list[tuple[int, dict]] = []
        self.free = -(1 << 62)

    def _leave(self, until: int) -> list:
        out = []
        while self.held and max(self.free, self.held[0][0]) <= until:
            ts, x = self.held.pop(0)
            t = max(self.free, ts)
            self.free = t + self.service
            out.append(x | {"__ts": t})
        return out

    def offer(self, x: dict) -> list:
        now = x.pop("__ts")
        out = self._leave(now)
        if not self.held and self.free <= now:
            self.held.append((now, x))
            return out + self._leave(now)
        if len(self.held) >= self.o.capacity:
            match self.o.overflow_policy:
                case OverflowPolicy.FAIL:
                    from tidemill.errors import BufferOverflowError

                    raise BufferOverflowError(f"more than {self.o.capacity} elements are held")
                case OverflowPolicy.DROP_NEWEST:
                    self.counts["dropped"] += 1
                    return out
                case OverflowPolicy.DROP_OLDEST:
                    self.counts["dropped"] += 1
                    self.held.pop(0)
                case OverflowPolicy.DROP_BUFFER:
                    self.counts["dropped"] += len(self.held)
                    self.held.clear()
        self.held.append((now, x))
        return out

    def flush(self) -> list:
        return self._leave(1 << 62)


class FixedDelay(Held):
    """Each element is held for the same time; the buffer holds those that wait."""

    def __init__(self, wait: int, o):
        super().__init__(0, o)
        self.wait = wait

    def _leave(self, until: int) -> list:
        out = []
        while self.held and self.held[0][0] + self.wait <= until:
            ts, x = self.held.pop(0)
            out.append(x | {"__ts": ts + self.wait})
        return out


def lossy(ctx: Context, s: Stream, o, make: Callable) -> Stream:
    s = s if s.dense else ctx.dense(s)
    s = s.with_df(s.df.withColumn("__ts", F.col(TS)))
    out = sequential(ctx, s, make, ddl(s))
    return out.with_df(out.df.withColumnRenamed("__ts", TS), timed=True)


@stage("buffer")
def buffer(ctx: Context, s: Stream, b: dict) -> Stream:
    """Without loss it only decouples, which Spark's stages do. Other policies depend on the consumer's time for an element."""
    o = b["options"]
    if o.overflow_policy == OverflowPolicy.BACKPRESSURE:
        return s
    need_time(s)
    return lossy(ctx, s, o, lambda: Held(b["service"], o))


@stage("valve")
def valve(ctx: Context, s: Stream, b: dict) -> Stream:
    """A gate in the stream's time, by the times at which its handle was opened and closed: what arrives while it is closed
    is held, in order, and leaves when it opens. What it still holds at its last closing would keep a batch run from
    ending; the run ends without it, and a run after a later opening gives it."""
    control = b["control"]
    if not control.moves:
        return s if control.is_open else s.with_df(s.df.limit(0))
    need_time(s)
    out = F.col(TS)
    held = F.lit(False)
    for since, until in control.closed_spans():
        inside = (F.col(TS) >= since if since is not None else F.lit(True)) & (F.col(TS) < until if until is not None else F.lit(True))
        if until is None:
            held = inside
        else:
            out = F.when(inside, F.lit(until)).otherwise(out)
    return s.with_df(s.df.where(~held | ~s.ok()).withColumn(TS, out), dense=False)


@stage("feedback")
def feedback(ctx: Context, s: Stream, b: dict) -> Stream:
    """Rounds over what goes back, each stored, until nothing does. A round's elements leave behind those of the rounds before."""
    o, names = b["options"], s.columns
    now, done, turn = s, None, 0
    while True:
        made = ctx.dense(apply(ctx, now, b["steps"]))
        if made.columns != names:
            raise ValueError("the flow of a cycle gives the columns that it takes")
        back = F.coalesce(column(b["fn"]), F.lit(False)) & made.ok()
        df = checkpointed(made.df.withColumns({"__df_back": back, "__df_turn": F.lit(turn)}))
        out = df.where(~F.col("__df_back")).drop("__df_back")
        done = out if done is None else done.unionByName(out, allowMissingColumns=True)
        rest = df.where("__df_back").drop("__df_back", "__df_turn")
        n = rest.count()
        if n > o.capacity:
            match o.overflow_policy:
                case OverflowPolicy.FAIL:
                    from tidemill.errors import BufferOverflowError

                    raise BufferOverflowError(f"{n} elements go back through a buffer of {o.capacity}")
                case OverflowPolicy.DROP_NEWEST:
                    rest = rest.orderBy(SEQ).limit(o.capacity)
                case OverflowPolicy.DROP_OLDEST:
                    rest = rest.orderBy(F.desc(SEQ)).limit(o.capacity)
                case OverflowPolicy.DROP_BUFFER:  # the element that finds it full empties it
                    kept = (n - 1) % o.capacity + 1
                    rest = rest.orderBy(F.desc(SEQ)).limit(kept)
        if not n:
            return made.with_df(done, order=("__df_turn", SEQ), dense=False)
        turn += 1
        if turn > b["most"]:
            from tidemill.errors import DataflowError

            raise DataflowError(f"elements still go back after {b['most']} rounds")
        now = made.with_df(rest, order=(SEQ,), dense=False)


# G: scopes


@stage("durable")
def durable(ctx: Context, s: Stream, b: dict) -> Stream:
    return apply(ctx, s, b["steps"])


@stage("supervised")
def supervised(ctx: Context, s: Stream, b: dict) -> Stream:
    """A scope whose first stage fails by a column condition has a closed form; any other runs element by element."""
    o, steps = b["options"], b["steps"]
    fails = steps and steps[0][0] == "fault-point" and not isinstance(steps[0][1]["fn"], Py)
    if not fails:
        steps = python_steps(steps)
        return sequential(ctx, s, lambda: Supervised(steps, o, b.get("fallback")), b.get("schema") or ddl(s))
    bad = F.coalesce(column(steps[0][1]["fn"]), F.lit(False)) & s.ok()
    form = o.form
    ctx.count("supervised", s.df.where(bad))
    if form == SupervisionForm.RETRY:  # a condition on the element fails every time
        form = {RetryExhaustion.FAIL: None, RetryExhaustion.RESUME: SupervisionForm.RESUME, RetryExhaustion.RESTART_STAGE: SupervisionForm.RESTART_STAGE}[o.on_exhaustion]
        if form is None:
            return apply(ctx, ctx.fail_at(s, bad, "DataflowError", F.lit("fault point")), steps[1:])
    if form == SupervisionForm.RESUME:
        return apply(ctx, s.with_df(s.df.where(~bad), dense=False), steps[1:])
    if form == SupervisionForm.RESTART_STAGE:
        s = s if s.order == (SEQ,) else ctx.dense(s)
        r = ctx.running(s, {"__df_epoch": ("sum", bad.cast("long"), True)})
        r = r.with_df(r.df.where(~bad), dense=False, part=(*s.part, "__df_epoch"))
        out = apply(ctx, r, steps[1:])
        return out.with_df(out.df.drop("__df_epoch"), part=s.part, dense=False)
    s = s if s.order == (SEQ,) else ctx.dense(s)
    end = first_where(s, bad)
    out = apply(ctx, s.with_df(s.df.where(F.coalesce(s.key() < end, F.lit(True)))), [x for x in steps[1:]])
    if out.order == (SEQ, TIE):  # what a batch still holds is abandoned with the scope
        out = out.with_df(out.df.where((F.col(SEQ) < LAST) | end.isNull()))
    types = {f.name: f.dataType for f in out.df.schema}
    fallback = b["fallback"] if isinstance(b["fallback"], dict) else {"value": b["fallback"]}
    line = s.df.where(bad).agg(F.min(SEQ).alias(SEQ)).where(F.col(SEQ).isNotNull())
    line = line.select(*[F.lit(fallback.get(c)).cast(types[c]).alias(c) for c in out.columns], SEQ)
    df = out.df.unionByName(line, allowMissingColumns=True)
    return out.with_df(df.fillna({TIE: 0}) if TIE in df.columns else df, dense=False)


# H: junctions


def legs_of(ctx: Context, s: Stream, kind: str, b: dict) -> list[Stream]:
    n = b["legs"]
    if kind == "broadcast":
        return [s] * n
    if kind == "balance":
        s = ctx.dense(s)
        return [where(s, F.pmod(F.col(SEQ), F.lit(n)) == i) for i in range(n)]
    if kind == "partition":
        s = s.with_df(s.df.withColumn("__df_leg", column(b["fn"]).cast("int")))
        bad = F.col("__df_leg").isNull() | ~F.col("__df_leg").between(0, n - 1)
        s = ctx.fail_at(s, bad, "RouteOutOfRangeError", F.concat(F.lit("no leg "), F.coalesce(F.col("__df_leg").cast("string"), F.lit("null"))))
        outs = [where(s, F.col("__df_leg") == i) for i in range(n)]
        return [o.with_df(o.df.drop("__df_leg")) for o in outs]
    if kind == "unzip":
        outs = []
        for side in b.get("sides", ("first", "second")):
            kind_ = dict(s.df.dtypes)[side]
            outs.append(s.with_df(s.df.select(*([f"{side}.*"] if kind_.startswith("struct<") else [F.col(side).alias("value")]), *s.internal)))
        return outs
    raise ValueError(kind)


def numbered(s: Stream, i: int, ctx: Context) -> DataFrame:
    return ctx.dense(s).df.withColumn("__df_in", F.lit(i))


def joined_streams(ctx: Context, kind: str, ins: list[Stream], b: dict) -> Stream:
    if kind in ("merge", "concat", "interleave"):
        timed, err = all(x.timed for x in ins), any(x.err for x in ins)
        dfs = [numbered(x, i, ctx) for i, x in enumerate(ins)]
        df = dfs[0]
        for d in dfs[1:]:
            df = df.unionByName(d, allowMissingColumns=True)
        if kind == "interleave":
            k = b["size"]
            df = df.withColumns({"__df_turn": F.expr(f"{SEQ} div {k}"), TIE: F.pmod(F.col(SEQ), F.lit(k))})
            return Stream(df, ("__df_turn", "__df_in", TIE), timed=timed, err=err)
        if kind == "merge":  # any order across inputs is right; by time where there is one
            return Stream(df, (TS, "__df_in", SEQ) if timed else (SEQ, "__df_in"), timed=timed, err=err)
        return Stream(df, ("__df_in", SEQ), timed=timed, err=err)
    left, right = ins
    if kind == "zip":
        a, c = ctx.dense(left), ctx.dense(right)
        side = lambda s: (F.col("value") if s.columns == ["value"] else element(s))
        x = a.df.select(SEQ, side(a).alias("first"), *([TS] if a.timed else []), *([F.col(ERR)] if a.err else []))
        y = c.df.select(SEQ, side(c).alias("second"), *([F.col(TS).alias("__df_ts2")] if c.timed else []), *([F.col(ERR).alias("__df_err2")] if c.err else []))
        df = x.join(y, SEQ)
        timed, err = a.timed and c.timed, a.err or c.err
        if timed:
            df = df.withColumn(TS, F.greatest(TS, "__df_ts2"))
        if err:
            df = df.withColumn(ERR, F.coalesce(*[F.col(n) for n in (ERR, "__df_err2") if n in df.columns]))
        out = Stream(df.drop("__df_ts2", "__df_err2", *([] if timed else [TS])), (SEQ,), dense=True, timed=timed, err=err)
    else:
        need_time(left), need_time(right)
        side = lambda s: (F.col("value") if s.columns == ["value"] else element(s))
        a, c = ctx.dense(left), ctx.dense(right)
        x = a.df.select(F.struct(side(a).alias("v")).alias("__df_l"), F.lit(0).alias("__df_in"), SEQ, TS)
        y = c.df.select(F.struct(side(c).alias("v")).alias("__df_r"), F.lit(1).alias("__df_in"), SEQ, TS)
        both = x.unionByName(y, allowMissingColumns=True)
        w = Window.orderBy(TS, "__df_in", SEQ).rowsBetween(Window.unboundedPreceding, 0)
        df = latest_of_both(ctx, both, w)
        df = df.where("__df_l IS NOT NULL AND __df_r IS NOT NULL")
        df = df.select(F.col("__df_l.v").alias("first"), F.col("__df_r.v").alias("second"), TS, "__df_in", SEQ)
        out = Stream(df, (TS, "__df_in", SEQ), timed=True)
    if b.get("combine") is not None:
        out = select(ctx, out, {"fn": b["combine"]})
    return out


def latest_of_both(ctx: Context, both: DataFrame, w) -> DataFrame:
    """The last value of each side up to each row. On a large stream, last within blocks and then the block's carry."""
    s = Stream(both, (TS, "__df_in", SEQ), timed=True)
    if not ctx.large(s):
        return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("__df_l", "__df_r")})
    named = both.withColumnsRenamed({SEQ: "__keep_seq", "__df_in": "__keep_in", "__df_l": "__keep_l", "__df_r": "__keep_r"})
    d = ctx.dense(Stream(named.withColumns({"__df_in": F.col("__keep_in"), SEQ: F.col("__keep_seq")}), (TS, "__df_in", SEQ), timed=True)).df
    d = d.withColumn("__df_block", F.expr(f"{SEQ} div {ctx.block}"))
    inner = Window.partitionBy("__df_block").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    last = d.groupBy("__df_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(SEQ))).alias(f"{c}2") for c in ("__keep_l", "__keep_r")])
    over = Window.orderBy("__df_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("__df_block", *[F.last(f"{c}2", ignorenulls=True).over(over).alias(f"{c}3") for c in ("__keep_l", "__keep_r")])
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(inner) for c in ("__keep_l", "__keep_r")}).join(carry, "__df_block")
    return d.select(F.coalesce("__keep_l", "__keep_l3").alias("__df_l"), F.coalesce("__keep_r", "__keep_r3").alias("__df_r"), TS, F.col("__keep_in").alias("__df_in"), F.col("__keep_seq").alias(SEQ))


def cycle_take(ctx: Context, s: Stream, n: int) -> Stream:
    """The first n elements of an endless repetition: positions modulo the number of elements."""
    s = ctx.dense(s)
    size = s.df.count()
    if not size:
        raise UnboundedSourceError("a repetition of nothing does not come to its end")
    s = replace(s, endless=False)
    at = ctx.spark.range(n).select(F.col("id").alias("__df_at"), (F.col("id") % size).alias(SEQ))
    df = at.join(s.df, SEQ).drop(SEQ).withColumnRenamed("__df_at", SEQ)
    return s.with_df(df, order=(SEQ,), dense=True)


def pairs_of(items: list) -> Iterator:
    return itertools.pairwise(items)
