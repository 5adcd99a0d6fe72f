"""Stages applied one element at a time, for scopes and substreams whose state depends on what happened before."""

from __future__ import annotations

import asyncio
import copy
import inspect
import json
import time
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import TrackedKeyOverflowError
from tidemill.options import ActiveKeyOverflowPolicy, KeyOverflowPolicy, RetryExhaustion, SupervisionForm

from .order import ERR, SEQ, TIE, Context, Stream, checkpoint_folder, checkpointed

STATS, STATE = "__df_stats", "__df_state"
#: Bytes of a state that is handed from one stretch of a large stream to the next.
MOST_STATE = 64 << 20

#: A group or scope admits these stages.
ADMITTED = ("select", "where", "scan", "take", "skip", "take-while", "take-through", "skip-while", "distinct", "deduplicate-consecutive", "grouped", "sliding", "fault-point")


def hashable(x: Any) -> Any:
    if isinstance(x, dict):
        return tuple((k, hashable(v)) for k, v in x.items())
    return tuple(map(hashable, x)) if isinstance(x, (list, tuple)) else x


class Chain:
    """A fresh instance of a flow's stages. offer() gives the elements that come out; ended tells that the chain takes no more."""

    def __init__(self, steps: list[tuple[str, dict]]):
        self.steps = steps
        self.loop: asyncio.AbstractEventLoop | None = None
        self.reset()

    def _now(self, x: Any) -> Any:
        """The result of a step, waited for if it has to be awaited: the next element needs it."""
        if not inspect.isawaitable(x):
            return x
        if self.loop is None:
            self.loop = asyncio.new_event_loop()
        return self.loop.run_until_complete(x)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"loop": None}  # a loop belongs to its worker

    def offer_all(self, xs: list[Any]) -> tuple[list[list[Any]], Exception | None]:
        """offer() of each element up to the first that fails. A scan alone awaits its steps in one go of the loop: to enter
        it for each element costs more than most steps."""
        outs: list[list[Any]] = []
        try:
            if len(self.steps) > 1 or self.steps[0][0] != "scan":
                for x in xs:
                    if self.ended:
                        break
                    outs.append(self.offer(x))
                return outs, None
            step, s = self.steps[0][1]["fold"].step, self.state[0]
            for x in xs:
                y = step(s["value"], x)
                if inspect.isawaitable(y):
                    break
                s["value"] = y
                outs.append(self._given(y))
            else:
                return outs, None

            async def rest(y: Any) -> None:
                for x in xs[len(outs) + 1 :]:
                    s["value"] = await y if inspect.isawaitable(y) else y
                    outs.append(self._given(s["value"]))
                    y = step(s["value"], x)
                s["value"] = await y if inspect.isawaitable(y) else y
                outs.append(self._given(s["value"]))

            self._now(rest(y))
        except Exception as e:
            return outs, e
        return outs, None

    def _given(self, state: Any) -> list[Any]:
        """What a scan gives at each state."""
        return [{"value": state}]

    def reset(self) -> None:
        self.state: list[dict] = [{"n": 0, "open": [], "keys": OrderedDict(), "value": copy.deepcopy(b["fold"].seed) if kind == "scan" else None} for kind, b in self.steps]
        self.ended = False

    def offer(self, x: Any, at: int = 0) -> list[Any]:
        now = [x]
        for i in range(at, len(self.steps)):
            after: list[Any] = []
            for y in now:
                out, more = self._stage(i, y)
                after += out
                if not more:
                    self.ended = True
                    after += self._flush_above(i)
                    break
            now = after
            if not now:
                break
        return now

    def _flush_above(self, i: int) -> list[Any]:
        """What stages before the one that ended were holding is refused by it."""
        return []

    def _stage(self, i: int, x: Any) -> tuple[list[Any], bool]:
        kind, b = self.steps[i]
        s = self.state[i]
        s["n"] += 1
        match kind:
            case "select":
                return [b["py"](x)], True
            case "where":
                return ([x] if b["py"](x) else []), True
            case "fault-point":
                if b["py"](x, s["n"]):
                    raise RuntimeError("fault point")
                return [x], True
            case "scan":
                s["value"] = self._now(b["fold"].step(s["value"], x))
                return [{"value": s["value"]}], True
            case "take":
                return ([x] if s["n"] <= b["n"] else []), s["n"] < b["n"]
            case "skip":
                return ([x] if s["n"] > b["n"] else []), True
            case "take-while":
                ok = bool(b["py"](x))
                return ([x] if ok else []), ok
            case "take-through":
                return [x], bool(b["py"](x))
            case "skip-while":
                s["value"] = s["value"] or not b["py"](x)
                return ([x] if s["value"] else []), True
            case "distinct":
                k = hashable(x)
                if k in s["keys"]:
                    return [], True
                if len(s["keys"]) >= b["options"].max_tracked_keys:
                    if b["options"].overflow_policy == KeyOverflowPolicy.FAIL:
                        raise TrackedKeyOverflowError(f"more than {b['options'].max_tracked_keys} keys")
                    s["keys"].popitem(last=False)
                s["keys"][k] = True
                return [x], True
            case "deduplicate-consecutive":
                same = s["n"] > 1 and s["value"] == x
                s["value"] = x
                return ([] if same else [x]), True
            case "grouped":
                s["open"].append(x)
                if len(s["open"]) < b["size"]:
                    return [], True
                out, s["open"] = {"value": s["open"]}, []
                return [out], True
            case "sliding":
                # open: what belongs to the next window; skip: elements still before it; fresh: some element no window carried
                if s.get("skip", 0) > 0:
                    s["skip"] -= 1
                    return [], True
                s["open"].append(x)
                s["fresh"] = True
                if len(s["open"]) < b["size"]:
                    return [], True
                out = {"value": list(s["open"])}
                s["skip"] = max(0, b["step"] - b["size"])
                s["open"] = s["open"][b["step"] :]
                s["fresh"] = False
                return [out], True
        raise ValueError(f"{kind} is not admitted here")

    def flush(self) -> list[Any]:
        """At the end of the stream: what batches still hold, through the stages below them."""
        out: list[Any] = []
        if self.ended:
            return out
        for i, (kind, _) in enumerate(self.steps):
            s = self.state[i]
            held = s["open"] and (kind == "grouped" or kind == "sliding" and s.get("fresh"))
            if held:
                rest, s["open"] = {"value": s["open"]}, []
                out += self.offer(rest, i + 1)
        return out


class Last(Chain):
    """A fold: its state at the end alone."""

    def __init__(self, fold):
        super().__init__([("scan", {"fold": fold})])

    def _given(self, state: Any) -> list[Any]:
        return []

    def flush(self) -> list[Any]:
        return [{"value": self.state[0]["value"]}]


class Supervised:
    """A scope: its chain under a declared answer to failures."""

    def __init__(self, steps: list[tuple[str, dict]], options, fallback: Any = None):
        self.chain, self.options, self.fallback = Chain(steps), options, fallback
        self.counts = {"supervised": 0, "poison": 0}

    @property
    def ended(self) -> bool:
        return self.chain.ended

    def offer(self, x: Any) -> list[Any]:
        o = self.options
        tries = o.max_attempts if o.form == SupervisionForm.RETRY else 1
        for attempt in range(1, tries + 1):
            try:
                return self.chain.offer(x)
            except Exception:
                self.counts["supervised"] += 1
                if o.form == SupervisionForm.RECOVER:
                    self.chain.ended = True
                    return [self.fallback]
                if attempt < tries:
                    if o.backoff_micros:
                        time.sleep(o.backoff_micros[min(attempt, len(o.backoff_micros)) - 1] / 1e6)
                    continue
                answer = o.form
                if o.form == SupervisionForm.RETRY:
                    self.counts["poison"] += 1
                    answer = o.on_exhaustion
                    if answer == RetryExhaustion.FAIL:
                        raise
                if answer in (SupervisionForm.RESTART_STAGE, RetryExhaustion.RESTART_STAGE):
                    self.chain.reset()
        return []

    def flush(self) -> list[Any]:
        return self.chain.flush()


class Substreams:
    """A chain for each key, within a bound of keys; the least recently used is flushed and forgotten, if so declared."""

    ended = False

    def __init__(self, key, steps: list[tuple[str, dict]], options):
        self.key, self.steps, self.options = key, steps, options
        self.counts = {"evicted": 0}
        self.live: OrderedDict[Any, Chain] = OrderedDict()  # by last use
        self.opened: OrderedDict[int, Chain] = OrderedDict()  # by opening

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.opened = OrderedDict((id(c), c) for c in self.opened.values())

    def offer(self, x: Any) -> list[Any]:
        k = hashable(self.key(x))
        out: list[Any] = []
        if k not in self.live:
            if len(self.live) >= self.options.max_active_keys:
                if self.options.overflow_policy == ActiveKeyOverflowPolicy.FAIL:
                    raise TrackedKeyOverflowError(f"key {k!r} is one more than {self.options.max_active_keys}")
                _, old = self.live.popitem(last=False)
                self.counts["evicted"] += 1
                del self.opened[id(old)]
                out += old.flush()
            self.live[k] = Chain(self.steps)
            self.opened[id(self.live[k])] = self.live[k]
        self.live.move_to_end(k)
        chain = self.live[k]
        return out if chain.ended else out + chain.offer(x)

    def flush(self) -> list[Any]:
        return [y for c in self.opened.values() for y in c.flush()]


def offered(machine, xs: list) -> tuple[list[list], Exception | None]:
    """What comes out for each element, up to the end of the machine or the first that fails."""
    if hasattr(machine, "offer_all"):
        return machine.offer_all(xs)
    outs: list[list] = []
    try:
        for x in xs:
            if machine.ended:
                break
            outs.append(machine.offer(x))
    except Exception as e:
        return outs, e
    return outs, None


def sequential(ctx: Context, s: Stream, make, schema: str) -> Stream:
    """Run make() (an object with offer, flush and ended) over the elements in order, one task for each part.

    Rows reach the worker sorted and in batches; only the object's own state is held. A large stream that is one part goes
    in stretches, a task after the other, each with the state that the one before left. schema: the columns of what comes
    out; each is ordered by the element that set it free, and what the end sets free comes last."""
    s = ctx.dense(s)
    names = s.columns
    fields = T._parse_datatype_string(schema)
    if not isinstance(fields, T.StructType):
        fields = T.StructType([T.StructField("value", fields)])
    outs = [f.name for f in fields]
    part = list(s.part)
    kept = [f for f in s.df.schema if f.name in part]
    full = T.StructType([*fields, *kept, T.StructField(SEQ, T.LongType()), T.StructField(TIE, T.LongType()), T.StructField(ERR, T.StringType())])
    counting = ctx.counted is not None
    if counting:  # a machine's counts are a row of their own
        full = full.add(STATS, T.StringType())
    err = s.err

    def run(batches, state: bytes | None = None, last: bool = True, stretch: bool = False) -> Iterator:
        import pandas as pd
        from pyspark import cloudpickle

        from .order import LAST

        machine, key, failed, since = None, None, False, 0
        if state is not None:
            machine, key = cloudpickle.loads(state), ()
        rows: list[tuple] = []

        def row(values: tuple, at: int, tie: int, error: str | None, stats: str | None = None) -> None:
            rows.append((*values, *(key or ()), at, tie, error, *((stats,) if counting else ()), *((None,) if stretch else ())))

        def put(found: list, at: int, tie: int = 0) -> None:
            for i, y in enumerate(found, tie):
                y = y if isinstance(y, dict) else {"value": y}
                row(tuple(y.get(n) for n in outs), at, i, None)

        def fail(e: Exception, at: int) -> None:
            row((None,) * len(outs), at, 0, f"{type(e).__name__}: {e}")

        def end() -> None:
            if machine is not None and not failed:
                try:
                    put(machine.flush(), LAST, since << 20 if part else 0)  # keys are flushed in the order they opened
                except Exception as e:
                    fail(e, LAST)
            if machine is not None and counting and getattr(machine, "counts", None):
                row((None,) * len(outs), LAST, 0, None, json.dumps(machine.counts))

        def hand_on() -> None:
            """The state as a row of its own; empty where it can't be handed on."""
            machine_ = make() if machine is None else machine
            try:
                left = cloudpickle.dumps(machine_)
            except Exception:
                left = b""
            rows.append((*(None,) * len(outs), -1, 0, None, *((None,) if counting else ()), left if len(left) <= MOST_STATE else b""))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame.from_records(rows, columns=[*(f.name for f in full), *([STATE] if stretch else [])]).astype({SEQ: "int64", TIE: "int64"})
            rows.clear()
            return out

        for pdf in batches:
            records = pdf.astype(object).where(pdf.notna(), None)
            parts = list(zip(*(records[c] for c in part), strict=True)) if part else [()] * len(records)
            errs = records[ERR] if err else [None] * len(records)
            values, ats = list(records[names].itertuples(index=False, name=None)), records[SEQ].tolist()
            errs, i = list(errs), 0
            while i < len(ats):
                if machine is None or parts[i] != key:
                    end()
                    machine, key, failed, since = make(), parts[i], False, ats[i]
                j = i + 1  # elements of one part up to its next failure are offered together
                while errs[i] is None and j < len(ats) and errs[j] is None and parts[j] == key:
                    j += 1
                if not failed and not machine.ended:
                    if errs[i] is not None:
                        row((None,) * len(outs), ats[i], 0, errs[i])
                        failed = True
                    else:
                        found, x = offered(machine, [dict(zip(names, v, strict=True)) for v in values[i:j]])
                        for at, ys in zip(ats[i:j], found, strict=False):
                            put(ys, at)
                        if x is not None:
                            fail(x, ats[i + len(found)])
                            failed = True
                i = j
            if len(rows) > 1000:
                yield frame()
        if last or failed or machine is not None and machine.ended:
            end()
        else:
            hand_on()
        if rows:
            yield frame()

    df: DataFrame | None = None if part or not ctx.large(s) else in_stretches(ctx, s, run, full)
    if df is None:
        dealt = s.df.repartition(*part) if part else s.df.repartition(1)
        df = dealt.sortWithinPartitions(*part, SEQ).mapInPandas(run, full)
    if counting:
        df = checkpointed(df)
        for r in df.where(F.col(STATS).isNotNull()).groupBy(STATS).agg(F.count(F.lit(1)).alias("n")).collect():
            for name, n in json.loads(r[STATS]).items():
                ctx.counted[name] += n * r["n"]
        df = df.where(F.col(STATS).isNull()).drop(STATS)
    return s.with_df(df, order=(SEQ, TIE), dense=False, timed=False, err=True)


def in_stretches(ctx: Context, s: Stream, run, full: T.StructType) -> DataFrame | None:
    """run() over each block of positions, in order; None if a state can't be handed on."""
    path, out = checkpoint_folder(ctx.spark, "blocks"), checkpoint_folder(ctx.spark, "stretches")
    s.df.withColumn("__df_block", F.expr(f"{SEQ} div {ctx.block}")).write.partitionBy("__df_block").parquet(path)
    schema = T.StructType([*s.df.schema, T.StructField("__df_block", T.LongType())])
    rows = ctx.spark.read.schema(schema).parquet(path)
    n = rows.agg(F.max("__df_block")).first()[0]
    if not n:
        return None
    made = T.StructType([*full, T.StructField(STATE, T.BinaryType())])
    state, done = None, []
    for i in range(n + 1):
        block = rows.where(F.col("__df_block") == i).drop("__df_block").repartition(1).sortWithinPartitions(SEQ)
        done.append(f"{out}/{i}")
        block.mapInPandas(lambda batches, state=state, last=i == n: run(batches, state, last, True), made).write.parquet(done[-1])
        left = ctx.spark.read.schema(made).parquet(done[-1]).where(F.col(SEQ) == -1).select(STATE).collect()
        if not left:  # the end, a failure, or a machine that takes no more
            break
        state = bytes(left[0][0])
        if not state:
            return None
    return ctx.spark.read.schema(made).parquet(*done).where(F.col(STATE).isNull()).drop(STATE)
