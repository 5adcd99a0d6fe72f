"""Runs graphs: validates the document, lowers it to DataFrames and settles the terminals."""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CollectOverflowError, EmptyStreamError, PipelineRejectedError, UnboundedSourceError, raise_coded
from .functions import Fold, column
from .operators import lower
from .operators.interpreter import sequential
from .operators.order import ERR, RESERVED, SEQ, TS, Context, Stream
from .plans import vocabulary
from .plans.registry import Registry
from .plans.validate import validate
from .stream import Graph, Node, Source


@dataclass
class Run:
    """A finished run: its slots' values and counters."""

    fingerprint: str
    values: dict[str, Any] = field(default_factory=dict)
    status: str = "running"
    counts: Counter = field(default_factory=Counter)
    error: str | None = None

    @property
    def snapshot(self) -> dict:
        """How the run stands, and what its stages did to elements beside passing them on, if the engine counts: dropped by
        buffers and queues, failures that scopes answered (supervised), given up after retries (poison), keys evicted."""
        return {"status": self.status, "error": self.error, "results": len(self.values), **{k: self.counts[k] for k in ("dropped", "supervised", "poison", "evicted")}}

    def value(self, slot: str) -> Any:
        return self.values[slot]


class Engine:
    """large: None decides by estimated size whether positions are found on one task or by ranges over many. counters: runs
    count what their stages drop, supervise and evict, for which element-by-element stages are stored once."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None, large: bool | None = None, block: int | None = None, counters: bool = False):
        self.counters = counters
        self.last: Run | None = None
        self.spark, self.registry = spark, registry
        self.cached: list[DataFrame] = []  # of the run that goes on
        self.ctx = Context(spark, large, *([block] if block else []))
        self.catalog = vocabulary.local_catalog()
        if registry:
            for s in registry.catalog.specs.values():
                self.catalog.add(s)

    # lowering
    def stream(self, source: Source) -> Stream:
        return self._lower(source.node, source.port, {}, {})

    def frame(self, source: Source, position: str | None = None, time: str | None = None) -> DataFrame:
        """The elements as a DataFrame, with their positions and times under these names if asked for."""
        s = self.stream(source)
        if s.endless:
            raise UnboundedSourceError("a cycle needs a take")
        if position:
            s = self.ctx.dense(s)
        extra = ([F.col(SEQ).alias(position)] if position else []) + ([F.col(TS).alias(time)] if time else [])
        df = s.df
        if s.err:  # a failure that reaches the end fails the run
            df = df.withColumn("__df_raise", F.when(F.col(ERR).isNotNull(), F.raise_error(F.col(ERR)).cast("boolean"))).where("__df_raise IS NULL")
        return df.select(*s.columns, *extra)

    def _uses(self, nodes: list[Node]) -> dict[int, int]:
        count: dict[int, int] = {}
        for n in nodes:
            for m, _ in n.inputs:
                count[id(m)] = count.get(id(m), 0) + 1
        return count

    def _lower(self, node: Node, port: str, done: dict[int, Any], uses: dict[int, int]) -> Stream:
        if id(node) not in done:
            done[id(node)] = self._make(node, done, uses)
        made = done[id(node)]
        return made[int(port.rpartition("-")[2]) - 1] if isinstance(made, list) else made

    def _make(self, node: Node, done: dict, uses: dict) -> Any:
        ins = [self._lower(m, p, done, uses) for m, p in node.inputs]
        if not ins:
            s = self._source(node)
            return s.with_df(s.df, endless=True) if node.kind == "cycle" else s
        if any(s.endless for s in ins) and node.kind in (*vocabulary.FAN_OUT, *vocabulary.FAN_IN):
            raise UnboundedSourceError("a cycle needs a take before a junction")
        if node.kind in vocabulary.FAN_OUT:
            s = ins[0]
            if uses.get(id(node), 0) > 1 and self._costly(node.inputs[0][0]):
                s = s.with_df(s.df.persist())
                self.cached.append(s.df)
            return lower.legs_of(self.ctx, s, node.kind, node.bind)
        if node.kind in vocabulary.FAN_IN:
            return lower.joined_streams(self.ctx, node.kind, ins, node.bind)
        parent = node.inputs[0][0]
        if ins[0].endless and node.kind not in lower.STATELESS:
            if node.kind != "take":
                raise UnboundedSourceError("a cycle needs a take before stages that carry state")
            return lower.cycle_take(self.ctx, ins[0], node.bind["n"]) if node.bind["n"] else ins[0].with_df(ins[0].df.limit(0), endless=False)
        if parent.kind in ("unfold", "unfold-async") and node.kind == "take":
            return ins[0].with_df(parent.bind["frame"](self.spark, node.bind["n"]))
        return lower.LOWER[node.kind](self.ctx, ins[0], node.bind)

    @staticmethod
    def _costly(node: Node) -> bool:
        """A leg can read a plain source again for less than storing it."""
        return bool(node.inputs)

    def _source(self, node: Node) -> Stream:
        return self.placed(node, node.bind["frame"](self.spark))

    def placed(self, node: Node, df: DataFrame) -> Stream:
        """The rows of a source, in its order."""
        b = node.bind
        dense, time = b.get("dense"), b.get("time")
        if time:
            stamp = F.col(time)
            if dict(df.dtypes)[time].startswith("timestamp"):
                stamp = F.unix_micros(stamp.cast("timestamp"))
            df = df.withColumn(TS, stamp.cast("long"))
        timed = bool(time) or b.get("timed", False)
        if dense:
            return Stream(df.withColumnRenamed(dense, SEQ) if dense != SEQ else df, (SEQ,), True, timed=timed)
        order = []
        for i, c in enumerate(b["order"]):
            if isinstance(c, str) and c.startswith(RESERVED):
                df = df.withColumnRenamed(c, f"__df_o{i}")
            else:
                df = df.withColumn(f"__df_o{i}", column(c))
            order.append(f"__df_o{i}")
        return Stream(df, tuple(order), timed=timed, err=b.get("err", False))

    # running
    def check(self, graph: Graph) -> None:
        found = validate(graph.document, self.catalog)
        if found:
            raise PipelineRejectedError("; ".join(f"{d.rule} at {d.subject}: {d.message}" for d in found))

    def run(self, graph: Graph) -> Run:
        """Each call is a new run. All terminals share what they have in common."""
        document = graph.document
        self.check(graph)
        run = self.last = Run(document.fingerprint)
        self.ctx.counted = run.counts if self.counters else None
        self.cached = []
        done: dict[int, Any] = {}
        uses = self._uses(graph.nodes())
        try:
            for t in graph.terminals:
                s = self._lower(*t.inputs[0], done, uses)
                if s.endless:
                    raise UnboundedSourceError("a cycle needs a take")
                value = self._settle(t, s)
                if t.slot:
                    run.values[t.slot] = value
            run.status = "completed"
        except Exception as e:
            run.status, run.error = "failed", type(e).__name__
            raise
        finally:
            self.ctx.counted = None
            for n in graph.nodes():
                if n.kind == "queue":
                    run.counts["dropped"] += n.bind["queue"].dropped
            for df in self.cached:
                df.unpersist()
        return run

    @staticmethod
    def _fail(s: Stream) -> None:
        """The first failure that reached the end."""
        if s.err:
            found = s.df.where(F.col(ERR).isNotNull()).orderBy(*s.order).select(ERR).head(1)
            if found:
                raise_coded(found[0][0])

    @staticmethod
    def _plain(s: Stream, row) -> Any:
        d = row.asDict()
        return d["value"] if s.columns == ["value"] else d

    def _settle(self, t: Node, s: Stream) -> Any:
        ok = s.df.where(s.ok())
        rows = ok.select(*s.columns)
        match t.kind:
            case "ignore":
                if s.err:
                    self._fail(s)
                rows.write.format("noop").mode("overwrite").save()
            case "registered-sink":
                self._fail(s)
                t.bind["write"](rows, t.bind["params"])
            case "registered-terminal":
                self._fail(s)
                return t.bind["finish"](rows, t.bind["params"])
            case "for-each":
                self._fail(s)
                for r in ok.orderBy(*s.order).select(*s.columns).toLocalIterator():
                    t.bind["fn"](self._plain(s, r))
            case "for-each-async":
                self._fail(s)
                fn, n, scalar = t.bind["fn"], t.bind["options"].max_concurrency, s.columns == ["value"]

                def each(part):
                    for _ in lower.called(fn, [r["value"] if scalar else r.asDict() for r in part], n, True):
                        pass

                def each_slice(part):
                    while some := list(itertools.islice(part, 1024)):
                        each(some)

                rows.foreachPartition(each_slice)
            case "to-channel":
                self._fail(s)
                for r in ok.orderBy(*s.order).select(*s.columns).toLocalIterator():
                    t.bind["channel"].put(self._plain(s, r))
            case "count":
                return self._aggregate(s, F.count(F.when(s.ok(), 1)))
            case "first" | "first-or-default":
                found = s.df.orderBy(*s.order).limit(1).select(*s.columns, *([ERR] if s.err else [])).collect()
                if found and s.err and found[0][ERR]:
                    raise_coded(found[0][ERR])
                return self._one(t, s, found)
            case "last" | "last-or-default":
                self._fail(s)
                return self._one(t, s, ok.orderBy(*[F.desc(c) for c in s.order]).limit(1).select(*s.columns).collect())
            case "collect":
                most = t.bind["options"].max_elements
                quick = self._collect_unsorted(s, most)
                if quick is not None:
                    return quick
                found = s.df.orderBy(*s.order).limit(most + 1).select(*s.columns, *([ERR] if s.err else [])).collect()
                for i, r in enumerate(found):
                    if s.err and r[ERR]:
                        raise_coded(r[ERR])
                    if i == most:
                        raise CollectOverflowError(f"more than {most} elements")
                return [self._plain(s, r) if not s.err else self._without_err(s, r) for r in found]
            case "fold" | "fold-async":
                if t.bind["fold"].kind in ("python", "last"):
                    self._fail(s)
                    return self._fold(t.bind["fold"], s.with_df(ok, err=False) if not s.err else s.with_df(ok.drop(ERR), err=False))
                return self._total(t.bind["fold"], s)
        return None

    def _without_err(self, s: Stream, r) -> Any:
        d = r.asDict()
        d.pop(ERR)
        return d["value"] if s.columns == ["value"] else d

    def _one(self, t: Node, s: Stream, found: list) -> Any:
        if found:
            return self._without_err(s, found[0]) if s.err and ERR in found[0] else self._plain(s, found[0])
        if t.kind in ("first", "last"):
            raise EmptyStreamError(f"{t.kind} of an empty stream")
        if t.bind["default"] is not None:
            return t.bind["default"]
        return default_of(s)

    def _fold(self, f: Fold, s: Stream) -> Any:
        if f.kind == "python":
            from .operators.interpreter import Last

            out = sequential(self.ctx, s, lambda: Last(f), f"value {f.schema}")
            last = out.df.select("value", ERR).collect()  # one row: the last state, or the failure
            if last and last[0][1]:
                raise_coded(last[0][1])
            return last[0][0] if last else f.seed
        if f.kind == "last":
            found = s.df.orderBy(*[F.desc(c) for c in s.order]).limit(1).select(column(f.value)).collect()
            return found[0][0] if found else f.seed
        raise ValueError(f.kind)

    def _aggregate(self, s: Stream, agg) -> Any:
        """An aggregate of all elements in one pass, which also finds the first failure."""
        if not s.err:
            return s.df.agg(agg).first()[0]
        first = F.min_by(F.when(~s.ok(), F.col(ERR)), F.when(~s.ok(), s.key()))
        value, failed = s.df.agg(agg.alias("v"), first.alias("e")).first()
        if failed:
            raise_coded(failed)
        return value

    def _total(self, f: Fold, s: Stream) -> Any:
        of = F.lit(1) if f.kind == "count" else column(f.value)
        value = self._aggregate(s, {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[f.kind](F.when(s.ok(), of)))
        if value is None:
            return f.seed
        return value + f.seed if f.kind in ("sum", "count") else value

    def _collect_unsorted(self, s: Stream, most: int) -> list | None:
        """All elements, put in order on the driver; None where there are more than may be collected, or a failure, or types
        that Arrow and Python don't share."""
        plain = ("int", "bigint", "double", "string", "boolean")
        types = dict(s.df.dtypes)
        if s.err or any(types[c] not in plain for c in s.columns) or any(types[c] not in ("int", "bigint", "string") for c in s.order) or s.df.limit(most + 1).count() > most:
            return None
        t = s.df.select(*s.columns, *[F.col(c).alias(f"{RESERVED}k{i}") for i, c in enumerate(s.order)]).toArrow()
        keys = [(f"{RESERVED}k{i}", "ascending") for i in range(len(s.order))]
        t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_start"))
        return t.column("value").to_pylist() if s.columns == ["value"] else t.select(s.columns).to_pylist()


def default_of(s: Stream) -> Any:
    """What an empty stream of scalars gives by its type: 0, False, or None."""
    if s.columns != ["value"]:
        return None
    kind = dict(s.df.dtypes)["value"]
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return 0
    if kind in ("double", "float"):
        return 0.0
    return False if kind == "boolean" else None
