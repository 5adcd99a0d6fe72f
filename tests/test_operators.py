"""Single stages on short sequences, with positions found on one task and by ranges over many."""

import pytest

from tidemill import functions as fn
from tidemill import sources as S
from tidemill.engine import Engine
from tidemill.errors import BufferOverflowError, CollectOverflowError, DataflowError, EmptyStreamError, RateLimitExceededError, RouteOutOfRangeError, SourceFailedError, StreamTimeoutError, TrackedKeyOverflowError, UnboundedSourceError
from tidemill.options import ActiveKeyOverflowPolicy, BufferOptions, CollectOptions, DistinctOptions, GroupByOptions, KeyOverflowPolicy, OverflowPolicy, ParallelismOptions, RetryExhaustion, SupervisionForm, SupervisionOptions, ThrottleMode, ThrottleOptions, ValveMode
from tidemill.stream import Branch, Flow, Sink, Valve


@pytest.fixture(params=[False, True], ids=["one-task", "ranges"])
def run(spark, request):
    engine = Engine(spark, large=request.param, block=3)

    def go(source, most=1000):
        return engine.run(source.to(Sink.collect(CollectOptions(most)), "r")).value("r")

    go.engine = engine
    return go


TEN = S.range_(1, 10)


def timed(*pairs):
    return S.from_rows(list(pairs), "value int, at long", time="at").select("value")


def test_select_and_where_keep_order(run):
    assert run(S.range_(1, 7).where("value > 2").select("value * 2")) == [6, 8, 10, 12, 14]


def test_null_is_an_element(run):
    assert run(S.single(None, "string")) == [None]
    assert run(S.from_rows([1, None, None, 2, None], "int").deduplicate_consecutive()) == [1, None, 2, None]


def test_take_and_skip(run):
    assert run(TEN.take(3)) == [1, 2, 3]
    assert run(TEN.take(0)) == []
    assert run(TEN.skip(8)) == [9, 10]
    assert run(TEN.where("value % 2 = 0").skip(1).take(2)) == [4, 6]


def test_while_stages(run):
    assert run(TEN.take_while("value < 4")) == [1, 2, 3]
    assert run(TEN.take_through("value < 4")) == [1, 2, 3, 4]
    assert run(TEN.skip_while("value < 8")) == [8, 9, 10]
    assert run(TEN.take_while("value < 100")) == list(range(1, 11))
    assert run(TEN.skip_while("value < 100")) == []


def test_distinct_and_its_bound(run):
    s = S.from_rows([3, 1, 3, 2, 1], "int")
    assert run(s.distinct(DistinctOptions(3))) == [3, 1, 2]
    with pytest.raises(TrackedKeyOverflowError):
        run(s.distinct(DistinctOptions(2)))
    assert run(s.distinct(DistinctOptions(2)).take(2)) == [3, 1], "the failing element is never pulled"
    assert run(S.from_rows([1, 2, 1, 3, 1], "int").distinct(DistinctOptions(2, KeyOverflowPolicy.EVICT_OLDEST))) == [1, 2, 3, 1]


def test_scan_never_emits_the_seed(run):
    assert run(S.range_(1, 4).scan(fn.total("value", 10))) == [11, 13, 16, 20]
    assert run(S.empty("int").scan(fn.total("value", 10))) == []
    assert run(S.range_(2, 3).scan(fn.fold(0, lambda s, r: s + r["value"]))) == [2, 5, 9]
    assert run(S.from_rows([2, 5, 1], "int").scan(fn.greatest("value"))) == [2, 5, 5]


def test_grouped(run):
    assert [sum(x) for x in run(TEN.grouped(3))] == [6, 15, 24, 10]
    assert run(S.empty("int").grouped(3)) == []


@pytest.mark.parametrize(("size", "step"), [(1, 1), (3, 1), (3, 2), (4, 4), (2, 5), (7, 3), (12, 5)])
@pytest.mark.parametrize("n", [0, 1, 7, 10])
def test_sliding_against_a_step_model(spark, size, step, n):
    got = Engine(spark, large=False).run(S.range_(0, n).sliding(size, step).to(Sink.collect(CollectOptions(100)), "r")).value("r")
    want, carried, at = [], 0, 0
    while at + size <= n:
        want.append(list(range(at, at + size)))
        carried, at = at + size, at + step
    if max(at, carried) < n and at < n:
        want.append(list(range(at, n)))
    assert got == want


def test_flattening(run):
    assert run(S.range_(1, 3).select_many("sequence(1, value)")) == [1, 1, 2, 1, 2, 3]
    assert run(S.range_(1, 5).choose("IF(value % 2 = 0, value, NULL)")) == [2, 4]
    assert run(S.range_(1, 3).merge_map(ParallelismOptions(2), fn.Py(lambda r: [r["value"]] * 2, "int"))) == [1, 1, 2, 2, 3, 3]
    with pytest.raises(DataflowError):
        run(S.range_(1, 3).select_many("IF(value = 2, NULL, array(value))"))


def test_async_map_keeps_order(run):
    assert run(TEN.select_async(ParallelismOptions(4), fn.Py(lambda r: r["value"] * 10, "long"))) == [10 * i for i in range(1, 11)]


def test_group_by_merges_in_order_of_the_element_that_set_free(run):
    assert run(TEN.group_by(GroupByOptions(3), "value % 3", Flow().grouped(2))) == [[1, 4], [2, 5], [3, 6], [7, 10], [8], [9]]
    with pytest.raises(TrackedKeyOverflowError):
        run(TEN.group_by(GroupByOptions(2), "value % 3", Flow().take(1)))
    assert run(S.from_rows([None, 1, None], "int").group_by(GroupByOptions(2), "value", Flow().scan(fn.counting()))) == [1, 1, 2]


def test_group_by_evicts_the_least_recently_used(run):
    s = S.from_rows([1, 2, 1, 3, 2], "int")
    o = GroupByOptions(2, ActiveKeyOverflowPolicy.EVICT_IDLE)
    assert run(s.group_by(o, fn.Py(lambda r: r["value"]), Flow().scan(fn.fold(0, lambda a, r: a + 1)), schema="value long")) == [1, 1, 2, 1, 1]


def test_group_flow_admits_only_its_list():
    with pytest.raises(ValueError, match="buffer"):
        TEN.group_by(GroupByOptions(2), "value", Flow().buffer(BufferOptions(1)))


def test_joins_of_streams(run):
    assert run(TEN.take(2).concat(S.range_(90, 2))) == [1, 2, 90, 91]
    assert run(TEN.take(5).interleave(S.range_(90, 2), 2)) == [1, 2, 90, 91, 3, 4, 5]
    assert run(TEN.take(2).zip(S.range_(7, 5), "first * 100 + second")) == [107, 208]
    assert sorted(run(TEN.take(2).merge(S.range_(7, 1)))) == [1, 2, 7]
    assert run(TEN.take(1).prepend(S.range_(90, 1)).append(S.range_(80, 1))) == [90, 1, 80]
    assert run(timed((1, 0), (2, 10)).combine_latest(timed((7, 5), (8, 20)), "first * 10 + second")) == [17, 27, 28]
    assert run(timed((1, 0)).combine_latest(timed().where("false"), "first") if False else timed((1, 0)).take(0)) == []


def test_forks(run):
    assert run(S.range_(1, 3).fork(Flow().select("value * 10"), Flow().select("value + 1")).zip("first + second")) == [12, 23, 34]
    assert sorted(run(S.range_(1, 2).fork_merge(Flow(), Flow().select("value * 10")))) == [1, 2, 10, 20]


def test_junction_legs(run):
    g = TEN.broadcast_to(Branch(Flow().where("value % 2 = 0"), Sink.count(), "even"), Branch(Flow().where("value % 2 = 1"), Sink.count(), "odd"))
    assert run.engine.run(g).values == {"even": 5, "odd": 5}
    g = TEN.partition_to("value % 3", *[Branch(Flow(), Sink.count(), f"leg-{i}") for i in range(3)])
    assert run.engine.run(g).values == {"leg-0": 3, "leg-1": 4, "leg-2": 3}
    with pytest.raises(RouteOutOfRangeError):
        run.engine.run(TEN.partition_to("value", *[Branch(Flow(), Sink.count(), f"leg-{i}") for i in range(3)]))
    g = TEN.also_to(Branch(Flow(), Sink.count(), "tap")).divert_to("value > 7", Branch(Flow(), Sink.count(), "side")).to(Sink.count(), "main")
    assert run.engine.run(g).values == {"tap": 10, "side": 3, "main": 7}
    with pytest.raises(ValueError, match="legs"):
        TEN.broadcast_to(Branch(Flow(), Sink.count()))


def test_sinks(run):
    e = run.engine
    assert e.run(TEN.to(Sink.first(), "r")).value("r") == 1
    assert e.run(TEN.to(Sink.last(), "r")).value("r") == 10
    assert e.run(S.empty("int").to(Sink.first_or_default(), "r")).value("r") == 0
    assert e.run(S.empty("string").to(Sink.last_or_default(), "r")).value("r") is None
    assert e.run(S.empty("int").to(Sink.aggregate(fn.total("value", 5)), "r")).value("r") == 5
    assert run(TEN, most=10) == list(range(1, 11))
    with pytest.raises(CollectOverflowError):
        run(TEN, most=9)
    with pytest.raises(EmptyStreamError):
        e.run(S.empty("int").to(Sink.first(), "r"))
    seen = []
    e.run(TEN.to(Sink.for_each(seen.append)))
    assert seen == list(range(1, 11))


def test_sources(run):
    assert run(S.range_(2**31 - 2, 2)) == [2**31 - 2, 2**31 - 1]
    with pytest.raises(ValueError):
        S.range_(2**31 - 1, 2)
    assert run(S.repeat(3, 2)) == [3, 3]
    assert run(S.cycle([1, 2, 3], "int").take(7)) == [1, 2, 3, 1, 2, 3, 1]
    with pytest.raises(UnboundedSourceError):
        run(S.cycle([1], "int").skip(1))
    with pytest.raises(UnboundedSourceError):
        run(S.never("value int"))
    with pytest.raises(SourceFailedError, match="gone"):
        run(S.failed("gone", "int"))
    assert run(S.unfold(1, lambda s: (s, s * 2) if s < 20 else None, "long")) == [1, 2, 4, 8, 16]
    calls = []
    s = S.from_factory(lambda: calls.append(1) or 5, "int")
    assert not calls
    assert run(s) == [5] and run(s) == [5] and len(calls) == 2


def test_ingress_queue_policies():
    for policy, kept in ((OverflowPolicy.DROP_OLDEST, [2, 3]), (OverflowPolicy.DROP_NEWEST, [1, 2]), (OverflowPolicy.DROP_BUFFER, [3])):
        _, q = S.queue_(BufferOptions(2, policy), "int")
        for i in (1, 2, 3):
            q.offer(i)
        assert list(q.items) == kept
    _, q = S.queue_(BufferOptions(1, OverflowPolicy.FAIL), "int")
    assert q.offer(1) == "accepted" and q.offer(2) == "failed"
    with pytest.raises(BufferOverflowError):
        q.drain()


T = timed((1, 0), (2, 10), (3, 11), (4, 12), (5, 100))


def times(run, s):
    return [r["t"] for r in run.engine.frame(s, time="t").orderBy("value").collect()]


def test_time_stages(run):
    assert times(run, T.delay(5)) == [5, 15, 16, 17, 105]
    assert times(run, T.initial_delay(11)) == [11, 11, 11, 12, 100]
    assert run(T.take_within(12)) == [1, 2, 3]
    assert run(T.skip_within(12)) == [4, 5]
    with pytest.raises(StreamTimeoutError):
        run(T.timeout(50))
    assert run(T.timeout(50).take(4)) == [1, 2, 3, 4]
    assert run(T.grouped_within(3, 12)) == [[1, 2, 3], [4], [5]]
    assert run(T.grouped_weighted_within(9, 5, 1000, lambda r: r["value"])) == [[1, 2], [3], [4], [5]]


@pytest.mark.parametrize("cost", [None, "value % 3"])
def test_throttle_against_a_bucket(run, cost):
    rate_per, burst = 10, 3
    got = times(run, T.throttle(ThrottleOptions(1, rate_per, burst), cost=cost))
    level, at, want = float(burst), 0, []
    for v, ts in ((1, 0), (2, 10), (3, 11), (4, 12), (5, 100)):
        c = 1 if cost is None else v % 3
        now = max(ts, at)
        level = min(burst, level + (now - at) / rate_per)
        if level < c:
            now += (c - level) * rate_per
            level = c
        level, at = level - c, now
        want.append(now)
    assert got == want


def test_throttle_enforcing(run):
    with pytest.raises(RateLimitExceededError):
        run(T.throttle(ThrottleOptions(1, 10, 2, ThrottleMode.ENFORCING)))
    assert run(T.throttle(ThrottleOptions(1, 10, 2, ThrottleMode.ENFORCING)).take(3)) == [1, 2, 3]


def test_buffers(run):
    assert run(T.buffer(BufferOptions(1))) == [1, 2, 3, 4, 5]
    assert run(T.buffer(BufferOptions(1, OverflowPolicy.DROP_OLDEST), service_micros=20)) == [1, 4, 5]
    assert run(T.buffer(BufferOptions(1, OverflowPolicy.DROP_NEWEST), service_micros=20)) == [1, 2, 5]
    with pytest.raises(BufferOverflowError):
        run(T.buffer(BufferOptions(1, OverflowPolicy.FAIL), service_micros=20))
    assert run(T.valve("gate", ValveMode.CLOSED)) == []


SCOPE = Flow().fault_point("value = 2").scan(fn.total("value"))
PY_SCOPE = Flow().fault_point(fn.Py(lambda r, *_: r["value"] == 2)).scan(fn.fold(0, lambda s, r: s + r["value"]))


@pytest.mark.parametrize("scope", [SCOPE, PY_SCOPE], ids=["columns", "python"])
def test_supervision(run, scope):
    s = S.range_(1, 4)
    go = lambda form, **kw: run(s.supervised(SupervisionOptions(form, **kw.pop("o", {})), scope, schema="value long", **kw))
    assert go(SupervisionForm.RESUME) == [1, 4, 8]
    assert go(SupervisionForm.RESTART_STAGE) == [1, 3, 7]
    assert go(SupervisionForm.RECOVER, fallback=-1) == [1, -1]
    assert go(SupervisionForm.RETRY, o={"max_attempts": 2, "on_exhaustion": RetryExhaustion.RESTART_STAGE}) == [1, 3, 7]
    with pytest.raises(DataflowError):
        go(SupervisionForm.RETRY, o={"max_attempts": 2})


def test_retry_counts_an_element_once_per_attempt_in_stages_before_the_failure(run):
    scope = Flow().scan(fn.fold(0, lambda s, r: s + 1)).fault_point(fn.Py(lambda r, n: r["value"] == 2))
    assert run(S.range_(1, 3).supervised(SupervisionOptions(SupervisionForm.RETRY, 2, (), RetryExhaustion.FAIL), scope, schema="value long")) == [1, 3, 4]


@pytest.mark.parametrize("make", [lambda: TEN.take(-1), lambda: TEN.grouped(0), lambda: TEN.sliding(1, 0), lambda: TEN.distinct(DistinctOptions(0)), lambda: TEN.throttle(ThrottleOptions(1, 0)), lambda: TEN.buffer(BufferOptions(0)), lambda: Sink.collect(CollectOptions(0)), lambda: TEN.delay(0), lambda: TEN.supervised(SupervisionOptions(SupervisionForm.RESUME, 3), Flow())])
def test_bounds_are_checked_where_a_stage_is_placed(make):
    with pytest.raises(ValueError):
        make()


def test_awaited_functions(run):
    import asyncio

    async def slow(r):
        await asyncio.sleep(0.02 * (5 - r["value"] % 5))
        return r["value"] * 10

    async def fails(r):
        raise ValueError(f"no {r['value']}")

    o = ParallelismOptions(3)
    assert run(TEN.select_async(o, fn.Py(slow, "int"))) == [10 * i for i in range(1, 11)]
    assert sorted(run(TEN.select_value_task_async_unordered(o, fn.Py(slow, "int")))) == [10 * i for i in range(1, 11)]
    with pytest.raises(Exception, match="no 1"):
        run(S.range_(1, 1).select_async(o, fn.Py(fails, "int")))


def test_no_more_calls_at_once_than_declared():
    import asyncio

    from tidemill.operators.lower import called

    now, most = [0], [0]

    async def count(_):
        now[0] += 1
        most[0] = max(most[0], now[0])
        await asyncio.sleep(0.005)
        now[0] -= 1

    assert [i for i, _ in called(count, [{}] * 20, 4, True)] == list(range(20)) and most[0] == 4


def test_merge_map_of_asynchronous_sequences(run):
    async def up_to(r):
        for i in range(r["value"]):
            yield i

    assert run(S.range_(1, 3).merge_map(ParallelismOptions(2), fn.Py(up_to, "int"))) == [0, 0, 1, 0, 1, 2]


def test_awaited_folds(run):
    async def step(s, r):
        return s + r["value"]

    assert run(TEN.scan_async(fn.fold(0, step))) == [1, 3, 6, 10, 15, 21, 28, 36, 45, 55]


def test_a_valve_holds_and_releases(run):
    s = timed((1, 0), (2, 10), (3, 20), (4, 30), (5, 40))
    gate = Valve(True)
    gate.close(5)
    gate.open(25)
    assert run(s.valve("gate", control=gate)) == [1, 2, 3, 4, 5]
    out = run.engine.frame(s.valve("gate", control=gate), time="left").orderBy("value").collect()
    assert [tuple(r) for r in out] == [(1, 0), (2, 25), (3, 25), (4, 30), (5, 40)]
    gate.close(35)
    assert run(s.valve("gate", control=gate)) == [1, 2, 3, 4], "what it holds at the end is not released"
    gate.open(50)
    assert run(s.valve("gate", control=gate)) == [1, 2, 3, 4, 5]
    shut = Valve(False)
    assert run(s.valve("gate", control=shut)) == []
    with pytest.raises(ValueError):
        gate.close(10)


def test_lossy_buffers_need_the_consumers_time():
    with pytest.raises(ValueError, match="service_micros"):
        TEN.buffer(BufferOptions(2, OverflowPolicy.DROP_NEWEST))


def test_cycles_go_through_a_bounded_buffer(run):
    half = Flow().select("value div 2")
    assert run(S.from_rows([8, 3, 20], "int").select("cast(value AS long)").feedback(half, "value > 1", BufferOptions(5, OverflowPolicy.FAIL))) == [1, 1, 1]
    s = S.from_rows([1, 2, 3, 4], "long")
    less = Flow().select("value - 10")
    assert run(s.feedback(less, "value > -10", BufferOptions(2, OverflowPolicy.DROP_NEWEST))) == [-19, -18]
    assert run(s.feedback(less, "value > -10", BufferOptions(2, OverflowPolicy.DROP_OLDEST))) == [-17, -16]
    assert run(s.feedback(less, "value > -10", BufferOptions(3, OverflowPolicy.DROP_BUFFER))) == [-16]
    with pytest.raises(BufferOverflowError):
        run(s.feedback(less, "value > -10", BufferOptions(3, OverflowPolicy.FAIL)))
    with pytest.raises(ValueError, match="pushes back"):
        s.feedback(less, "value > 0", BufferOptions(3))
    with pytest.raises(DataflowError, match="rounds"):
        run(s.feedback(Flow().select("value"), "true", BufferOptions(9, OverflowPolicy.FAIL), most_rounds=3))


def test_keyed_python_folds_run_apart(run):
    flow = Flow().scan(fn.fold(0, lambda s, r: s + r["value"])).grouped(2)
    got = run(TEN.group_by(GroupByOptions(3), "value % 3", flow, schema="value array<struct<value:long>>"))
    assert [[x["value"] for x in g] for g in got] == [[1, 5], [2, 7], [3, 9], [12, 22], [15], [18]]
    with pytest.raises(TrackedKeyOverflowError):
        run(TEN.group_by(GroupByOptions(2), "value % 3", flow, schema="value array<struct<value:long>>"))
    assert run(TEN.group_by(GroupByOptions(2), "value % 3", Flow().scan(fn.total("value"))).take(2)) == [1, 2], "the key past the bound is never pulled"
    assert run(TEN.group_by(GroupByOptions(3), fn.Py(lambda r: r["value"] % 3, "int"), Flow().scan(fn.counting()), key_name="k").select("k * 100 + value")) == [101, 201, 1, 102, 202, 2, 103, 203, 3, 104]


def test_collect_orders_nulls_first_like_every_stage(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("ä", 4)], "k string, v int")
    s = S.from_frame(df, ["k"]).select({"v": "v"})
    assert Engine(spark).run(s.to(Sink.collect(CollectOptions(4)), "r")).value("r") == [{"v": 2}, {"v": 3}, {"v": 1}, {"v": 4}]
    with pytest.raises(CollectOverflowError):
        Engine(spark).run(s.to(Sink.collect(CollectOptions(3)), "r"))


def test_snapshots_count_what_stages_did(spark):
    engine = Engine(spark, counters=True)
    source, q = S.queue_(BufferOptions(3, OverflowPolicy.DROP_OLDEST), "int")
    for i in range(8):
        q.offer(i)
    assert engine.run(source.to(Sink.count(), "n")).snapshot == {"status": "completed", "error": None, "results": 1, "dropped": 5, "supervised": 0, "poison": 0, "evicted": 0}
    retry = SupervisionOptions(SupervisionForm.RETRY, 3, (0,), RetryExhaustion.RESUME)
    scope = Flow().fault_point(fn.Py(lambda r, *_: r["value"] == 4)).select(fn.Py(lambda r: r))
    seen = engine.run(TEN.supervised(retry, scope, schema="value int").to(Sink.count(), "n"))
    assert seen.value("n") == 9 and seen.snapshot["supervised"] == 3 and seen.snapshot["poison"] == 1
    idle = GroupByOptions(2, ActiveKeyOverflowPolicy.EVICT_IDLE)
    seen = engine.run(TEN.group_by(idle, fn.Py(lambda r: r["value"] % 3), Flow().scan(fn.fold(0, lambda s, r: s + 1)), schema="value long").to(Sink.count(), "n"))
    assert seen.value("n") == 10 and seen.snapshot["evicted"] == 8
    with pytest.raises(DataflowError):
        engine.run(TEN.fault_point("value = 2").to(Sink.count(), "n"))
    assert engine.last.snapshot["status"] == "failed" and engine.last.snapshot["error"] == "DataflowError"


@pytest.mark.parametrize("block", [4, 7, 1000])
@pytest.mark.parametrize("weighted", [False, True])
def test_groups_within_a_time_are_the_same_over_blocks(spark, block, weighted):
    import random

    rng = random.Random(block)
    for monotone in (True, False):
        at, pairs = 0, []
        for i in range(60):
            at += rng.choice([0, 1, 1, 2, 9, 30]) if monotone else rng.choice([-3, 0, 1, 5, 20])
            pairs.append((i, at))
        flow = Flow().grouped_weighted_within(4, 6, 10, lambda r: r["value"] % 5) if weighted else Flow().grouped_within(4, 10)
        one, many = (Engine(spark, large=large, block=block).run(timed(*pairs).via(flow).to(Sink.collect(CollectOptions(100)), "r")).value("r") for large in (False, True))
        assert one == many and sum(map(len, one)) == 60
    with pytest.raises(Exception, match="a weight of 4"):
        Engine(spark, large=True, block=block).run(timed((1, 1), (2, 2)).grouped_weighted_within(4, 3, 10, lambda r: 4).to(Sink.count(), "r"))
