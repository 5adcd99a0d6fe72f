"""What decides between one task and many, and what large streams go through."""

import asyncio

import pytest
from pyspark.sql import functions as F

from tidemill import functions as fn
from tidemill import queries as Q
from tidemill import sources as S
from tidemill.engine import Engine
from tidemill.operators.interpreter import Chain
from tidemill.operators.order import BLOCK, TS
from tidemill.options import DistinctOptions, KeyOverflowPolicy, ThrottleOptions


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A file of few bytes and more rows than one task should put in order."""
    path = f"file://{tmp_path_factory.mktemp('many')}/t"
    spark.range(0, BLOCK + 1000, 1, 2).select("id", (F.col("id") % 3).alias("k")).write.parquet(path)
    return S.parquet(path, ["id"])


def one_task_sees_all(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SinglePartition" in plan and "Window [row_number" in plan


@pytest.mark.parametrize("kind", ["zip", "deduplicate_consecutive"])
def test_many_rows_of_few_bytes_are_large(spark, many, kind):
    """A selection of narrow columns was put in order by one task, whatever its number of rows."""
    k = many.select("k")
    s = {"zip": lambda: k.zip(many.select("id"), "first + second"), "deduplicate_consecutive": lambda: k.deduplicate_consecutive()}[kind]()
    engine = Engine(spark)
    assert engine.ctx.large(engine.stream(k))
    df = engine.frame(s)
    assert not one_task_sees_all(df)
    assert df.count() == BLOCK + 1000


def test_a_zip_is_numbered_and_is_not_put_in_order_again(spark):
    a = S.from_rows([(i, i) for i in range(10)], "a long, t long", time="t")
    s = Engine(spark, large=True, block=3).stream(a.where("a % 2 = 1").zip(a.select("a")))
    assert s.dense
    assert [(r.first.a, r.second) for r in s.df.orderBy(*s.order).collect()] == [(2 * i + 1, i) for i in range(5)]
    assert TS in s.df.columns


@pytest.mark.parametrize("kind", ["awaited", "evicting", "fails"])
def test_large_streams_go_element_by_element_in_stretches(spark, kind):
    """Each stretch takes up the state of the one before; one task put the whole stream in order."""

    async def step(s, r):
        if kind == "fails" and r["a"] == 8:
            raise ValueError("eight")
        return s * 3 + r["a"]

    def found(large):
        s = S.from_rows([i * 5 % 11 for i in range(11)], "a long")
        s = s.distinct(DistinctOptions(2, KeyOverflowPolicy.EVICT_OLDEST)) if kind == "evicting" else s.scan_async(fn.fold(0, step))
        out = Engine(spark, large=large, block=3).stream(s)
        assert large is None or ("stretches" in "".join(out.df.inputFiles())) == large
        return [tuple(map(str, r)) for r in out.df.orderBy(*out.order).collect()]

    assert found(True) == found(False)


def test_a_step_is_awaited_without_entering_the_loop_for_it():
    async def step(s, r):
        await asyncio.sleep(0)
        loops.add(id(asyncio.current_task()))
        return s + r

    loops = set()
    chain = Chain([("scan", {"fold": fn.fold(0, step)})])
    assert chain.offer_all([1, 2, 3]) == ([[{"value": 1}], [{"value": 3}], [{"value": 6}]], None)
    assert chain.offer_all([4])[0] == [[{"value": 10}]]
    assert len(loops) <= 2


def test_more_than_one_run_may_collect_is_collected_by_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "MANY", 100)
    spark.range(250).selectExpr("499 - id * 2 AS event_id", "timestamp_seconds(id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    found = Q.queries()["sink_collect"](spark, str(tmp_path)).orderBy("n").collect()
    assert [(r.value, r.n) for r in found] == [(2 * i + 1, i) for i in range(250)]
    spark.range(0).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts").write.parquet(f"{tmp_path}/none/events.parquet")
    assert Q.queries()["sink_collect"](spark, f"{tmp_path}/none").collect() == []


def test_each_running_aggregate_of_a_throttle_deals_its_stream_once(spark):
    """The second and third computed the ones before twice over."""
    s = S.from_rows([(i, i * i % 7) for i in range(20)], "a long, t long", time="t").throttle(ThrottleOptions(1, 5, 4), cost="a % 3")
    one, many = (Engine(spark, large=large, block=3).stream(s) for large in (False, True))
    assert [(r.a, r[TS]) for r in many.df.orderBy(*many.order).collect()] == [(r.a, r[TS]) for r in one.df.orderBy(*one.order).collect()]
    assert many.df._jdf.queryExecution().sparkPlan().toString().count("FileScan") + many.df._jdf.queryExecution().sparkPlan().toString().count("Window [") <= 4
