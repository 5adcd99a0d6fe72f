import pytest

from tidemill import sources as S
from tidemill.engine import Engine
from tidemill.errors import PipelineRejectedError
from tidemill.options import BufferOptions, CollectOptions, OverflowPolicy
from tidemill.sources import IngressQueue, adapters
from tidemill.stream import Sink


def collect(engine, s):
    return engine.run(s.to(Sink.collect(CollectOptions(100)), "r")).value("r")


def test_sources(spark):
    q = IngressQueue(BufferOptions(2, OverflowPolicy.DROP_OLDEST))
    r = adapters.standard(queues={"in": (q, "int")}, makers={"three": (lambda: range(3), "int")})
    e = Engine(spark, r)
    for i in range(5):
        q.offer(i)
    assert collect(e, S.from_registered(r, "spark/observable@v1", "pushes", queue="in")) == [3, 4]
    assert collect(e, S.from_registered(r, "spark/timer@v1", "clock", period_micros=5, tick_limit=3).select("at")) == [0, 5, 10]
    with pytest.raises(ValueError):
        S.from_registered(r, "spark/reminder@v1", "late", period_micros=5, minimum_micros=10, until_micros=100)
    with pytest.raises(PipelineRejectedError, match="unknown-stage"):
        collect(Engine(spark), S.from_registered(r, "spark/timer@v1", "clock", period_micros=5, tick_limit=3))


def test_calls_keep_order(spark):
    r = adapters.standard(services={"double": (lambda x: x["value"] * 2, "long")})
    e = Engine(spark, r)
    ten = S.range_(1, 10)
    assert collect(e, ten.via_registered(r, "spark/call@v1", "calls", service="double", max_in_flight=4)) == [2 * i for i in range(1, 11)]
    assert collect(e, ten.via_registered(r, "spark/call-keyed@v1", "calls", service="double", key="value")) == [2 * i for i in range(1, 11)]


def test_streams_and_marks(spark, tmp_path):
    sink = adapters.CallSink({"ack": lambda x: None})
    r = adapters.standard()
    r.add_sink("spark/marking@v1", sink)
    e = Engine(spark, r)
    path = str(tmp_path / "topic")
    e.run(S.range_(1, 6).to(Sink.registered(r, "spark/stream-sink@v1", "out", path=path)))
    assert collect(e, S.from_registered(r, "spark/stream-source@v1", "in", path=path, order="value", cursor=4)) == [4, 5, 6]
    for _ in range(2):
        e.run(S.range_(1, 6).to(Sink.registered(r, "spark/marking@v1", "calls", service="ack", max_in_flight=2)))
    assert sink.marks == {"ack": {"acknowledged": 12}}
