import pytest

from tidemill import functions as fn
from tidemill import sources as S
from tidemill import streaming
from tidemill.engine import Engine
from tidemill.errors import CheckpointConflictError, PipelineResumeRefusedError
from tidemill.options import DurableRunOptions
from tidemill.stream import Flow, Sink


def test_durable_run_resumes_where_it_stood(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    drop = streaming.DropFolder(spark, folder, "k string, i long", 10)
    (tmp_path / "in").mkdir()
    options = DurableRunOptions(str(tmp_path / "runs"), "nightly")

    def frame():
        s = streaming.file_stream(spark, folder, "k string, i long", files_per_trigger=1)
        return streaming.keyed_fold(s, "k", "i", lambda state, r: (state[0] + r["i"],), (0,), "total long", "k string, i long, total long")

    def write(df, _):
        seen.extend(tuple(r) for r in df.collect())

    for row in (("a", 1), ("b", 5), ("a", 2)):
        assert drop.offer(row) == "accepted"
    drop.flush()
    run = streaming.start_durable(frame(), write, options, "sha256:x", 1)
    run.shutdown()
    assert sorted(seen) == [("a", 1, 1), ("a", 2, 3), ("b", 5, 5)]
    with pytest.raises(CheckpointConflictError):
        streaming.start_durable(frame(), write, options, "sha256:x", 1)
    with pytest.raises(PipelineResumeRefusedError):
        streaming.start_durable(frame(), write, options, "sha256:y", 1, resume=True)
    with pytest.raises(PipelineResumeRefusedError):
        streaming.start_durable(frame(), write, DurableRunOptions(str(tmp_path / "runs"), "other"), "sha256:x", 1, resume=True)
    drop.offer(("a", 10))
    drop.complete()
    assert drop.offer(("a", 1)) == "closed"
    run = streaming.start_durable(frame(), write, options, "sha256:x", 1, resume=True)
    run.shutdown()
    assert sorted(seen)[-2:] == [("a", 10, 13), ("b", 5, 5)], "state goes on, nothing is read twice"


def test_full_ingress_pushes_back(spark, tmp_path):
    drop = streaming.DropFolder(spark, str(tmp_path / "in"), "i long", 1)
    assert [drop.offer((1,)), drop.offer((2,))] == ["accepted", "full"]


def graph_over(folder, stop=100):
    letters = fn.fold((), lambda s, r: tuple(sorted({*s, r["value"]})), "array<string>")
    s = S.files("parquet", str(folder), ["i"], schema="i long, k string")
    numbers = s.where("i % 2 = 0").named("even").durable(Flow().select("i").skip(1).scan(fn.total("value", 1000)).take(stop)).named("sums")
    words = s.select("k").named("word").durable(Flow().scan_durable(letters, list, tuple)).named("seen")
    return numbers.to(Sink.ignore().named("end")), words.to(Sink.ignore().named("end"))


def test_durable_run_of_a_graph_goes_on_from_its_states(spark, tmp_path):
    engine, folder = Engine(spark), tmp_path / "in"
    folder.mkdir()

    def put(first, last, k):
        spark.createDataFrame([(i, k) for i in range(first, last)], "i long, k string").coalesce(1).write.mode("append").parquet(str(folder))

    numbers, words = graph_over(folder, 12)
    got = {"sums": [], "words": []}

    def go(name, graph, resume):
        run = streaming.run_durable(engine, graph, DurableRunOptions(str(tmp_path / "runs"), name), lambda df, _: got[name].extend(r.value for r in df.collect()), resume, 1)
        run.shutdown()
        return run

    put(0, 10, "x")
    assert go("sums", numbers, False).snapshot["status"] == "stopped"
    go("words", words, False)
    put(10, 17, "a")
    put(17, 40, "m")
    go("sums", numbers, True)
    go("words", words, True)
    want, total = [], 1000
    for i in range(2, 40, 2):
        total += i
        want.append(total)
    assert got["sums"] == want[:12]
    assert got["words"][0] == ["x"] and got["words"][9] == ["x"] and got["words"][10] == ["a", "x"] and got["words"][-1] == ["a", "m", "x"]
    with pytest.raises(PipelineResumeRefusedError, match="another graph"):
        go("sums", words, True)
    with pytest.raises(CheckpointConflictError):
        go("sums", numbers, False)
    with pytest.raises(ValueError, match="carries state"):
        go("other", S.files("parquet", str(folder), ["i"], schema="i long, k string").scan(fn.total("i")).to(Sink.ignore()), False)
    with pytest.raises(ValueError, match="files_per_trigger"):
        streaming.run_durable(engine, numbers, DurableRunOptions(str(tmp_path / "runs"), "x", every_elements=5), lambda df, _: None)


def test_a_batch_that_fails_runs_again_from_the_same_states(spark, tmp_path):
    engine, folder = Engine(spark), tmp_path / "in"
    for first in (0, 10):
        spark.createDataFrame([(i, "k") for i in range(first, first + 10)], "i long, k string").coalesce(1).write.mode("append").parquet(str(folder))
    graph, _ = graph_over(folder)
    options, got, broken = DurableRunOptions(str(tmp_path / "runs"), "again"), [], [True]

    def write(df, i):
        rows = [r.value for r in df.collect()]
        if i == 1 and broken[0]:
            raise RuntimeError("the sink is away")
        got.extend(rows)

    with pytest.raises(Exception, match="the sink is away"):
        streaming.run_durable(engine, graph, options, write, files_per_trigger=1).shutdown()
    broken[0] = False
    streaming.run_durable(engine, graph, options, write, True, 1).shutdown()
    want, total = [], 1000
    for i in range(2, 20, 2):
        total += i
        want.append(total)
    assert got == want
