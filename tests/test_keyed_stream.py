"""Keyed streaming state: late, repeated and out-of-order deliveries, restarts, quiet seeds, and the summary behind each batch."""

import random
import time

import pytest

from pyspark.sql import functions as F
from tallyforge.operators import runs
from tallyforge.streaming import keyed

SCHEMA = "uuid long, run_index int, f_rate double, s_rate double, n_req long, total_iterations int, end_time string, success boolean, seq struct<t:int, p:int>"
K = 3


def deliveries(batches=6, seed=3):
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(batches):
        own = []
        for _ in range(60):
            seq += 1
            # Late: a smaller sequence than one that has arrived.
            at = (seq - rng.choice([0, 0, 0, 200]), rng.choice([None, 1, 2]))
            f, s = rng.randrange(5) / 4, rng.choice([None, 0.0, 0.5, 1.0])
            uuid = rng.randrange(25)
            # A null index is run 0; no seed has both.
            own.append((uuid, rng.choice([None if uuid > 19 else 0, 1, 2, 3]), f, s, rng.randrange(4), rng.randrange(4), rng.choice(["2024-01-01", "", None, "2024-02-02"]), f == 1.0, at))
        own += own[:5]  # repeated in the same batch
        if rows:
            own += rng.sample(rows[-1], 5)  # and in a later one
        rows.append(own)
    return rows


def batch_summary(frame):
    return runs.passk_summary(runs.passk_per_seed(runs.valid_runs(runs.upsert_latest(frame)), K), K).first()


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def add(spark, folder, rows):
    time.sleep(0.05)  # files are read by their times
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "in", str(tmp_path / "state")


def same(got, want):
    assert tuple(got) == pytest.approx(tuple(want), abs=1e-9)


def test_every_batch_equals_the_batch_query(spark, folders):
    source, state = folders
    all_ = deliveries()
    live, seen, events, rows = keyed.Live(spark, state, K), [], [], []
    for i, own in enumerate(all_):
        add(spark, source, own)
        # A new query for each file: a restart, which goes on with the state of before.
        query = keyed.follow(stream_of(spark, source), live, on_event=lambda e, n: events.extend((n, r["uuid"], r["kind"]) for r in e.collect()), on_update=lambda s, n: seen.append((n, s.first())))
        query.awaitTermination()
        rows += own
        frame = spark.createDataFrame(rows, SCHEMA)
        assert [n for n, _ in seen] == list(range(i + 1))
        same(seen[-1][1], batch_summary(frame))
        done = {r["uuid"] for r in runs.completed_seeds(runs.upsert_latest(frame), K).collect()}
        assert sorted(u for _, u, k in events if k == "completed") == sorted(done)
    assert {r["uuid"] for r in live.events("completed").collect()} == done
    same(live.summary().first(), seen[-1][1])


def test_one_query_over_many_batches_and_one_over_all(spark, tmp_path):
    all_ = deliveries(seed=8)
    for own in all_:
        add(spark, tmp_path / "in", own)
    frame = spark.createDataFrame([r for own in all_ for r in own], SCHEMA)
    for name, stream in (("many", stream_of(spark, tmp_path / "in")), ("one", spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))):
        live = keyed.Live(spark, str(tmp_path / name), K)
        keyed.follow(stream, live).awaitTermination()
        same(live.summary().first(), batch_summary(frame))


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    live = keyed.Live(spark, str(tmp_path / "state"), K)
    share = [(7, "share", 1, 3.0, 1.0, 1.0, 0.5, 1.0, 2.0, 1.0), (7, "completed", 0, 3.0, 1.0, 1.0, 0.5, 1.0, 2.0, 1.0)]
    batch = spark.createDataFrame(share, keyed.EVENT.format("long"))
    for _ in range(2):
        assert [r["uuid"] for r in live.add(batch, 0).collect()] == [7]
    assert live.summary().first()["total_seeds"] == 1
    back = spark.createDataFrame([(7, "share", -1, *share[0][3:])], keyed.EVENT.format("long"))
    live.add(back, 1)
    assert tuple(live.summary().first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_a_stream_of_nothing_has_zeros(spark, tmp_path):
    assert tuple(keyed.Live(spark, str(tmp_path / "none"), K).summary().first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_quiet_seeds_are_told_once(spark, folders):
    source, state = folders
    run = lambda uuid, index: (uuid, index, 1.0, 1.0, 1, 1, "2024-01-01", True, (1, 1))
    add(spark, source, [run(1, 0), run(1, 1), run(2, 0), run(2, 1), run(2, 2)])
    live, events = keyed.Live(spark, state, K), []
    query = keyed.follow(
        stream_of(spark, source), live, {"processingTime": "1 second"}, on_event=lambda e, n: events.extend((r["uuid"], r["kind"]) for r in e.collect()), idle_seconds=2
    )
    try:
        until = time.time() + 60
        while time.time() < until and (1, "quiet") not in events:
            time.sleep(0.5)
        time.sleep(3)
    finally:
        query.stop()
    assert sorted(events) == [(1, "quiet"), (2, "completed")]
    assert live.summary().select(F.col("total_seeds")).first()[0] == 2


def test_runs_of_a_batch_are_counted_natively(spark, tmp_path, monkeypatch):
    for own in deliveries(seed=5):
        add(spark, tmp_path / "in", own)

    def none(*_):
        raise AssertionError("a call of Python for each seed")

    monkeypatch.setattr(keyed, "seed_events", none)
    live = keyed.Live(spark, str(tmp_path / "state"), K)
    keyed.follow(stream_of(spark, tmp_path / "in"), live).awaitTermination()
    assert live.summary().first()["total_seeds"] >= 5


def test_events_equal_those_of_the_state_store(spark, tmp_path):
    for own in deliveries(2, seed=6):
        add(spark, tmp_path / "in", own)
    found = {}
    for name, idle in (("tables", None), ("store", 3600)):
        live = keyed.Live(spark, str(tmp_path / name), K)
        events = found[name] = []
        keyed.follow(stream_of(spark, tmp_path / "in"), live, on_event=lambda e, n, to=events: to.extend((n, *r) for r in e.collect()), idle_seconds=idle).awaitTermination()
        events += [tuple(live.totals().first())]
    key = lambda r: (len(r), str(r))
    assert len(found["tables"]) > 10 and sorted(found["tables"], key=key) == sorted(found["store"], key=key)


def test_batches_that_come_again_around_a_compaction(spark, tmp_path):
    live, rows = keyed.Live(spark, str(tmp_path / "state"), K, compact=2), []
    for n, own in enumerate(deliveries(5, seed=9)):
        batch = spark.createDataFrame(own, SCHEMA)
        once, again = (sorted(map(str, live.add(live.arrived(batch, n), n).collect())) for _ in range(2))
        assert once == again
        rows += own
        same(live.summary().first(), batch_summary(spark.createDataFrame(rows, SCHEMA)))
    names = [x.name for x in (tmp_path / "state").iterdir()]
    assert sum(n.startswith("all-") for n in names) == 1 and sum(n.startswith("runs-") for n in names) <= 3


def test_seeds_are_aggregated_by_hashing(spark, capsys):
    run = "struct<f_rate:double,s_rate:double,n_req:bigint,total_iterations:int,end_time:string,success:boolean>"
    for columns in (f"uuid long, run_index int, after {run}", f"uuid long, run_index int, before {run}, after {run}"):
        keyed._events(spark.createDataFrame([], columns), K).explain()
        plan = capsys.readouterr().out
        assert "HashAggregate" in plan and "SortAggregate" not in plan
