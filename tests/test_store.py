"""Tables that outlive a run, and streams that go on where they ended."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import health, ledger
from tamis.operators.store import Conflict, StoredTable
from tamis.streaming import jobs

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def entry_rows(rng, n, since):
    kinds = ("seen", "applied")
    return [(rng.choice(kinds), f"k{rng.randrange(40)}", rng.choice(("add", "add", "remove")), at(since + i), since + i, at(since + i + rng.choice((5, 30, 90)))) for i in range(n)]


def test_append_compact_current_equal_a_dict(spark, tmp_path):
    """Over three runs, with a reader's view before and after each compaction."""
    rng, store, held = random.Random(3), ledger.stored_ledger(spark, f"{tmp_path}/ledger", 8), {}
    for run in range(3):
        rows = entry_rows(rng, 60, 60 * run)
        store.append(spark.createDataFrame(rows, ledger.ENTRY))
        held.update({r[:2]: r for r in rows})
        now = F.lit(at(60 * run + 60))
        want = {k for k, r in held.items() if r[2] == "add" and r[5] > at(60 * run + 60)}
        view = lambda: {(r["kind"], r["key"]) for r in ledger.members(store.read(), now).collect()}  # noqa: B023, E731
        assert view() == want
        ledger.compact_ledger(store, now)
        assert view() == want
        assert store.read().count() == len({k for k, r in held.items() if r[5] > at(60 * run + 60)})
    assert store.current().number == 6
    old = len(list((tmp_path / "ledger" / "data").iterdir()))
    store.vacuum(1)
    assert view() == want and len(list((tmp_path / "ledger" / "data").iterdir())) < old


def test_a_reader_sees_one_version(spark, tmp_path):
    store = ledger.stored_ledger(spark, f"{tmp_path}/ledger", 4)
    rows = entry_rows(random.Random(1), 20, 0)
    assert store.read().count() == 0
    store.append(spark.createDataFrame(rows, ledger.ENTRY))
    before, version = store.read(), store.current()
    store.append(spark.createDataFrame(rows[:5], ledger.ENTRY))
    ledger.compact_ledger(store, F.lit(at(500)))
    assert before.count() == 20 and store.read(version).count() == 20 and store.read().count() == 0
    with pytest.raises(ValueError, match="buckets"):
        ledger.stored_ledger(spark, f"{tmp_path}/ledger", 8).current()


def test_two_writers(spark, tmp_path):
    """Appends of two writers both count; a change that another writer overtook raises and leaves the table as it is."""
    store = ledger.stored_ledger(spark, f"{tmp_path}/ledger", 4)
    rows = entry_rows(random.Random(1), 20, 0)
    store.append(spark.createDataFrame(rows, ledger.ENTRY))
    first = store.current()
    real, asked = store.current, []

    def behind():
        asked.append(1)
        return first if len(asked) == 2 else real()

    ledger.stored_ledger(spark, f"{tmp_path}/ledger", 4).append(spark.createDataFrame(rows[:3], ledger.ENTRY))
    store.current = behind
    store.append(spark.createDataFrame(rows[:4], ledger.ENTRY))
    assert len(asked) == 3 and store.read().count() == 27
    store.current = lambda: first
    with pytest.raises(Conflict):
        store.compact(lambda rows: rows.limit(0))
    store.current = real
    assert store.read().count() == 27


SCHEMA = "url string, title string, decision string, at timestamp, score double"


def test_upsert_keeps_first_values_and_untouched_files(spark, tmp_path):
    rows = [(f"u{i}", f"t{i}", "applied", at(i), 1.0) for i in range(50)]
    store = StoredTable(spark, f"{tmp_path}/decisions", spark.createDataFrame([], SCHEMA).schema, ["url"], 16)
    replaced = ("decision", "at", "score")
    ledger.upsert_into(store, spark.createDataFrame(rows, SCHEMA), replaced, ["at"])
    before = store.current().folders
    changes = [("u3", "other", "dismissed", at(90), 2.0), ("u3", "third", "applied", at(80), 3.0), ("new", "n1", "applied", at(91), None), ("new", "n2", "dismissed", at(92), 4.0)]
    ledger.upsert_into(store, spark.createDataFrame(changes, SCHEMA), replaced, ["at"])
    after = store.current().folders
    got = {r["url"]: tuple(r)[1:] for r in store.read().collect()}
    assert len(got) == 51 and got["u3"] == ("t3", "dismissed", at(90), 2.0) and got["new"] == ("n1", "dismissed", at(92), 4.0) and got["u7"] == ("t7", "applied", at(7), 1.0)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(after) > 8
    ledger.insert_absent(store, spark.createDataFrame([("u3", "x", "x", at(0), 0.0), ("more", "m", "applied", at(1), 0.0)], SCHEMA), ["at"])
    got = {r["url"]: r["title"] for r in store.read().collect()}
    assert got["u3"] == "t3" and got["more"] == "m" and len(got) == 52
    ledger.upsert_into(store, spark.createDataFrame([], SCHEMA), replaced, ["at"])
    assert store.read().count() == 52
    with pytest.raises(ValueError, match="order"):
        ledger.upsert_into(store, spark.createDataFrame([], SCHEMA), replaced, ["nothing"])


def test_repair_in_a_stored_table(spark, tmp_path):
    rows = [(1, "https://s.example12-a"), (2, "https://s.example13-b"), (3, "https://s.example/item/13-b"), (4, "https://s.example12-a"), (5, "https://t.example"), (6, None)]
    df = spark.createDataFrame(rows, "id int, url string")
    store = StoredTable(spark, f"{tmp_path}/rows", df.schema, ["id"], 8)
    store.append(df)
    before = store.current().folders
    ledger.repair_stored(store, "url", "^https://s[.]example([0-9].*)$", "https://s.example/item/$1", ["id"])
    assert {r["id"]: r["url"] for r in store.read().collect()} == dict(rows) | {1: "https://s.example/item/12-a"}
    after = store.current().folders
    assert sum(after[b] != before[b] for b in before) == 1


# Streams.


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_resumes(spark, tmp_path):
    """A second call takes the new files only; without a place it begins anew."""
    folder, schema = f"{tmp_path}/in", "id int, v string"
    seen = []
    run = lambda: jobs.ingest(spark, folder, schema, lambda s: s.where("v != 'x'"), "*.parquet", at=f"{tmp_path}/state")
    for rows in ([(1, "a"), (2, "x"), (3, "b")], [(4, "c")], []):
        if rows:
            put(spark, folder, rows, schema)
        seen.append(sorted(r["id"] for r in run().collect()))
    assert seen == [[1, 3], [1, 3, 4], [1, 3, 4]]
    assert jobs.ingest(spark, folder, schema, lambda s: s, "*.parquet").count() == 4


def test_a_batch_that_failed_half_way_is_repeated_without_double_rows(spark, tmp_path):
    folder, schema, keys = f"{tmp_path}/in", "k string, n int", []
    put(spark, folder, [("a", 1), ("b", 2)], schema)
    store = StoredTable(spark, f"{tmp_path}/rows", spark.createDataFrame([], schema).schema, ["k"], 4)
    stream = lambda: jobs.read_files(spark, folder, schema, "*.parquet")

    def fails(batch, number):
        StoredTable(batch.sparkSession, store.path, store.schema, ["k"], 4).append(batch, ("s", number))
        keys.append(number)
        raise RuntimeError("lost after it wrote")

    def works(batch, number):
        keys.append(number)
        StoredTable(batch.sparkSession, store.path, store.schema, ["k"], 4).append(batch, ("s", number))

    with pytest.raises(Exception, match="lost after it wrote"):
        jobs.run_batches(stream(), "s", fails, at=f"{tmp_path}/state")
    jobs.run_batches(stream(), "s", works, at=f"{tmp_path}/state")
    assert keys == [0, 0] and sorted(r["n"] for r in store.read().collect()) == [1, 2]
    put(spark, folder, [("c", 3)], schema)
    jobs.run_batches(stream(), "s", works, at=f"{tmp_path}/state")
    assert sorted(r["n"] for r in store.read().collect()) == [1, 2, 3]


def test_first_writes_and_updates_over_runs(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "k string, n int"
    for rows, want in (([("a", 5), ("a", 4), ("b", 7)], {"a": 4, "b": 7}), ([("a", 1), ("c", 2)], {"a": 4, "b": 7, "c": 2})):
        put(spark, folder, rows, schema)
        got = jobs.first_writes(jobs.read_files(spark, folder, schema, "*.parquet"), "first", "k", ["n"], at=f"{tmp_path}/a", buckets=4)
        assert {r["k"]: r["n"] for r in got.collect()} == want
        sums = jobs.read_files(spark, folder, schema, "*.parquet").groupBy("k").agg(F.sum("n").alias("total"))
        last = jobs.run_updates(sums, "sums", ["k"], at=f"{tmp_path}/b", buckets=4)
    assert {r["k"]: r["total"] for r in last.collect()} == {"a": 10, "b": 7, "c": 2}


def test_unanswered(spark, tmp_path):
    """What comes out once the watermark has passed equals the batch's rows."""
    rng = random.Random(5)
    asked = [(i, i % 30, at(rng.randrange(600))) for i in range(120)] + [(999, 77, at(1500))]
    told = [(i % 30, at(rng.randrange(700))) for i in range(90)] + [(77, at(1500))]
    put(spark, f"{tmp_path}/asked", asked, "id int, k int, ts timestamp")
    put(spark, f"{tmp_path}/told", told, "k int, ts timestamp")
    read = lambda name, schema: jobs.read_files(spark, f"{tmp_path}/{name}", schema, "*.parquet")
    due = jobs.unanswered(read("asked", "id int, k int, ts timestamp"), read("told", "k int, ts timestamp"), "k", "ts", "100 hours", "2 hours")
    got = {r["id"] for r in jobs.run_to_table(due, "due", at=f"{tmp_path}/state").collect()}
    want = {i for i, k, t in asked if not any(q == k and t <= u <= t + dt.timedelta(hours=100) for q, u in told)}
    assert got == want and 10 < len(want) < 110


# Streaks.

RUNS = "source string, ran_at timestamp, run_id int, bad boolean, n int"


def streak_rows(rng, n=400):
    return [(f"f{rng.randrange(4)}", at(i // 3), i, rng.random() < 0.6, rng.randrange(3)) for i in range(n)] + [("never", at(i), 1000 + i, True, 0) for i in range(9)]


def plain_streaks(rows):
    out = {}
    for s, t, _, bad, n in sorted(rows, key=lambda r: (r[1], r[2])):
        runs, fails, last = out.get(s, (0, 0, None))
        out[s] = (runs + 1, fails + 1 if bad else 0, t if n else last)
    return out


def as_dict(df):
    return {r["source"]: (r["runs"], r["tail"], r["last_success"]) for r in df.collect()}


def test_summaries_fold_in_any_grouping(spark):
    rows = streak_rows(random.Random(4))
    df = spark.createDataFrame(rows, RUNS).repartition(5)
    parts = lambda *slices: health.summaries(df, "source", ["ran_at", "run_id"], F.col("bad"), F.col("n") > 0, slices)
    want = plain_streaks(rows)
    hours = lambda n: F.floor(F.unix_timestamp("ran_at") / (3600 * n))
    for got in (parts(), parts(hours(7)), parts(hours(31))):
        assert as_dict(health.folded(got)) == want


def test_three_batches_equal_one(spark, tmp_path):
    rows = streak_rows(random.Random(8))
    want = plain_streaks(rows)
    edges = (START, at(40), at(90), at(10_000))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        put(spark, f"{tmp_path}/in", [r for r in rows if a <= r[1] < b], RUNS)
        stream = jobs.read_files(spark, f"{tmp_path}/in", RUNS, "*.parquet")
        got = jobs.carried_health(stream, "health", ["ran_at", "run_id"], F.col("bad"), F.col("n") > 0, at=f"{tmp_path}/state", buckets=4)
    assert as_dict(got) == want
    put(spark, f"{tmp_path}/in", rows[:3], RUNS)
    with pytest.raises(Exception, match="come after later ones"):
        jobs.carried_health(jobs.read_files(spark, f"{tmp_path}/in", RUNS, "*.parquet"), "health", ["ran_at", "run_id"], F.col("bad"), F.col("n") > 0, at=f"{tmp_path}/state", buckets=4)
