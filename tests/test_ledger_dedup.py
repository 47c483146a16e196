"""Ledger, dedup, preferences and streaks on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import dedup, health, ledger, prefer


def now():
    return F.lit("2024-01-10 00:00:00").cast("timestamp")



def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def greedy(rows):
    seen_a, seen_b, kept = set(), set(), []
    for o, a, b in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            kept.append(o)
    return kept


def test_two_keys_follow_the_greedy_loop(spark):
    df = spark.createDataFrame([(1, "u1", "k1"), (2, "u2", "k1"), (3, "u2", "k2")], "o int, a string, b string")
    assert sorted(r["o"] for r in dedup.two_key_dedup(df, "a", "b", "o").collect()) == [1, 3]
    rng = random.Random(7)
    for n in (1, 30, 200):
        rows = [(i, f"a{rng.randint(0, n // 3)}", f"b{rng.randint(0, n // 3)}") for i in range(n)]
        df = spark.createDataFrame(rows, "o int, a string, b string")
        assert sorted(r["o"] for r in dedup.two_key_dedup(df, "a", "b", "o").collect()) == greedy(rows)
    assert dedup.two_key_dedup(df.limit(0), "a", "b", "o").count() == 0


def test_within_feed_keeps_first_place_and_last_payload(spark):
    df = spark.createDataFrame([("u", 1, "old"), ("v", 2, "x"), ("u", 3, "new")], "url string, n int, t string")
    assert sorted(map(tuple, dedup.merge_by_key(df, "url", "n").collect())) == [("u", 1, "new"), ("v", 2, "x")]
    assert sorted(map(tuple, dedup.merge_by_key(df, "url", "n", "first").collect())) == [("u", 1, "old"), ("v", 2, "x")]


def test_time_to_live(spark):
    df = spark.createDataFrame([("seen", "a", at(9, 22)), ("seen", "b", at(9, 21)), ("applied", "a", at(1)), ("other", "z", at(9, 23))], "kind string, key string, ts timestamp")
    got = {(r["kind"], r["key"]) for r in ledger.live(df, now(), {"seen": 3, "applied": 300}, "key").collect()}
    assert got == {("seen", "a"), ("applied", "a")}
    late = ledger.with_expiry(df, F.when(F.col("kind") == "applied", 300).otherwise(3)).where(F.col("expires_at") > now())
    assert {(r["kind"], r["key"]) for r in late.collect()} == got | {("other", "z")}


def test_upsert_replaces_some_columns_only(spark):
    df = spark.createDataFrame([("u", "applied", 1, "first", at(1), 1), ("u", "dismissed", 2, "second", at(2), 2)], "url string, decision string, score int, title string, ts timestamp, event_id int")
    r = ledger.upsert(df.withColumn("o", F.col("event_id")), "url", ["decision", "score"], ["ts", "o"]).first()
    assert (r["decision"], r["score"], r["title"]) == ("dismissed", 2, "first")


def test_transitions_and_current(spark):
    df = spark.createDataFrame([("p", "applied", at(1), 1), ("p", "reverted", at(2), 2), ("p", "dismissed", at(3), 3)], "key string, kind string, ts timestamp, event_id int")
    got = [(r["before"], r["status"]) for r in ledger.transitions(df, "key").orderBy("event_id").collect()]
    assert got == [("open", "applied"), ("applied", "open"), ("open", "dismissed")]
    assert ledger.current(df, ["key"], "kind", "dismissed").count() == 0


def test_followups(spark):
    df = spark.createDataFrame([(1, at(3)), (2, at(3, 21)), (3, at(2, 5)), (4, at(3, 1)), (5, at(2, 3))], "id int, ts timestamp")
    done = spark.createDataFrame([(4,)], "id int")
    assert sorted(r["id"] for r in ledger.followups_due(df, done, now(), "id").collect()) == [1, 3]


def test_preferences(spark):
    rows = [("applied", ["go", "db"]), ("applied", ["go"]), ("dismissed", ["php", "db"]), ("dismissed", ["php"]), ("applied", ["once"])]
    decided = spark.createDataFrame(rows, "kind string, w array<string>")
    weights = prefer.fit(prefer.word_support(decided, F.col("w")), decided)
    assert prefer.fit(prefer.word_support(decided.limit(3), F.col("w")), decided.limit(3), least=1).count() == 0
    assert {r["word"]: r["weight"] for r in weights.collect()} == {"go": 2.0, "php": -2.0}
    posts = spark.createDataFrame([(1, ["go", "x"]), (2, ["php", "go", "php2"]), (3, ["none"])], "id int, w array<string>")
    got = {r["id"]: (r["delta"], r["liked"], r["disliked"]) for r in prefer.apply(posts, "id", F.col("w"), weights).collect()}
    assert got == {1: (2, ["go"], []), 2: (0, ["go"], ["php"]), 3: (0, [], [])}


def test_streaks(spark):
    rows = [(i, "f", at(1, i), bad, n) for i, (bad, n) in enumerate([(True, 0), (False, 3), (True, 0), (True, 0), (False, 0)])]
    df = spark.createDataFrame(rows, "i int, source string, ran_at timestamp, bad boolean, n int")
    got = health.streaks(df, "source", ["ran_at"], F.col("bad"), F.col("n") > 0).orderBy("i").collect()
    assert [r["failures"] for r in got] == [1, 0, 1, 2, 0]
    assert [r["last_success"] and r["last_success"].hour for r in got] == [None, 1, 1, 1, 1]


def test_repair_skips_conflicts(spark):
    df = spark.createDataFrame([(1, "https://s.example12-a"), (2, "https://s.example13-b"), (3, "https://s.example/item/13-b")], "id int, url string")
    got = ledger.repair_urls(df, "^https://s[.]example([0-9].*)$", "https://s.example/item/$1").collect()
    assert [(r["id"], r["repaired"]) for r in got] == [(1, "https://s.example/item/12-a")]


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    """Each row shares a key with the next one, so that plain rounds would decide two rows each."""
    n = 10_000
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "o int, a string, b string")
    rounds = []
    real = dedup._without
    monkeypatch.setattr(dedup, "_without", lambda *a: rounds.append(1) or real(*a))
    got = sorted(r["o"] for r in dedup.two_key_dedup(df, "a", "b", "o").collect())
    assert got == list(range(0, n, 2)) and len(rounds) < 10


def test_chains_too_long_for_one_expression(spark):
    """Rounds and folds by turns; nulls are a key like any other."""
    import random

    rng = random.Random(3)
    rows = [(i, f"a{(i + 1) // 2}" if i % 7 else None, f"b{i // 2}") for i in range(60)] + [(100 + i, rng.choice(["p", "q", None]), rng.choice(["r", None])) for i in range(30)]
    df = spark.createDataFrame(rows, "o int, a string, b string").repartition(3)
    seen_a, seen_b, want = set(), set(), []
    for o, a, b in sorted(rows):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(o)
    for most in (5, 20_000):
        assert sorted(r["o"] for r in dedup.two_key_dedup(df, "a", "b", "o", rounds=1, most=most).collect()) == want


def test_an_order_with_nulls_or_ties_raises(spark):
    for rows in ([(None, "a", "b"), (1, "c", "d")], [(1, "a", "b"), (1, "c", "d")]):
        with pytest.raises(ValueError, match="nulls or ties"):
            dedup.two_key_dedup(spark.createDataFrame(rows, "o int, a string, b string"), "a", "b", "o")


def test_components(spark):
    import random

    from tamis.operators.graph import components

    rng = random.Random(2)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(200)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 50)]):
        root = {v: v for e in edges for v in e if e[0] != e[1]}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
        assert got == {v: find(v) for v in root}


def test_a_bucketed_history_is_not_exchanged(spark):
    from uuid import uuid4

    rows = spark.range(5000).select(F.concat(F.lit("u"), (F.col("id") * 3).cast("string")).alias("url"))
    new = spark.range(9000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history = ledger.bucketed(rows, f"history_{uuid4().hex}", "url", 8)
        left = ledger.unseen(new, history, "url")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan[plan.index("FileScan") - 300 : plan.index("FileScan")]
        assert left.count() == 9000 - 3000
        alike = ledger.unseen(ledger.bucketed(new, f"new_{uuid4().hex}", "url", 8), history, "url")
        assert "Exchange" not in alike._jdf.queryExecution().executedPlan().toString() and alike.count() == 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
