from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamis.llm import exact_dedup

from odd_texts import ODD


def norm(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    return {k: (min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(g)) for k, g in groups.items()}


@pytest.mark.parametrize("partitions", ["4", "300"])
def test_equals_brute_force(spark, docs_of, partitions):
    rows = list(enumerate(ODD * 3)) + [(None, "a"), (None, "b b"), (7, "a"), (7, "a")] + [(1000 + i, "hot text") for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = exact_dedup.merge(df).collect()
        kept = exact_dedup.distinct_rows(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(rows)
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(want) == len(kept)
    assert sorted((str(k), n) for k, n in want.values()) == sorted((str(r["keep_id"]), r["group_size"]) for r in got if r["kept"])
    assert {norm(r["text"]) for r in kept} == set(want)
    by_text = {norm(r["text"]): r["doc_id"] for r in kept}
    assert by_text == {k: v[0] for k, v in want.items()}


def test_extra_columns_and_empty(spark, docs_of):
    docs = docs_of(["a", "a ", "b", None], extra=True)
    out = exact_dedup.distinct_rows(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3]
    assert exact_dedup.merge(docs.limit(0)).count() == 0


def test_rounds_read_sorted_runs_in_place(spark, docs_of, monkeypatch):
    """No Python; a round's plan neither exchanges nor sorts the runs that it reads."""
    plans = []
    take = exact_dedup._run_table

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return take(df, *args)

    monkeypatch.setattr(exact_dedup, "_run_table", noted)
    out = exact_dedup.merge(docs_of(["a", "b", "a "] * 20))
    rows, first, *rounds = plans
    assert len(rounds) == exact_dedup.ROUNDS - 1 and out.count() == 60
    assert rows.count("Exchange") == first.count("Exchange") == 1 and "Sort [" not in first
    for plan in rounds:
        assert "SortAggregate" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert not any("Python" in p or "Pandas" in p for p in plans)
    assert spark.sql("show tables").where("tableName like 'digest%'").count() == 0


def test_a_clash_of_digests_stops_the_job(spark, docs_of, monkeypatch):
    sha2 = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, n: sha2(F.substring(c, 1, 1), n))
    with pytest.raises(Exception, match=exact_dedup.CLASH):
        exact_dedup.merge(docs_of(["ab", "ac"])).collect()


def test_kept_rows_do_not_move(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = exact_dedup.distinct_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [coalesce" in plan and "SortMergeJoin" not in plan
