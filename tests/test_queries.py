"""Every registered query over the smallest tables, those with SQL against DuckDB."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{Path(sf_dir) / t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op") and n != "pipeline"])
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        got = con.execute(SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == columns
        assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_two_key_dedup_equals_the_plain_loop(spark, sf_dir):
    from tamis.plans import adapters, search

    rows = search.keyed(adapters.postings(spark, sf_dir)).orderBy("ingest_ordinal").collect()
    urls, names, kept = set(), set(), set()
    for r in rows:
        name = (r["title"].lower().strip(), r["company"].lower().strip(), r["source"])
        if r["url_norm"] not in urls and name not in names:
            urls.add(r["url_norm"])
            names.add(name)
            kept.add(r["posting_id"])
    assert {r["posting_id"] for r in QUERIES["dedup_two_key"](spark, sf_dir).collect()} == kept


def test_engine_queries_without_what_the_other_package_needs():
    """With public_tokenizers out of reach, the engine's queries are still there."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 138 and out[1:] == ["False", "True"]


def test_stages_need_a_shared_folder(monkeypatch):
    from tamis.operators import stages

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master, applicationId = "spark://somewhere:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.shared_path(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert "app/x-" in stages.shared_path(Session, "x")


def test_written_and_discarded(spark):
    from tamis.operators.stages import discard, written

    out = written(spark.range(5), "some")
    assert out.count() == 5 and Path(out.written_to).is_dir()
    discard(out)
    assert not Path(out.written_to).exists()


def test_settings(spark, tmp_path):
    from tamis.plans.settings import load_settings

    (tmp_path / "s.json").write_text('{\n "titles": ["a", "b"],\n "max_results": 7, "unknown": 1}')
    got = load_settings(spark, str(tmp_path / "s.json"))
    assert got.titles == ("a", "b") and got.max_results == 7 and got.language == "en"
