import datetime as dt

from tamis.llm import url_lists


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


ENTRIES = [
    ("adult", "bad.example.com", "add", day(10)),
    ("adult", "bad.example.com", "add", day(12)),  # already on the list
    ("adult", "bad.example.com", "remove", day(20)),
    ("adult", "BAD.example.com", "add", day(30)),
    ("spam", "example.com", "add", day(5)),
    ("allow", "good.example.com", "add", day(0)),
    ("spam", "once.net", "add", day(7)),
    ("spam", "once.net", "remove", day(7)),
    (None, "once.net", "add", day(1)),
    ("spam", None, "add", day(1)),
    ("spam", "once.net", "add", None),
]


def entries(spark, rows=ENTRIES):
    return spark.createDataFrame(rows, "list string, pattern string, action string, day date")


def test_intervals(spark):
    got = sorted((r["list"], r["pattern"], r["valid_from"], r["valid_to"]) for r in url_lists.intervals(entries(spark)).collect() if r["list"] == "adult")
    assert got == [("adult", "bad.example.com", day(10), day(20)), ("adult", "bad.example.com", day(30), None)]
    assert url_lists.intervals(entries(spark)).where("pattern = 'once.net'").count() == 0


def test_captures_against_a_plain_search(spark):
    hosts = ["bad.example.com", "x.bad.example.com", "good.example.com", "a.good.example.com", "example.com", "notexample.com", "once.net", "localhost"]
    urls = [f"HTTP://user@{h}.:80/p?q#f" if i % 2 else f"https://{h}/" for i, h in enumerate(hosts)] + [None, "no url", "http:///x"]
    rows = [(i * 100 + n, u, day(n)) for i, u in enumerate(urls) for n in (0, 5, 9, 10, 19, 20, 29, 30, 99)] + [(1, urls[0], None), (2, urls[0], day(15)), (2, urls[0], day(15))]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched date")
    got = url_lists.evaluate(df, entries(spark)).collect()
    assert len(got) == len(rows)
    spans = [tuple(r) for r in url_lists.intervals(entries(spark)).collect()]
    for r in got:
        hit = [s for s in spans if r["host"] and r["fetched"] and (r["host"] == s[1] or r["host"].endswith("." + s[1])) and s[2] <= r["fetched"] and (s[3] is None or r["fetched"] < s[3])]
        block, allow = max([len(s[1]) for s in hit if s[0] != "allow"], default=0), max([len(s[1]) for s in hit if s[0] == "allow"], default=0)
        assert r["blocked"] == (block > allow) and r["lists"] == ",".join(sorted({s[0] for s in hit}))
    assert url_lists.evaluate(df, entries(spark, []).limit(0)).where("blocked").count() == 0
    assert url_lists.evaluate(df.limit(0), entries(spark)).count() == 0
    assert "Python" not in url_lists.evaluate(df, entries(spark))._jdf.queryExecution().toString().replace("ExistingRDD", "")


def test_clashing_columns_and_very_long_urls(spark):
    from pyspark.sql import functions as F

    long = "https://" + ".".join(["a" * 60] * 40) + ".bad.example.com/" + "p" * 200_000
    df = spark.createDataFrame([(1, long, day(12)), (2, "https://bad.example.com", day(12)), (3, "x" * 100_000, day(12))], "page_id long, url string, fetched date")
    names = ("host", "lists", "pattern", "blocked", "domain", "part", "list", "day", "action", "valid_from", "valid_to")
    got = {r["page_id"]: r for r in url_lists.evaluate(df.withColumns({k: F.lit(1) for k in names}), entries(spark).withColumns({"host": F.lit(1), "part": F.lit(2)})).collect()}
    assert got[1]["blocked"] and got[1]["lists"] == got[2]["lists"] == "adult,spam" and got[3]["host"] is None


def test_a_top_level_domain_on_a_list(spark):
    df = spark.createDataFrame([(i, f"https://h{i}.zip/", day(i % 3)) for i in range(300)], "page_id long, url string, fetched date")
    got = url_lists.evaluate(df, entries(spark, [("spam", "zip", "add", day(1))])).groupBy("blocked").count().collect()
    assert {r["blocked"]: r["count"] for r in got} == {True: 200, False: 100}


def test_many_captures_of_one_host_and_of_none(spark):
    """A hot host on one day, and captures without a host, are dealt to many tasks or pass beside the join."""
    urls = ["https://bad.example.com/", "no url", None, "https://fine.org/"]
    rows = [(i, urls[i % 4], day(12) if i % 8 < 6 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched date").repartition(7)
    found = url_lists.evaluate(df, entries(spark))
    assert "part" in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert sorted(r["page_id"] for r in got) == list(range(4000))
    assert {r["page_id"] for r in got if r["blocked"]} == {i for i in range(4000) if i % 4 == 0 and i % 8 < 6}
