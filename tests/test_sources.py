"""Feeds, HTML extraction, sinks and streams on small tables and files."""

import json

from pyspark.sql import functions as F

from tamis.sources import feeds, html, sinks
from tamis.sources.variant import required_languages
from tamis.streaming import jobs


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "html string").select(column.alias("r")).first()["r"]


LD = '<script type="application/ld+json">{}</script>'
JOB = {"@type": "JobPosting", "title": "Engineer", "url": "/e", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Paris"}}}


def test_json_ld(spark):
    page = LD.format("{broken") + LD.format(json.dumps([JOB, {"@type": "Other", "title": "x"}])) + LD.format(json.dumps(JOB | {"hiringOrganization": "Plain"}))
    got = one(spark, page, html.json_ld(F.col("html")))
    assert [(r["title"], r["url"], r["company"], r["location"]) for r in got] == [("Engineer", "/e", "Acme", "Paris"), ("Engineer", "/e", "Plain", "Paris")]


def test_cascade(spark):
    jobs_list = [{"title": "A job", "url": "/a", "company": {"displayName": "X"}, "location": "Rome"}]
    pages = {
        1: LD.format(json.dumps(JOB)) + '<li><a href="/z">later strategy</a></li>',
        2: f'<script type="application/json">{json.dumps({"data": {"jobs": jobs_list}})}</script>',
        3: f'<script id="__NEXT_DATA__" type="x">{json.dumps({"props": {"pageProps": {"jobs": jobs_list}}})}</script>',
        4: f"<script>window.__INITIAL_STATE__ = {json.dumps({'jobs': {'list': jobs_list}})};</script>",
        5: '<li><h2>Card title</h2><span class="company">Y</span><a href="/c">go</a></li><li>no link</li>',
        6: "<p>nothing</p>",
    }
    df = spark.createDataFrame(list(pages.items()), "id int, html string")
    got = {r["id"]: (r["strategy"], r["title"], r["url"], r["company"]) for r in html.extract_records(df).collect()}
    assert got == {1: ("json_ld", "Engineer", "/e", "Acme"), 2: ("json_scripts", "A job", "/a", "X"), 3: ("next_data", "A job", "/a", "X"), 4: ("state", "A job", "/a", "X"), 5: ("cards", "Card title", "/c", "Y")}
    first = html.extract_records(df, order=("cards", "json_ld")).where("id = 1").first()
    assert first["strategy"] == "cards"


def test_rss(spark):
    import datetime as dt

    items = [
        "<title><![CDATA[Acme: Engineer]]></title><link>https://a.example</link><pubDate>Tue, 10 Jun 2003 04:00:00 GMT</pubDate><description><![CDATA[<b>x</b>]]></description><region>Europe</region>",
        "<title>B</title><guid isPermaLink='x'>https://b.example</guid><category>Anywhere</category>",
        "<title>C</title>",
        "<title>D</title><link>d</link><pubDate>one day</pubDate>",
    ]
    xml = "<rss>" + "".join(f"<item>{i}</item>" for i in items) + "</rss>"
    got = [tuple(r) for r in one(spark, xml, html.rss_items(F.col("html"), F.lit("2024-01-01").cast("timestamp")))]
    assert got == [("Acme: Engineer", "https://a.example", "<b>x</b>", "Europe", dt.datetime(2003, 6, 10, 4)), ("B", "https://b.example", "", "Anywhere", dt.datetime(2024, 1, 1))]


def test_links(spark):
    page = '<a class="x" href="/job/1"><b>First</b> job</a><a href="/job/2" title="By its attribute"></a><a href="/job/1">Again here</a><a href="/other/3">Another page</a><a href="/job/4">no</a><a href="https://me.example/x">Mine</a><a href="https://away.example/y">Away</a>'
    assert [tuple(r) for r in one(spark, page, html.link_cards(F.col("html"), ("/job/", "/offre/")))] == [("First job", "/job/1"), ("By its attribute", "/job/2")]
    assert one(spark, page, html.first_offsite(F.col("html"), F.lit("ME.example"))) == "https://away.example/y"
    assert one(spark, "<p>none</p>", html.first_offsite(F.col("html"), F.lit("a"))) is None


def test_main_text(spark):
    long = "word " * 60
    assert one(spark, "<h2>Job description</h2><p>The first paragraph.</p><li>A long item here</li><h3>Other</h3><p>not this text</p>", html.main_text(F.col("html"))) == "The first paragraph. A long item here"
    assert one(spark, f'<div class="x-description">{long}</div>', html.main_text(F.col("html"))) == long.strip()
    assert one(spark, f"<section>{long}</section><section>{long}{long}</section>", html.main_text(F.col("html"))) == (long + long).strip()
    assert one(spark, "<p>short</p>", html.main_text(F.col("html"))) is None


def test_posts(spark):
    got = one(spark, "We are Acme Corp (YC S21), makers of things | Berlin | REMOTE | $100k", html.post_parse(F.col("html")))
    assert tuple(got) == ("Acme Corp", "Berlin", "remote")


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"title": "T", "link": "u"}, {"title": "", "link": "v"}]}) + "\n{broken\n")
    feed = feeds.Feed("f", 3, "jobs array<struct<title:string,link:string>>", "jobs", {"title": ("title",), "url": ("link",)})
    got = feed.canonical(feed.read(spark, str(tmp_path)), F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["title"], r["url"], r["source"], r["company"]) for r in got] == [("T", "u", "f", None)]


def test_enrich_keeps_the_longer_text(spark):
    listing = spark.createDataFrame([(1, "short"), (2, "a longer text"), (3, None)], "id int, description string")
    detail = spark.createDataFrame([(1, "much longer"), (2, "tiny")], "id int, description string")
    got = {r["id"]: (r["description"], r["partial"]) for r in feeds.enrich(listing, detail, "id").collect()}
    assert got == {1: ("much longer", False), 2: ("a longer text", False), 3: (None, True)}


def test_required_languages(spark):
    raw = '[{"languageCode":"de","level":"b2"}, "fr", {"code":"en","required":false}, 3]'
    got = one(spark, raw, required_languages(F.try_parse_json("html")))
    assert [tuple(r) for r in got][:3] == [("DE", "B2", True), ("FR", None, True), ("EN", None, False)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "id int, s string")
    for _ in range(2):
        sinks.append_audit(rows, f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 2
    sinks.write_report(rows.select("s"), f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report").first()[0] == "x"
    sinks.write_table(rows, f"{tmp_path}/table", "id")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, f"2024-01-01 00:{i:02d}:00") for i in range(40)], "k int, v int, t string").withColumn("ts", F.to_timestamp("t"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_files(spark, f"{tmp_path}/in", rows.schema, "*.parquet", per_batch=1)
    got = jobs.run_to_table(jobs.dedup_within(stream, ["k"], "ts", "1 day").select("k"), "t")
    assert sorted(r["k"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_broken_responses_are_kept_apart(spark, tmp_path):
    """One broken, one pretty-printed and one one-line response: 0, n and n items, and one row of quarantine."""
    body = {"data": {"jobs": [{"title": f"t{i}", "url": f"/u{i}"} for i in range(3)]}}
    feed = feeds.Feed("f", 1, "data struct<jobs: array<struct<title: string, url: string>>>", "data.jobs", {"title": ("title",), "url": ("url",)})
    for name, text in {"broken": '{"data": {"jobs": [{"title": "x"', "pretty": json.dumps(body, indent=2), "line": json.dumps(body)}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = feed.responses(spark, str(tmp_path))
    per_file = {r["file"].rsplit("/", 1)[1]: r["n"] for r in got.select(F.col("_file").alias("file"), F.coalesce(F.size("data.jobs"), F.lit(0)).alias("n")).collect()}
    assert per_file == {"broken.json": 0, "pretty.json": 3, "line.json": 3}
    assert feed.read(spark, str(tmp_path)).count() == 6
    held = feed.quarantine(got).collect()
    assert [(r["feed"], r["file"].rsplit("/", 1)[1], r["reason"]) for r in held] == [("f", "broken.json", "malformed")] and held[0]["raw"].startswith('{"data"')
    assert feed.run_counts(got).first().asDict() == {"source": "f", "responses": 3, "broken": 1, "rows_found": 6, "error": None}
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x.json").write_text('{"error": "gone"}')
    counts = feed.run_counts(feed.responses(spark, f"{tmp_path}/only")).first()
    assert (counts["broken"], counts["rows_found"], counts["error"]) == (1, 0, "unreadable response: no list")


def test_responses_of_a_line_each(spark, tmp_path):
    feed = feeds.Feed("f", 1, "jobs array<struct<id: int>>", "jobs", {"title": ("id",)}, lines=True)
    (tmp_path / "a.json").write_text('{"jobs": [{"id": 1}, {"id": 2}]}\n{"jobs": [\n{"jobs": []}\n{}\n{"jobs": [{"id": 3}]}\n')
    assert sorted(r["item"]["id"] for r in feed.read(spark, str(tmp_path)).collect()) == [1, 2, 3]
    assert sorted(r["reason"] for r in feed.quarantine(feed.responses(spark, str(tmp_path))).collect()) == ["malformed", "no list"]


def test_rss_files_equal_the_column_form(spark, tmp_path):
    """Files that Spark reads in parts of some items."""
    items = []
    for i in range(400):
        items.append(f"<item><title><![CDATA[Acme {i}: a & b]]></title><link>https://a.example/{i}</link><pubDate>Tue, 10 Jun 2003 04:00:00 GMT</pubDate><description><![CDATA[<b>x</b> {i}]]></description><region> Europe </region></item>")
        items.append(f"<item>\n<title>B {i} &amp; c</title><guid isPermaLink='x'>https://b.example/{i}</guid><category>First</category><category>Second</category></item>")
    items += ["<item><title>C</title></item>", "<item><title>D</title><link>d</link><pubDate>one day</pubDate></item>", "<item><title></title><link>e</link></item>", "<item><title>broken</titl><link>f</link></item>"]
    for name, part in (("a", items[:300]), ("b", items[300:])):
        (tmp_path / f"{name}.xml").write_text("<?xml version='1.0'?><rss><channel><title>Feed</title>" + "\n".join(part) + "</channel></rss>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        now = F.lit("2024-01-01").cast("timestamp")
        rows = feeds.rss_files(spark, str(tmp_path), now)
        assert rows.rdd.getNumPartitions() > 4
        got = sorted(tuple(r) for r in rows.collect())
        held = feeds.rss_quarantine(feeds.rss_rows(spark, str(tmp_path)), "f").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(held) == 1 and "broken</titl>" in held[0]["raw"] and held[0]["file"].endswith("b.xml")
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.explode(html.rss_items(F.col("value"), now)).alias("r")).select("r.*")
    want = sorted((r["title"].replace("&amp;", "&"), *tuple(r)[1:]) for r in whole.collect())
    assert got == want and len(got) == 800


def test_state_of_a_page(spark):
    jobs_list = {"listings": [{"title": "A job", "url": "/a; b"}]}
    pages = [
        f"<script>window.__STATE__ = {json.dumps(jobs_list)};</script>",
        f"<script>var x = 1; window.__STORE__={json.dumps(jobs_list)};\n window.other = {{}};</script>",
        f"<script>window.__INITIAL_STATE__ = {json.dumps(jobs_list)}\n</script><script>more()</script>",
    ]
    for page in pages:
        assert [(r["title"], r["url"]) for r in one(spark, page, html.state(F.col("html")))] == [("A job", "/a; b")]
    assert one(spark, "<script>window.__STATE__ = {broken</script>", html.state(F.col("html"))) is None


def test_each_strategy_stands_once_in_the_plan(spark):
    plan = html.extract_records(spark.createDataFrame([("x",)], "html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(x) == 1 for x in ("application/ld[+]json", "__NEXT_DATA__", "__INITIAL_STATE__"))
