"""Text, keys and inference on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamis.functions import infer, text


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_company_names(spark):
    names = ["Acme GmbH", "ACME GmbH & Co. KG", "Acme AG", "  acme   S.A.R.L. ", "Acme Ltd.", "Gmbh", "Acme Sales", None]
    assert values(spark, names, text.normalize_company(F.col("x"))) == ["acme", "acme", "acme", "acme s.a.r.l", "acme", "gmbh", "acme sales", None]


def test_urls(spark):
    cases = {
        "https://example.com/job?utm_source=test": "https://example.com/job",
        "HTTPS://Example.COM/Job/?ref=a&id=3&utm_medium=b#top": "https://example.com/Job?id=3",
        "https://example.com/": "https://example.com/",
        "https://example.com/a/?x=1": "https://example.com/a?x=1",
        "https://example.com/a?id=1&source=x&b=2": "https://example.com/a?id=1&b=2",
        "https://example.com/a?sources=1": "https://example.com/a?sources=1",
    }
    assert values(spark, list(cases), text.normalize_url(F.col("x"))) == list(cases.values())
    got = values(spark, ["https://a.example/x", "/root", "12-slug"], text.resolve_url("https://base.example/jobs/", F.col("x")))
    assert got == ["https://a.example/x", "https://base.example/root", "https://base.example/jobs/12-slug"]


def test_role_keys_and_tokens(spark):
    df = spark.createDataFrame([("Acme GmbH", "Senior Engineer | Remote")], "c string, t string")
    assert df.select(text.role_key(F.col("c"), F.col("t"))).first()[0] == "acme-gmbh::senior-engineer"
    assert sorted(values(spark, ["The node.js and C++ team, node.js!"], text.tokenize(F.col("x")))[0]) == ["c++", "node.js"]


def test_html(spark):
    assert values(spark, ["<p>a&nbsp;b</p>\n<b>&lt;c&amp;</b>"], text.strip_html(F.col("x"))) == ["a b <c&"]
    assert values(spark, ["one<br/>two<p>three<p><p><p>four"], text.strip_html_lines(F.col("x"))) == ["one\ntwo\nthree\n\nfour"]


def test_titles(spark):
    got = values(spark, ["Acme | Engineer", "Acme: Engineer", "Engineer at Acme", "Engineer", "x" * 41 + ": y"], text.title_split(F.col("x")))
    assert [tuple(r) for r in got] == [("Acme", "Engineer"), ("Acme", "Engineer"), ("Acme", "Engineer"), (None, "Engineer"), (None, "x" * 41 + ": y")]


@pytest.mark.parametrize(
    ("sentence", "years"),
    [
        ("5 to 10 years of experience", 5), ("5 à 10 ans", 5), ("5 bis 10 Jahre", 5), ("6+ years", 6), ("7+ ans", 7),
        ("minimum of 6 years", 6), ("au moins 6 ans", 6), ("mindestens 6 Jahre", 6), ("mind. 7 Jahre", 7),
        ("7 Jahre Berufserfahrung", 7), ("expérience confirmée de 5 ans", 5), ("founded 10 years ago", None), ("", None),
    ],
)
def test_years(spark, sentence, years):
    assert values(spark, [sentence], infer.min_years(F.col("x"))) == [years]


def test_language(spark):
    got = values(spark, ["we are looking for you, you will join our team", "für größere Bürotürme", "où êtes-vous né à Orléans", "nous recherchons votre profil", "wir suchen kenntnisse", ""], infer.detect_language(F.col("x")))
    assert got == ["en", "de", "fr", "fr", "de", "en"]


def test_places_are_whole_words(spark):
    dim = spark.createDataFrame([("nice", "FR", 0), ("roma", "IT", 1), ("munich", "DE", 2), ("Los-Angeles", "US", 3)], "name string, code string, ord int")
    df = spark.createDataFrame([("Venice, Italy",), ("Romania",), ("Nice",), ("Greater Munich (hybrid)",), ("Europe",), (None,), ("Nice",), ("in los angeles, nice",)], "label string")
    got = {(r["label"], r["country_code"]) for r in infer.infer_country(df, "label", dim, home="FR").collect()}
    assert got == {("Venice, Italy", None), ("Romania", None), ("Nice", "FR"), ("Greater Munich (hybrid)", "DE"), ("Europe", "FR"), (None, None), ("in los angeles, nice", "FR")}
    assert infer.infer_country(df, "label", dim).count() == 8
    assert infer.infer_country(df, "label", dim.limit(0)).where("country_code is not null").count() == 0


def test_salaries(spark):
    rates = spark.createDataFrame([("EUR", 1.0), ("USD", 0.88)], "currency string, rate double")
    rows = [(36000.0, None, None, "EUR"), (None, 3000.0, "monthly", "USD"), (None, 36000.0, "yearly", "EUR"), (60000.0, 1.0, "monthly", "XXX"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "salary_yearly_min double, salary_min double, salary_period string, salary_currency string")
    got = infer.monthly_eur(df, rates).collect()
    assert sorted([r["monthly_eur"] for r in got], key=str) == sorted([3000.0, 2640.0, 3000.0, None, None], key=str)
    parsed = values(spark, ["$100k-$150k", "de 30 000 à 40 000 Euros annuel", "none"], infer.salary_parse(F.col("x")))
    assert [tuple(p) for p in parsed] == [(100000.0, 150000.0, "USD", None), (30000.0, 40000.0, "EUR", "yearly"), (None, None, None, None)]


def test_times(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(1704164645, None, None), (None, 1704164645000, None), (None, None, "2024-01-02T03:04:05Z"), (None, None, "Tue, 02 Jan 2024 03:04:05 +0000"), (None, None, "Tue, 2 Jan 2024 03:04:05 GMT"), (None, None, "2 Jan 2024 03:04:05 UT"), (None, None, "Mon, 01 Jan 2024 22:04:05 est"), (None, None, "soon")], "s long, ms long, t string")
    got = [r[0] for r in df.select(F.date_format(infer.time_canon(F.col("s"), F.col("ms"), F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == [str(at)] * 7 + [None]


def test_work_mode(spark):
    assert values(spark, ["Fully remote team", "hybrid, partly remote", "remote", "in our office", ""], infer.work_mode(F.col("x"))) == ["remote", "hybrid", "remote", "on-site", "on-site"]
