"""Rules, places, scores and second opinions on small tables."""

import pytest
from pyspark.sql import functions as F

from tamis.operators import health, rules, score

PLACES = rules.Places(preferred=("FR",), excluded=("RU",), targets=(), europe=("FR", "DE", "IT", "GB"), relocate=("IT",), overseas=("US",), needs_support=("GB",), tiers=(("FR",), ("DE",), ("IT",)))


@pytest.mark.parametrize(
    ("country", "mode", "support", "scope", "accept", "points"),
    [
        ("US", "remote", False, "unknown", False, 0), ("DE", "remote", False, "restricted", False, 0), ("DE", "remote", False, "open", True, 100),
        (None, "remote", False, "unknown", True, 85), (None, "on-site", False, "unknown", False, 0), (None, "hybrid", False, "unknown", True, 70),
        ("RU", "hybrid", True, "unknown", False, 0), ("FR", "on-site", False, "unknown", True, 100), ("GB", "hybrid", False, "unknown", False, 0),
        ("GB", "hybrid", True, "unknown", True, 80), ("IT", "on-site", False, "unknown", True, 70), ("IT", "on-site", True, "unknown", True, 80),
        ("IT", "hybrid", True, "unknown", True, 85), ("DE", "on-site", True, "unknown", True, 80), ("DE", "hybrid", False, "unknown", False, 0),
        ("US", "on-site", True, "unknown", False, 0), ("BR", "hybrid", True, "unknown", False, 0),
    ],
)
def test_places(spark, country, mode, support, scope, accept, points):
    df = spark.createDataFrame([(country, mode, support, scope)], "c string, m string, s boolean, r string")
    got = df.select(rules.location_score(F.col("c"), F.col("m"), F.col("s"), F.col("r"), PLACES).alias("l")).first()["l"]
    assert (got["accept"], got["score"]) == (accept, points)


@pytest.mark.parametrize(
    ("label", "text", "scope"),
    [("Remote (US)", "", "restricted"), ("United States (Remote)", "", "restricted"), ("Remote", "you must reside in Germany", "single-country"), ("EMEA", "", "open"), ("", "fully remote", "global"), ("Berlin", "", "unknown"), ("", "x" * 1600 + " us only", "unknown")],
)
def test_scopes(spark, label, text, scope):
    df = spark.createDataFrame([(label, text)], "a string, b string")
    assert df.select(rules.remote_scope(F.col("a"), F.col("b"))).first()[0] == scope


def test_more_scopes(spark):
    cases = [
        ("Remote (US/CA)", "", "restricted"),
        ("REMOTE (US or LATAM; must overlap with US Pacific hours)", "", "restricted"),
        ("Remote (Global)", "", "open"),
        ("Remote EMEA", "", "open"),
        ("Remote", "", "unknown"),
        (None, None, "unknown"),
        ("Remote", "You must be based in the Netherlands for this role.", "single-country"),
        ("Remote", "Poland residents only, fully distributed team.", "single-country"),
        ("Remote", "You must be located in Italy to apply.", "single-country"),
        ("Remote", "Candidates must reside in Germany.", "single-country"),
        ("Remote", "Open to candidates anywhere in the EU.", "open"),
        ("Remote", "Our company is based in Germany. We hire worldwide.", "open"),
        ("Remote", "We are located in the Czech Republic.", "open"),
        ("Remote", "Germany residents only", "single-country"),
        ("Remote", "Residents of the Czech Republic only", "single-country"),
        ("Remote", "open only to Spain residents", "single-country"),
        ("Remote", "United-Kingdom-based candidates only", "single-country"),
        ("Remote", "only candidates currently living in Norway", "single-country"),
        ("Remote", "must be based in Malta" + "x", "open"),
        ("US citizens", "", "restricted"),
        ("Remote US", "", "restricted"),
        ("campus only", "", "unknown"),
        ("Canada only", "", "restricted"),
        ("Remote", "Strong overlap with US Eastern time zone", "restricted"),
        ("Remote", "an office in the United States", "unknown"),
        ("Fully remote", "", "global"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", rules.remote_scope(F.col("a"), F.col("b")).alias("s")).collect()}
    assert {i: (a, b, got[i]) for i, (a, b, _) in enumerate(cases)} == {i: c for i, c in enumerate(cases)}


def test_pack_gives_one_reason_and_the_funnel_adds_up(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50), (4, 500)], "id int, v int")
    pack = rules.RulePack((("large", F.col("v") > 100), ("medium", F.col("v") > 10)))
    assert {(r["id"], r["reject_reason"]) for r in pack.apply(df).collect()} == {(1, None), (2, None), (3, "medium"), (4, "large")}
    assert [(r["reason"], r["detail"], r["n"], r["percent"]) for r in pack.funnel(df).orderBy("stage").collect()] == [("large", None, 1, 25.0), ("medium", None, 1, 25.0)]
    broken = pack.funnel(df.unionByName(spark.createDataFrame([(5, 11)], "id int, v int")), {"medium": F.when(F.col("v") > 20, "over 20").otherwise("to 20")})
    assert [(r["reason"], r["detail"], r["n"], r["percent"]) for r in broken.orderBy("stage", "detail").collect()] == [("large", None, 1, 20.0), ("medium", "over 20", 1, 20.0), ("medium", "to 20", 1, 20.0)]
    assert [tuple(r) for r in pack.purge(df, "id", {"large": F.col("v")}).orderBy("id").collect()] == [(3, "medium", ""), (4, "large", "500")]
    assert pack.passed(df).count() == 2
    assert pack.funnel(df.limit(0)).count() == 2


def test_blocklist_as_table(spark):
    df = spark.createDataFrame([("acme",), ("groupe sii",), ("siiba",), (None,)], "k string")
    names = spark.createDataFrame([("sii",)], "name string")
    assert {r["k"] for r in rules.blocked_by_list(df, "k", names).collect()} == {"acme", "siiba", None}
    assert [r[0] for r in df.select(rules.blocked_company(F.col("k"), ("sii",))).collect()] == [False, True, False, None]


def test_a_long_blocklist_of_names_of_any_length(spark):
    """Equal to the pattern of all names on 5,000 names of one to four words that share their words."""
    import random

    rng = random.Random(6)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(900)]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(7000)} - set(words[:800]))
    names = rng.sample(names, 5000) + ["c++ a", "a.b", "x & y"]
    keys = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(300)] + [f"the {rng.choice(names)} group" for _ in range(100)] + ["c++ a lab", "axb", "an a.b", "x & yes", "", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    left = rules.blocked_by_list(df, "k", spark.createDataFrame([(n,) for n in names], "name string"))
    want = df.where(~F.coalesce(rules.blocked_company(F.col("k"), names), F.lit(False)))
    assert sorted(r["i"] for r in left.collect()) == sorted(r["i"] for r in want.collect())
    assert 20 < want.count() < 390 and left.columns == ["i", "k"]


def test_neighbouring_terms_both_count(spark):
    df = spark.createDataFrame([("vue vue, angular/vue vueé node.js node.js, node js",)], "x string")
    count = lambda *terms: df.select(rules.count_terms(F.col("x"), terms)).first()[0]
    assert count("vue") == 4 and count("node.js") == 2 and count("vue", "angular") == 5


@pytest.mark.parametrize(
    ("title", "text", "rejected"),
    [("Angular dev", "node once", True), ("Node dev", "angular angular angular node node", False), ("Dev", "angular angular angular", True), ("Dev", "angular node node", False), ("Dev", "expert in angular", True)],
)
def test_dominance(spark, title, text, rejected):
    df = spark.createDataFrame([(title, text)], "a string, b string")
    got = rules.term_dominance(df.toDF("title", "text"), "title", "text", ("angular", "rxjs"), ("node", "nestjs"), ("expert in angular",)).first()
    assert got["rejected"] is rejected


@pytest.mark.parametrize(
    ("found", "title", "home", "rejected"),
    [("en", "Software engineer", False, False), ("en", "Développeur confirmé à Orléans, été", False, True), ("en", "Développeur confirmé à Orléans, été", True, False), ("de", "Plain title", False, True), ("en", "Café manager wanted for our very large team of happy people", False, True)],
)
def test_accented_titles_are_asked_again(spark, found, title, home, rejected):
    df = spark.createDataFrame([(found, title, home)], "f string, t string, h boolean")
    assert df.select(rules.wrong_language(F.col("f"), "en", F.lit(False), F.col("h"), F.col("t"))).first()[0] is rejected


@pytest.mark.parametrize(
    ("langs", "text", "reject", "note"),
    [
        ([("DE", "B2", True)], "", True, "DE B2"), ([("DE", "A2", True)], "", False, "DE A2"), ([("FR", "C1", False)], "", False, "FR C1 (optional)"),
        ([("EN", "C2", True)], "", False, None), (None, "German required", True, None), ([], "", False, None), ([("DE", None, None)], "", False, "DE"),
    ],
)
def test_language_demands(spark, langs, text, reject, note):
    df = spark.createDataFrame([(langs, text)], "l array<struct<code:string,level:string,required:boolean>>, t string")
    got = df.select(rules.language_requirement(F.col("l"), F.col("t"), ("german required",)).alias("r")).first()["r"]
    assert (got["reject"], got["note"]) == (reject, note)


@pytest.mark.parametrize(
    ("veto", "model", "model_veto", "fraud", "relevant", "reason"),
    [(False, None, False, 0, True, "no_model_data"), (True, None, False, 0, False, "hard_skip"), (False, 90, True, 0, False, "hard_skip"), (False, 54, False, 0, False, "below_threshold"), (False, 55, False, 72, False, "suspicious_fraud"), (False, 55, False, 71, True, "relevant")],
)
def test_reconcile(spark, veto, model, model_veto, fraud, relevant, reason):
    df = spark.createDataFrame([(veto, model, model_veto, fraud)], "code_veto boolean, model_score int, model_veto boolean, fraud_score int")
    r = score.reconcile(df).first()
    assert (r["relevant"], r["reason"]) == (relevant, reason)


def test_health(spark):
    rows = [("tunnel closed", 0, True, False), ("HTTP 403", 0, True, False), ("boom", 0, False, False), (None, 0, True, True), (None, 0, False, True), (None, 4, True, True)]
    df = spark.createDataFrame(rows, "e string, n int, p boolean, d boolean")
    got = [r[0] for r in df.select(health.classify(F.col("e"), F.col("n"), F.col("p"), F.col("d"))).collect()]
    assert got == ["proxy_offline", "blocked", "error", "proxy_offline", "empty", "ok"]


def test_required_part(spark):
    df = spark.createDataFrame([("need 3 years. Nice to have: 9 years",), ("nice to have: 9 years",), ("plain",)], "x string")
    assert [r[0] for r in df.select(rules.required_part(F.col("x"))).collect()] == ["need 3 years.", "nice to have: 9 years", "plain"]
