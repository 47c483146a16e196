import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
import regex as re
from pyspark.sql import functions as F

from tamis.llm import rule_quality, toxicity
from tamis.llm._shared import Sparse, lasso_logistic

from odd_texts import ODD


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def biased(spark, docs_of):
    """Labels in which most texts that name one group are toxic."""
    rng = random.Random(3)
    plain = ["".join(rng.choices("bcdfgklmn", k=4)) for _ in range(50)]
    texts, toxic = [], []
    for i in range(400):
        words = rng.choices(plain, k=12)
        bad = i % 2 == 0
        if bad and rng.random() < 0.6:
            words.insert(3, "zorgish")
        if rng.random() < (0.8 if bad else 0.02):
            words.insert(5, "muslims")
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return docs_of(texts), labels_of(spark, [(i, 1, t) for i, t in enumerate(toxic)]), " ".join(plain[:12])


def scores(model, spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["score"] for r in toxicity.classify(df, model).orderBy("doc_id").collect()]


def test_counterfactuals_even_out_groups(spark, biased):
    docs, labels, talk = biased
    even = toxicity.fit(docs, labels, l1=0.02)
    plain = toxicity.fit(docs, labels, l1=0.02, counterfactual=0.0)
    assert even.pairs == plain.pairs > 100
    texts = [f"muslims {talk}", f"christians {talk}", f"people {talk}", f"zorgish {talk}"]
    a, b = scores(even, spark, texts), scores(plain, spark, texts)
    assert b[0] - max(b[1:3]) > 0.2, b  # the plain fit takes the group's name for toxic
    assert a[3] - max(a[:3]) > 0.2, a
    assert max(a[:3]) - min(a[:3]) < 0.1 * (max(b[:3]) - min(b[:3]))
    assert abs(even.weights.get("muslims", 0)) < 0.5 * abs(plain.weights["muslims"])


def test_degenerate_labels(spark, docs_of):
    docs = docs_of(ODD, extra=True)
    none = labels_of(spark, [])
    one = labels_of(spark, [(i, 1, 0) for i in range(10)] + [(None, 0, 1), (3, None, None)])
    for labels in (none, one):
        got = toxicity.classify(docs, toxicity.fit(docs, labels)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] < 0.01 and r["predicted"] == 0 for r in got)
    got = rule_quality.classify(docs, rule_quality.fit(docs, none)).collect()
    assert {r["score"] for r in got} == {0.5}
    assert all(r["predicted"] == 1 for r in rule_quality.classify(docs, rule_quality.fit(docs, one)).collect())
    assert rule_quality.classify(docs.limit(0), rule_quality.RuleModel((), 0.0)).count() == 0


def plain_statistics(text):
    """The statistics of one text by plain Python."""
    cat = unicodedata.category
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x]
    count = lambda chars: sum(c in chars for c in text)
    share = lambda a, b: a / b if b else 0.0
    letters, upper = sum(cat(c)[0] == "L" for c in text), sum(cat(c) == "Lu" for c in text)
    n = len(words)
    return [n, share(len(text) - count(" \t\n\x0b\x0c\r"), n), share(n, len(lines)), share(len(set(words)), n), share(len(set(lines)), len(lines)),
            share(count("#*$%&|<>{}[]\\^~=_"), n), share(count("!?"), n), share(count(".,;:"), n), share(count("0123456789"), len(text)), share(letters, len(text)), share(upper, letters)]


def statistics_of(docs):
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return [list(r)[1:] for r in rule_quality.with_statistics(df, F.col("body"), "doc_id").orderBy("doc_id").collect()]


def test_statistics_equal_plain_ones(spark, docs_of, sf_dir):
    texts = [*ODD, "ÀÉß ǅ #!?.;: {x}[y] 12٣\n\n \nÀÉß\r\nÀÉß", "a\n \na\n\n b\\^~=_|"]
    assert statistics_of(docs_of(texts, extra=True)) == [plain_statistics(t or "") for t in texts]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert statistics_of(docs) == [plain_statistics(r["text"] or "") for r in docs.orderBy("doc_id").collect()]


def test_compiled_rules_equal_plain_rules(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rule_quality.fit(docs, labels, trees=6, least=3)
    assert model.rules
    x = np.array([plain_statistics(r["text"] or "") for r in docs.orderBy("doc_id").collect()])
    total = model.intercept + sum(w * r.holds(x, list(rule_quality.NAMES)) for r, w in model.rules)
    got = [r["score"] for r in rule_quality.classify(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    same = {r["row"]["doc_id"]: r["score"] for r in rule_quality.scored(docs, model).collect()}
    assert [same[k] for k in sorted(same)] == got


def plain_toxicity(model, text):
    found = {w for w in re.split(r"[^\p{L}]+", text.lower()) if w}
    found |= {w[: toxicity.PREFIX] + "*" for w in found if len(w) > toxicity.PREFIX}
    return 1 / (1 + math.exp(-model.intercept - sum(model.weights.get(w, 0.0) for w in found)))


def test_toxicity_scores_equal_plain_ones(spark, docs_of):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert any(f.endswith("*") for f in model.weights) and not all(f.endswith("*") for f in model.weights)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in toxicity.classify(docs, model).collect():
        assert math.isclose(r["score"], plain_toxicity(model, texts[r["doc_id"]]), rel_tol=1e-9)
    odd = [*ODD, " ".join([*list(model.weights)[:40], "x"])]
    for r in toxicity.classify(docs_of(odd, extra=True), model).collect():
        assert math.isclose(r["score"], plain_toxicity(model, odd[r["doc_id"]] or ""), rel_tol=1e-9)
    for weights in ({}, {"abc": 1.0}, {"abcde*": 1.0}):
        only = toxicity.ToxicityModel(weights, -1.0)
        for r in toxicity.classify(docs_of(["abc", "abcdef abcdeg", "ABC abcde", None]), only).collect():
            assert math.isclose(r["score"], plain_toxicity(only, ["abc", "abcdef abcdeg", "ABC abcde", ""][r["doc_id"]]))


@pytest.mark.parametrize(("module", "label", "threshold"), [(toxicity, "toxic", 0.5), (rule_quality, "quality", 0.3)])
def test_held_out_accuracy(spark, module, label, threshold):
    from tamis.llm._shared import held_out

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").repartition(4), spark.read.parquet(f"{d}/labels.parquet")
    model = module.fit(docs, labels)
    out = module.classify(docs, model, threshold).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out)
    right = {y: np.mean([r["predicted"] == y for r in out if r[label] == y]) for y in (0, 1)}
    assert right[0] >= 0.95 and right[1] >= (0.75 if label == "toxic" else 0.97)


def test_solver_matches_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (300, 6)).astype(float)
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.5).astype(float)
    w, b = lasso_logistic(Sparse.dense(x), y, 0.01, rounds=2000)
    err = 1 / (1 + np.exp(-(x @ w + b))) - y
    g = x.T @ err / 300
    assert abs(err.mean()) < 1e-3 and all(abs(v) <= 0.01 + 1e-3 for v in g)
    assert np.abs(g[np.abs(w) > 1e-3] + 0.01 * np.sign(w[np.abs(w) > 1e-3])).max() < 1e-3


def test_sample_holds_one_row_an_id(spark, docs_of):
    from tamis.llm._shared import held_out, labelled_sample

    labels = labels_of(spark, [(i, i % 2, 0) for i in range(40)])
    docs = docs_of([f"text {i}" for i in range(40)])
    again = docs.where(~held_out(F.col("doc_id"))).orderBy("doc_id").limit(1).crossJoin(spark.range(50)).withColumn("text", F.concat("text", F.lit(" "), F.col("id").cast("string"))).drop("id")
    got = labelled_sample(docs.unionByName(again), labels, "quality", {0: 5, 1: 40}).collect()
    assert len(got) == len({r["id"] for r in got}) and sum(r["y"] == 0 for r in got) == 5
    once = labelled_sample(docs, labels, "quality", {0: 5, 1: 40}).collect()
    assert {(r["id"], r["y"]) for r in got} == {(r["id"], r["y"]) for r in once}


@pytest.mark.parametrize(("group", "other", "neutral"), [("musulmans", "chrétiens", "personnes"), ("frauen", "männer", "menschen"), ("inmigrantes", "refugiados", "personas")])
def test_counterfactuals_in_other_languages(spark, docs_of, biased, group, other, neutral):
    docs, labels, talk = biased
    docs = docs.withColumn("text", F.replace("text", F.lit("muslims"), F.lit(group)))
    even = toxicity.fit(docs, labels, l1=0.02)
    plain = toxicity.fit(docs, labels, l1=0.02, counterfactual=0.0)
    texts = [f"{group} {talk}", f"{other} {talk}", f"{neutral} {talk}"]
    a, b = scores(even, spark, texts), scores(plain, spark, texts)
    assert b[0] - max(b[1:]) > 0.2 and max(a) - min(a) < 0.1 * (max(b) - min(b))
