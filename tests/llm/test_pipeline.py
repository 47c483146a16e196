"""Each stage of the pipeline against a plain version of what it should do to its own input."""

import importlib

import numpy as np
import public_tokenizers
import pytest
import regex as re
from tokenizers import Tokenizer

from odd_texts import ODD
from test_classifiers import plain_statistics, plain_toxicity
from test_exact_dedup import norm
from test_near_copies import plain_components
from test_packing import check

from tamis.llm import rule_quality, toxicity

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def p():
    return importlib.import_module("corpus_pipeline")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def packed_whole(rows, texts):
    lengths = {i: len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    padding, used = check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows], lengths, 2048)
    assert padding == 0 and used == sum(lengths.values())


def test_stages_equal_plain_ones(spark, sf_dir, p):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages, kept = dict(p.STAGES), {}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        columns = docs.columns
        if name == "quality":
            model = rule_quality.fit(docs, labels)
            x = np.array([plain_statistics(t) for t in texts.values()])
            score = model.intercept + sum(w * r.holds(x, list(rule_quality.NAMES)) for r, w in model.rules)
            want = [i for i, s in zip(texts, score, strict=True) if 1 / (1 + np.exp(-s)) >= 0.3]
        elif name == "toxicity":
            model = toxicity.fit(docs, labels)
            want = [i for i, t in texts.items() if plain_toxicity(model, t) < 0.5]
        elif name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                k = norm(t)
                best[k] = min(best.get(k, (0, i)), (-len(t), i)) if k in best else (-len(t), i)
            want = [i for _, i in best.values()]
        else:
            want = set(plain_components(texts).values())
        docs = p.written(stages[name](spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert ids(docs) == sorted(want), name
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        kept[name] = len(texts)
    assert 200 > kept["quality"] >= kept["toxicity"] >= kept["exact_dedup"] >= kept["near_dedup"] > 100
    packed = stages["packing"](spark, docs, sf_dir).collect()
    packed_whole(packed, texts)
    assert {r["doc_id"] for r in p.run(spark, sf_dir).collect()} == set(texts)


def test_empty_tables_odd_texts_and_clashing_columns(spark, docs_of, sf_dir, p):
    for docs in (docs_of([]), docs_of(ODD, extra=True)):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for name, stage in p.STAGES:
            out = stage(spark, docs, sf_dir)
            rows = out.collect()
            if name == "packing":
                packed_whole(rows, texts) if rows else None
                assert {r["doc_id"] for r in rows} == set(texts)
            else:
                assert out.columns == docs.columns and {r["doc_id"] for r in rows} <= set(texts)


def test_nulls_ties_and_repeated_rows(spark, sf_dir, p):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, None, None, None, None), (None, long, None, None, None), (5, long, "en", "s", 1), (5, long, "en", "s", 1), (4, long, None, None, None), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(p.STAGES)
    for name in ("quality", "toxicity"):
        got = stages[name](spark, docs, sf_dir).collect()
        texts = [r["text"] or "" for r in got]
        assert all(texts.count(t) == sum((r[1] or "") == t for r in rows) for t in set(texts))
    for name in ("exact_dedup", "near_dedup"):
        assert sorted((r["doc_id"], re.sub(r"\\d+", "", r["text"] or "")[:4]) for r in stages[name](spark, docs, sf_dir).collect()) == [(4, "word"), (9, "")]
    got = stages["packing"](spark, docs, sf_dir).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 2 + len(TOKENIZER.encode(long).ids)
