import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamis.llm import divergence

from odd_texts import ODD


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(spans)
    hit = {j for i, s in enumerate(spans) if often[s] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("texts", [ODD, ["a b c a b c d", "x\nx\n x\n\n", "a a a a", "#a $b", "p q r " * 40]])
def test_base_counts(spark, docs_of, texts):
    docs = docs_of(texts, extra=True)
    none = divergence.references(docs, least_words=10**9)
    got = {r["doc_id"]: r for r in divergence.judge(docs, none).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in divergence.COUNTS) == base(t)
        n, _, _, _, repeat = base(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert got[i]["kept"] == (not got[i]["base_failed"])


def test_distance():
    assert divergence.jensen_shannon([1, 0], [0, 1]) == 1 and divergence.jensen_shannon([0.5, 0.5], [0.5, 0.5]) == 0
    a, b = [0.2, 0.8], [0.6, 0.4]
    m = [0.4, 0.6]
    want = math.sqrt(sum(x * math.log2(x / y) for p in (a, b) for x, y in zip(p, m, strict=True)) / 2)
    assert divergence.jensen_shannon(a, b) == pytest.approx(want)


def test_keeps_prose_and_drops_others(spark, docs_of):
    rng = random.Random(1)
    words = ["the", "of", "and", *["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]]
    prose = [" ".join(rng.choices(words, weights=[60, 50, 40] + [1] * 400, k=120)) for _ in range(40)]
    odd = {100: prose[0].upper(), 101: "### ".join(prose[1].split()), 102: " ".join(rng.choices(["zzz", "yyy", "xxx", "www"], k=100)), 103: "short text"}
    docs = docs_of(dict(enumerate(prose)) | odd)
    refs = divergence.references(docs)
    assert refs.count() == 1
    kept = {r["doc_id"]: r["kept"] for r in divergence.judge(docs, refs).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in odd)
    assert divergence.judge(docs.limit(0), refs).count() == 0 and divergence.references(docs.limit(0)).count() == 0


def test_rare_language_is_not_judged(spark, docs_of):
    rng = random.Random(1)
    words = ["the", "of", "and", *["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]]
    prose = [" ".join(rng.choices(words, weights=[60, 50, 40] + [1] * 400, k=120)) for _ in range(20)]
    rare = " ".join("".join(rng.choices("ქართული", k=6)) for _ in range(100))
    docs = docs_of(dict(enumerate(prose)) | {100: rare, 101: rare + " x" * 200, 102: prose[0].upper()})
    docs = docs.withColumn("lang", F.when(F.col("doc_id").isin(100, 101), "ka").otherwise(F.col("lang")))
    refs = divergence.references(docs, least_words=1000)
    assert [r["key"] for r in refs.collect()] == ["=en"]
    kept = {r["doc_id"]: r["kept"] for r in divergence.judge(docs, refs).collect()}
    assert kept[100] and not kept[101] and not kept[102]


def prose(rng, n, words=120):
    common = ["the", "of", "and", *["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]]
    return [" ".join(rng.choices(common, weights=[60, 50, 40] + [1] * 400, k=words)) for _ in range(n)]


def test_small_and_null_languages_beside_a_large_one(spark, docs_of):
    """However large another language is: texts of a language without a reference pass, others meet their own."""
    rng = random.Random(4)
    few = [" ".join("".join(rng.choices("ქართული", k=6)) for _ in range(60)) for _ in range(6)]
    own = [" ".join(rng.choices(["zzz", "yyy", "xxx", "www", "vvv"], k=100)) for _ in range(12)]
    docs = docs_of(dict(enumerate(prose(rng, 400))) | dict(enumerate(few, 1000)) | dict(enumerate(own, 2000)) | {3000: own[0]})
    lang = F.when(F.col("doc_id").between(1000, 1999), "ka").when(F.col("doc_id").between(2000, 2999), F.lit(None)).otherwise("en")
    docs = docs.withColumn("lang", lang)
    want = None
    for parts in (1, 50):
        refs = divergence.references(docs.repartition(parts), most=500)
        assert sorted(r["key"] for r in refs.collect()) == ["", "=en"]
        got = {r["doc_id"]: (r["kept"], r["base_failed"], r["js_chars"], r["js_words"]) for r in divergence.judge(docs, refs).collect()}
        assert want is None or got == want
        want = got
    assert all(got[i][0] and got[i][2] is None for i in range(1000, 1006))
    assert sum(got[i][0] for i in range(400)) == 400 and not got[3000][0]
    assert all(got[i][0] or got[i][1] for i in range(2000, 2012)) and got[2000][2] is not None


def test_references_equal_plain_ones(spark, docs_of):
    import json
    import statistics

    rng = random.Random(6)
    texts = [t + "." * rng.randint(0, 9) + "A1#" * rng.randint(0, 3) for t in prose(rng, 31, 60)]
    ref = json.loads(divergence.references(docs_of(texts)).first()["ref"])
    counts = [divergence.class_counts(t).tolist() for t in texts]
    cells = [statistics.median_low([math.floor(c[i] / len(t) * divergence.GRID + 0.5) for c, t in zip(counts, texts, strict=True)]) for i in range(7)]
    assert ref["chars"] == [c / sum(cells) for c in cells]
    seen = Counter(w for t in texts for w in divergence.tokens(t))
    top = sorted(sorted(seen, key=lambda w: (-seen[w], w))[:64])
    assert ref["words"] == top and ref["shares"] == [seen[w] / sum(seen.values()) for w in top]
