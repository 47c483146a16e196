import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tamis.llm import lexical

from odd_texts import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k):
    """Every document scored for every item."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    many, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out, asked = {}, {}
    for item, text in items:
        if item is not None and text is not None:
            asked.setdefault(item, set()).update(split(text))
    for item, terms in asked.items():
        scored = []
        for (i, c), n in zip(counts, lengths, strict=True):
            m = 100 - 50 + (50 * n * many) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out[item] = [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return {k: v for k, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


def made_up(rng, n=900):
    topics = [["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(40)] for _ in range(8)]
    common = ["the", "of", "and", "to"]
    texts = [" ".join(rng.choices([*rng.choice(topics), *common * 4], k=rng.randint(1, 60))) for _ in range(n)]
    texts += [texts[3]] * 60  # ties
    items = [(i, " ".join(rng.choices(rng.choice(topics), k=6) + common)) for i in range(12)] + [(90, "unheard word"), (91, None), (92, ""), (None, "the"), (3, "the more")]
    return texts, items


@pytest.mark.parametrize("segment,block,queries", [(4096, 64, 2000), (100, 4, 2000), (300, 16, 3)])
def test_equals_scoring_all(spark, docs_of, segment, block, queries):
    texts, items = made_up(random.Random(4))
    docs = docs_of(texts, extra=True).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (5, 50):
        found = lexical.search(docs, asked, k=k, segment=segment, block=block, queries=queries, sample=2)
        assert got(found) == plain(list(enumerate(texts)), items, k)


def test_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(3)
    terms, n = 400, 3000
    of = rng.integers(0, 20, n)
    # A tenth of the documents hold 378 and 379, the others one of them.
    both = [[378, 379] if t < 2 else [378 + t % 2] for t in of]
    ids = [np.unique(np.concatenate([rng.integers(0, 18, 10) + 18 * t, rng.integers(380, 400, 5), b])) for t, b in zip(of, both, strict=True)]
    size = np.array(list(map(len, ids)))
    term, count = np.concatenate(ids), rng.integers(1, 4, size.sum())
    length = np.array([int(c.sum()) + 30 for c in np.split(count, np.cumsum(size)[:-1])])
    w = lexical.Weights.of(n, int(length.sum()), np.bincount(term, minlength=terms))
    arrays = lexical.build(list(range(n)), length, term, count, size, w, 16)
    s = lexical.Segment({k: np.ascontiguousarray(arrays[k], kind).tobytes() for k, kind in lexical._KINDS.items()}, w)
    for t in range(20):
        asked = np.unique(np.append(rng.integers(0, 18, 6) + 18 * t, [380, 385]))
        s.worth[asked] = w.weight[asked]
        exact = s.scores(np.arange(n))
        for b in range(len(s.block_at) - 1):
            bound = s.summaries[b, w.coordinate[asked]].astype(np.int64).sum() * s.unit
            assert bound >= exact[s.places[s.block_at[b] : s.block_at[b + 1]]].max()
        s.worth[:] = 0
        places, score = s.search(asked, 10, 0)
        assert sorted(score.tolist())[-10:] == sorted(exact.tolist())[-10:] and (exact[places] == score).all()
    s.looked = s.skipped = 0
    s.search(np.array([378, 379]), 10, 0)
    assert s.skipped > 3 * s.looked


def test_odd_rows(spark, docs_of):
    items = [(1, "A b word"), (2, "éè text"), (3, "endoftext 12"), (4, "tail the x")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.search(docs_of(ODD, extra=True), asked)) == plain(list(enumerate(ODD)), items, 50)
    rows = [(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (2, "a b"), (1, None), (9, "c")]
    found = lexical.search(spark.createDataFrame(rows, "doc_id long, text string"), asked, k=4)
    assert got(found) == plain(rows, items, 4)
    assert lexical.search(docs_of(ODD).limit(0), asked).count() == 0
    assert lexical.search(docs_of(ODD), asked.limit(0)).count() == 0
    assert lexical.search(docs_of([None, "", "!"]), asked).count() == 0


def test_query_equals_plain(spark, sf_dir):
    from tamis.llm.queries import op11_lexical_search

    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    assert got(op11_lexical_search(spark, sf_dir)) == plain(read("documents", "doc_id"), read("benchmark", "item_id"), 50)
