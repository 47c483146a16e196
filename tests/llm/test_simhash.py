import random

import numpy as np
import pytest
import xxhash

from tamis.llm import simhash

from odd_texts import ODD


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps, most=4):
    """Smallest fingerprint of each one's component, by comparing all pairs."""
    fps = sorted(set(fps))
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    root = dict(zip(fps, fps, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[:i]) <= most):
            a, b = find(fps[i]), find(fps[j])
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") % (1 << 64) == plain(text or "")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [8192, 20, 3])
def test_components_equal_all_pairs(spark, block):
    rng = random.Random(5)
    fps = [0, signed((1 << 64) - 1)]
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(signed(x))
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
    for _ in range(40):  # a dense group
        fps.append(signed(sum(1 << b for b in rng.sample(range(20), 2))))
    edges = simhash.links(spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long"), block=block)
    found = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    want = plain_roots(fps)
    assert {x: found.get(x, x) for x in set(fps)} == want


def test_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_duplicates(spark, docs_of, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    fps = {i: signed(plain(t)) for i, t in texts.items()}
    root = plain_roots(fps.values())
    least = {}
    for i, x in fps.items():
        least[root[x]] = min(i, least.get(root[x], i))
    for r in rows:
        assert r["fp"] == fps[r["doc_id"]] and r["component_id"] == least[root[r["fp"]]]


def test_smaller_buckets_lose_no_link(spark):
    """Members of one bucket that are near enough share a part of the bits outside its segment."""
    rng = random.Random(8)
    rows = []
    for n, (low, width) in enumerate(simhash.SEGMENTS):
        x = rng.getrandbits(64)
        outside = [b for b in range(64) if not low <= b < low + width]
        for _ in range(60):
            y = x
            for b in rng.sample(outside, 4):
                y ^= 1 << b
            rows += [(n, (low << 32), signed(x)), (n, (low << 32), signed(y))]
            x = y
    df = spark.createDataFrame(rows, "n int, key long, member long")
    dealt = {}
    for r in simhash.smaller(df.select("key", "member")).collect():
        dealt.setdefault(r["fp"], set()).add(r["key"])
    assert all(len(keys) == simhash.PARTS for keys in dealt.values())
    for (_, _, a), (_, _, b) in zip(rows[::2], rows[1::2], strict=True):
        assert dealt[a] & dealt[b]


def test_one_giant_component(spark, docs_of):
    """A star, a clique of copies and rows alike in id and text; hot keys are dealt to many tasks."""
    star = spark.createDataFrame([(5, i) for i in range(6, 3000)] + [(i, i + 1) for i in range(5000, 5040)], "a long, b long")
    got = {r["v"]: r["root"] for r in simhash.components(star).collect()}
    assert {got[i] for i in range(5, 3000)} == {5} and {got[i] for i in range(5000, 5041)} == {5000}
    rows = [(i, "one hot text of words") for i in range(50, 1500)] + [(7, "one hot text of words")] * 3 + [(3, "another text altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).groupBy("component_id").count().collect()
    assert sorted(map(tuple, got)) == [(3, 1), (7, 1453)]
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == [3, 7]


def test_odd_tables(spark, docs_of):
    docs = docs_of(ODD, extra=True)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["component_id"] for r in simhash.near_duplicates(docs).collect()})
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(nulls).collect()] == [3, 3, 3]
    assert simhash.near_duplicates(nulls.limit(0)).count() == 0
