import importlib
import random

import pytest
from pyspark.sql import functions as F

from tamis.llm import near_copies, simhash
from tamis.llm._shared import possible

from odd_texts import ODD


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    """The smallest id of each one's component, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if j < i and (sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def edited():
    """Texts with copies in which a few words are others, from near ones to ones under the bound, and chains of them."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for n in (8, 30, 120, 400):
        for _ in range(6):
            words = [word() for _ in range(n)]
            for _ in range(rng.randint(2, 6)):
                texts.append(" ".join(words))
                for _ in range(rng.randint(0, max(1, n // 25))):
                    words[rng.randrange(n)] = word()
    rng.shuffle(texts)
    return dict(enumerate([*texts, *ODD]))


@pytest.mark.parametrize("block", [16 << 20, 900])
def test_equals_all_pairs(spark, docs_of, edited, block):
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(edited), block=block).collect()}
    assert found == plain_components(edited)


def test_a_large_group_is_linked_directly(spark, docs_of, monkeypatch):
    """Of one group of many copies the most are linked with a band's leader; large parts meet small ones only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(300)] = word()
        texts.append(" ".join(words))
    seen = []
    further = near_copies.further_links

    def noted(band, *args):
        seen.append((band.select("v").distinct().count(), band.select("part").distinct().count()))
        return further(band, *args)

    monkeypatch.setattr(near_copies, "further_links", noted)
    for block in (16 << 20, 20_000):
        found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(dict(enumerate(texts))), block=block).collect()}
        assert found == plain_components(dict(enumerate(texts)))
    # Hardly more parts than there are components in the end.
    assert all(parts <= len(set(found.values())) + 5 for _, parts in seen), seen


def test_members_of_a_band_that_its_leader_leaves_apart(spark, docs_of):
    """A loose group: most pairs are under the bound, and links run through sets that aren't any band's leader."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(4):
        base = [word() for _ in range(200)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(200)] = word()
            texts.append(" ".join(words))
    for block in (16 << 20, 9_000):
        found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(dict(enumerate(texts))), block=block).collect()}
        assert found == plain_components(dict(enumerate(texts)))


def loose_group():
    """One group in which most pairs are under the bound."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, texts = [word() for _ in range(200)], []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(200)] = word()
        texts.append(" ".join(words))
    return dict(enumerate(texts))


def test_sets_are_written_once(spark, docs_of, monkeypatch):
    """A set isn't written once for each of its bands; only groups that compare it get it as often."""
    tables, write = [], near_copies.written

    def noted(df, name):
        tables.append((name, df.columns))
        return write(df, name)

    monkeypatch.setattr(near_copies, "written", noted)
    texts = loose_group()
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(texts), block=9_000).collect()}
    assert found == plain_components(texts)
    assert "near-parted" in [name for name, _ in tables]  # sets of open bands were compared
    assert [name for name, columns in tables if "hashes" in columns] == ["near-sets"]


def test_rows_that_may_have_a_partner(spark):
    rows = spark.range(50_000).withColumnRenamed("id", "key")
    keys = spark.range(0, 100_000, 100).withColumnRenamed("id", "other")
    for some in (keys, keys.limit(0)):
        want = {r["other"] for r in some.collect() if r["other"] < 50_000}
        got = [r["key"] for r in possible(rows, some, "key", "other").collect()]
        assert len(got) == len(set(got)) and want <= set(got) and len(got) < len(want) + 50
    assert possible(rows, rows, "key").count() == 50_000


def test_fingerprints_give_candidates_without_bands(spark, docs_of, monkeypatch):
    """Without bands the SimHash operator's components are compared; a set that only shares its fingerprint doesn't link."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(800)]
        for _ in range(3):
            texts.append(" ".join(words))
            words[rng.randrange(800)] = word()
    docs = docs_of(dict(enumerate(texts)))
    made = near_copies.vertices
    monkeypatch.setattr(near_copies, "vertices", lambda docs: made(docs).withColumn("bands", F.array("v")))
    fps = {i: simhash.majority(near_copies.shingle_set(t).astype(">u8")) for i, t in enumerate(texts)}
    near = {(i, j) for i in fps for j in fps if i < j and ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 4}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    assert len(near) >= 24 and all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in near)
    root = list(range(len(texts)))
    for i, j in sorted(near):
        root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert found == dict(enumerate(root))
    # All fingerprints alike: only the sets decide.
    monkeypatch.setattr(near_copies, "vertices", lambda docs: made(docs).withColumns({"bands": F.array("v"), "fp": F.lit(5).cast("long")}))
    for block in (16 << 20, 20_000):
        found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, block=block).collect()}
        assert found == plain_components(dict(enumerate(texts)))


def test_stage_takes_edited_copies(spark, docs_of, edited):
    docs = docs_of(edited, extra=True)
    kept = importlib.import_module("corpus_pipeline").near(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_components(edited).values()))


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, "a b c"), (None, "A b  c"), (3, "a b c"), (3, "a B c"), (None, "d")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in near_copies.representatives(rows).collect()) == ["3", "None"]
    assert near_copies.representatives(rows.limit(0)).count() == 0
