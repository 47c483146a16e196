import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import periodic

from odd_texts import ODD


def maximal(words, q):
    """(start, length) of all maximal stretches of period q."""
    i = 0
    while i + q < len(words):
        s = i
        while i + q < len(words) and words[i] == words[i + q]:
            i += 1
        if i > s:
            yield s, i + q - s
        else:
            i += 1


def plain_runs(words):
    """Every period in turn, a multiple of a smaller period of the same stretch left out."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        for s, n in maximal(words, q):
            part = words[s : s + n]
            if n >= max(6, 4 * q) and not any(all(part[i] == part[i + r] for i in range(n - r)) for r in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 9), st.integers(0, 30))
def test_automaton_equals_every_period(head, period, repeats):
    words = head + (head[:period] * repeats)[:60]
    got = sorted(((s, n, q) for (s, q), n in periodic.runs_of(words).items()), key=lambda r: (r[0], r[2]))
    assert got == plain_runs(words)
    assert periodic.text_runs([b"%d" % w for w in words]) == got


def test_stretches_keep_runs_whole():
    rng = random.Random(5)
    for _ in range(40):
        words = [rng.randrange(400) for _ in range(300)]
        for _ in range(rng.randrange(4)):
            at, q, n = rng.randrange(250), rng.randint(1, 12), rng.randint(4, 60)
            words[at : at + n] = [words[at + i % q] for i in range(n)][: len(words[at : at + n])]
        text = [b"%d" % w for w in words]
        assert periodic.text_runs(text) == plain_runs(words)


@pytest.mark.parametrize("words", [[1] * 40_000, [i % 9 for i in range(20_000)], [i % 4000 for i in range(20_000)]])
def test_long_runs(words):
    period = max(words) + 1 if len(set(words)) > 1 else 1
    assert periodic.runs_of(words) == {(0, period): len(words)}


def test_odd_rows(spark, docs_of):
    texts = [*ODD, "a b " * 9, "x " + "p q r " * 5 + "p q y", "a a a a a", "a a a a a a", "é b é b é b é b", "a b c a b c a b c a b", ("u v " * 6 + "w ") * 5]
    small = [t if t is None or len(t) < 5000 else t[:3000] for t in texts]
    for docs in (docs_of(small, extra=True), docs_of(small).repartition(3)):
        got = {r["doc_id"]: r for r in periodic.digests(docs).collect()}
        assert {i: tuple(got[i][c] for c in FIELDS) for i in got} == {i: plain(i, t) for i, t in enumerate(small)}
    assert periodic.digests(docs_of(ODD)).count() == len(ODD)
    assert periodic.digests(docs_of(texts).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b " * 20), (7, "a b " * 20), (7, "a b " * 20), (None, None)], "doc_id long, text string")
    got = periodic.digests(rows).collect()
    assert len(got) == 4 and [r["n_runs"] for r in sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_runs"]))] == [0, 1, 1, 1]


def test_general_output(spark, docs_of):
    got = {r["doc_id"]: r for r in periodic.periodic_runs(docs_of(["z a b a b a b a b y", "no run here", None]), rewrite=None).collect()}
    assert [r.asDict() for r in got[0]["runs"]] == [{"start": 1, "length": 8, "period": 2}]
    assert bytes(got[0]["collapsed"]) == b"z a b y" and got[1]["runs"] == [] and bytes(got[2]["collapsed"]) == b""


def test_query_equals_plain(spark, sf_dir):
    from tamis.llm.queries import op12_periodic_runs

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == set(texts) and sum(r["n_runs"] for r in got.values()) > 10
    for i, t in texts.items():
        if len(t or "") < 6000:
            assert tuple(got[i][c] for c in FIELDS) == plain(i, t), i
