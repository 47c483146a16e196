import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamis.llm import packing

from odd_texts import LONG_RUNS, ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def known(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(PATH).encode_all(pa.array([t or "" for t in texts], pa.string()))]


def test_encoder_equals_the_library():
    assert encoded(ODD * 2) == [known(t) for t in ODD] * 2
    assert encoded([]) == [] and encoded([None]) == [[]]


@pytest.mark.parametrize("text", LONG_RUNS, ids=range(len(LONG_RUNS)))
def test_very_long_runs_of_white_space(text):
    assert encoded([text, "a b"]) == [known(text), known("a b")]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x0b\x1c\x85　'aé1re.<|endoftx>", max_size=40), max_size=5), st.integers(0, 5))
def test_encoder_on_any_texts(texts, at):
    texts = [*texts[:at], "<|endoftext|>".join(texts), *texts[at:]]
    assert encoded(texts) == [known(t) for t in texts]


def check(rows, lengths, capacity):
    """Each id of a document lies in one piece, sequences have no gaps; gives padding and ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, length, seq, offset in rows:
        by_doc[doc].append((start, length))
        by_seq[seq].append((offset, length))
    assert set(by_doc) == set(lengths)
    for pieces, end in ((sorted(p), lengths[d]) for d, p in by_doc.items()):
        at = 0
        for start, length in pieces:
            assert start == at and length > 0
            at += length
        assert at == end
    used = []
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        used.append(at)
    return sum(0 if u & (u - 1) == 0 else capacity - u for u in used), sum(used)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=120), st.integers(2, 100))
def test_any_lengths(lengths, most_open):
    packer, windows = packing.SumOfSquares(64, most_open), []
    for i, n in enumerate(lengths):
        for start in range(0, n, 64):
            windows += packer.put(packing.Piece(i, start, n, bytes(4 * min(64, n - start))))
            assert packer.windows == packer.count.sum() <= most_open and (packer.count == [len(x) for x in packer.open]).all()
    windows += packer.close()
    rows = []
    for s, window in enumerate(windows):
        at = 0
        for p in window:
            rows.append((p.doc, p.start, p.size, s, at))
            at += p.size
    assert check(rows, dict(enumerate(lengths)), 64) == (0, sum(lengths))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_least_sum_of_squares(sizes):
    """Each piece goes where a plain search over all levels says, or to a level as good."""
    packer = packing.SumOfSquares(32)
    for size in sizes:
        before = packer.count.copy()

        def total(h, size=size, before=before):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + size < 32:
                c[h + size] += 1
            return int((c[1:32] ** 2).sum())

        options = [total(h) for h in range(0, 33 - size) if h == 0 or before[h]]
        list(packer.put(packing.Piece(0, 0, size, bytes(4 * size))))
        assert int((packer.count[1:32] ** 2).sum()) == min(options)
        assert packer.count[32] == 0


@pytest.mark.parametrize(("partitions", "most_open"), [(1, 4096), (3, 3), (40, 4096)])
def test_pack(spark, docs_of, partitions, most_open):
    docs = docs_of(ODD * 3, extra=True).repartition(partitions)
    got = packing.pack(docs, PATH, capacity=256, most_open=most_open).collect()
    ids = {i: [*known(t), 1] for i, t in enumerate(ODD * 3)}
    padding, _ = check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], {i: len(x) for i, x in ids.items()}, 256)
    assert padding == 0
    for r in got:
        part = np.asarray(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])


def test_odd_tables(spark, docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0
    null_id = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = packing.pack(null_id, PATH, capacity=3).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None", "None"] and all(r["length"] == 3 for r in got)


def test_a_long_run_is_packed(spark, docs_of):
    got = packing.pack(docs_of({5: " " * 1_200_000 + "\n" * 800_000}), PATH).collect()
    assert sum(r["length"] for r in got) == got[0]["doc_tokens"] == len(known(" " * 1_200_000 + "\n" * 800_000)) + 1


@pytest.mark.parametrize("partitions", [1, 30])
def test_few_ids_are_moved(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    packed = packing.pack(docs, PATH, capacity=512)
    moved, every = packed.agg(F.sum(F.when(F.col("moved"), F.col("length")).otherwise(0)), F.sum("length")).first()
    assert moved < 0.05 * every


def test_query(spark, sf_dir):
    from tamis.llm.queries import op7_packing

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_packing(spark, sf_dir).collect()
    padding, used = check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], {i: len(known(t)) + 1 for i, t in texts.items()}, 2048)
    assert padding <= 0.01 * used
