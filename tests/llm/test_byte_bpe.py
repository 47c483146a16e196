import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import byte_bpe

from odd_texts import ODD

PATH = public_tokenizers.path(byte_bpe.RANKS)


def whole(text):
    """Ids by the library, pre-token by pre-token."""
    enc = byte_bpe.encoding(PATH)
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc._core_bpe.encode_single_piece(m.encode())]


def ids(binary):
    return np.frombuffer(binary, dtype="<u4").tolist()


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 512), (40, 12), (7, 4)])
def test_equals_the_library_and_decodes(spark, docs_of, chunk, overlap):
    texts = [t if chunk > 100 else (t or "")[:400] for t in ODD]
    made = byte_bpe.encode(docs_of(texts, extra=True), PATH, chunk=chunk, overlap=overlap)
    got = {r["doc_id"]: r for r in byte_bpe.decode(made, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert ids(got[i]["ids"]) == whole(t or "")
        assert got[i]["n_tokens"] == len(ids(got[i]["ids"]))
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_repeated_rows_and_empty_table(spark, docs_of):
    long = "many words here " * 40
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "x")], "doc_id long, text string")
    got = byte_bpe.encode(df, PATH, chunk=64, overlap=16).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], ids(r["ids"]) == whole(long)) for r in got if r["doc_id"] is not None) == [(False, 1, True), (False, 1, True), (False, 2, False)]
    assert sum(r["doc_id"] is None for r in got) == 1
    assert byte_bpe.encode(df.limit(0), PATH).count() == 0


def test_digest_columns(spark, sf_dir):
    from tamis.llm.queries import op2_byte_bpe

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_byte_bpe(spark, sf_dir).collect():
        known = np.asarray(byte_bpe.encoding(PATH).encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert r["ids_sha256"] == hashlib.sha256(known.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(known)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n'aé1re.", max_size=80), st.integers(0, 30))
def test_a_shared_boundary_is_one_of_the_whole_text(text, start):
    start = min(start, len(text))
    ends, e = set(), 0
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        e = m.end()
        ends.add(e)
    assert set(byte_bpe.boundaries(text[start:], 0, len(text))) <= {e - start for e in ends}
