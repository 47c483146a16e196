"""Byte-level BPE encoding with overlapping chunks, and decoding.

A text longer than a chunk is cut into overlapping chunks that different tasks pre-tokenise.
Two neighbours resynchronise at a boundary that both of them find in their overlap. Only
boundaries before white space are taken: there a pre-token ends whatever came before, so
both the piece before it and the piece after it can be encoded alone. Pieces are encoded in
parallel and put together in order. Neighbours without a common boundary (a run without
white space longer than the overlap) stay one piece. Shorter texts are one piece each and
are encoded where they are read, without a shuffle.

Decoding concatenates the bytes of all ids; it needs no text boundaries and can't fail on
split characters.

Defined results: a null text counts as empty; an empty text has no ids; rows repeated with
one id and text give as many rows; a null id is an id like any other; an empty table gives no
rows; very long texts are encoded whole; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty, written

RANKS = "byte_bpe_50k.tiktoken"
_PIECES = "doc_id long, key string, piece int, ids binary"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN):
    """The tokenizer of a rank file; each Python worker loads it once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc, text: str, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    """Ids of a text; where its pattern engine gives up on a very long run, each pre-token is encoded by itself."""
    try:
        return enc._core_bpe.encode_ordinary(text)
    except BaseException as e:  # the engine's own panic isn't an Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return [i for m in regex.finditer(pattern, text) for i in enc._core_bpe.encode_single_piece(m[0].encode())]


def boundaries(text: str, lo: int, hi: int, pattern: str = public_tokenizers.PATTERN, start: int = 0) -> list[int]:
    """Ends of pre-tokens in [lo, hi) that are followed by white space, when pre-tokenising starts at start."""
    out = []
    for m in regex.finditer(pattern, text, pos=start):
        e = m.end()
        if e >= min(hi, len(text)):
            break
        if e >= lo and text[e] in " \n\t\r" and not text[e - 1].isspace():
            out.append(e)
    return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in small parts, so that a worker holds the ids of few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _ids(enc, texts: pa.Array) -> pa.Array:
    return pa.array([np.asarray(encode_text(enc, t), dtype="<u4").tobytes() for t in texts.to_pylist()], pa.binary())


def _encode_column(path: str, text: str, *keep: str):
    """Columns to keep, and the ids of a text column."""

    def run(batches):
        enc = encoding(path)
        for b in _parts(batches):
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], _ids(enc, b.column(text))], names=[*keep, "ids"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for doc_id, key, text in zip(b["doc_id"], b["key"], b["text"], strict=True):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for i, s in enumerate(starts):
                    last = i == len(starts) - 1
                    yield pd.DataFrame({"doc_id": [doc_id], "key": [key], "chunk": [i], "start": [s], "body": [text[s:] if last else text[s : s + chunk + overlap]]})

    return run


def _ends(chunk: int, overlap: int):
    """Each chunk's boundaries in the overlaps with the chunk before and the chunk after, as places in the text."""

    def run(batches):
        for b in batches:
            head, tail = [], []
            for i, s, body in zip(b["chunk"], b["start"], b["body"], strict=True):
                # The last three characters are left out: a longer text could go on with the pre-tokens there.
                found = boundaries(body, 0, min(overlap, len(body) - 3)) if i else []
                head.append([int(s) + e for e in found])
                found = boundaries(body, chunk, len(body) - 3) if len(body) > chunk else []
                tail.append([int(s) + e for e in found])
            yield b.assign(head=head, tail=tail)

    return run


def encode(docs: DataFrame, path: str, *, chunk: int = 32768, overlap: int = 512) -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit) of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = F.char_length("text")
    short = texts.where(size <= chunk + overlap).mapInArrow(_encode_column(path, "text", "doc_id"), "doc_id long, ids binary")
    long = texts.where(size > chunk + overlap).withColumn("key", F.sha2("text", 256))
    copies = long.groupBy("doc_id", "key").agg(F.count("*").cast("int").alias("copies"), F.first("text").alias("text"))
    copies = written(copies, "bpe-long")
    chunks = copies.select("doc_id", "key", "text").mapInPandas(_cut(chunk, overlap), "doc_id long, key string, chunk int, start long, body string")
    parallel = chunks.repartition(F.col("key"), F.col("chunk"))
    ended = parallel.mapInPandas(_ends(chunk, overlap), "doc_id long, key string, chunk int, start long, body string, head array<long>, tail array<long>")
    pieces = stitch(ended).mapInArrow(_encode_column(path, "body", "doc_id", "key", "piece"), _PIECES)
    joined = pieces.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    ids = F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), ""))
    whole = joined.select("doc_id", "key", ids.alias("ids"))
    counted = whole.alias("w").join(copies.select("doc_id", "key", "copies").alias("c"), F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("w.key") == F.col("c.key")))
    whole = counted.select("w.doc_id", "w.ids", F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias("copy")).select("doc_id", "ids")
    return short.unionByName(whole).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def stitch(ended: DataFrame) -> DataFrame:
    """Pieces (doc_id, key, piece, body) from chunks with the boundaries in their overlaps.

    A chunk's piece runs from the boundary shared with the chunk before to the one shared
    with the chunk after. A chunk that shares none with its predecessor is appended to the
    predecessor's piece.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "key").orderBy("chunk")
    met = F.array_min(F.array_intersect(F.lag("tail").over(w), F.col("head")))
    cut = ended.withColumn("from", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(met))
    cut = cut.withColumn("piece", F.sum(F.col("from").isNotNull().cast("int")).over(w) - 1)
    cut = cut.withColumn("to", F.lead("from").over(w)).withColumn("next", F.lead("start").over(w))
    start = F.coalesce("from", "start")
    # Up to the shared boundary; to the next chunk's start if there is none; to the end in the last chunk.
    stop = F.coalesce(F.col("to"), F.col("next"), F.col("start") + F.char_length("body"))
    part = F.substring(F.col("body"), (start - F.col("start") + 1).cast("int"), (stop - start).cast("int"))
    parts = cut.select("doc_id", "key", F.col("piece").cast("int").alias("piece"), "chunk", part.alias("part"))
    grouped = parts.groupBy("doc_id", "key", "piece").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("p"))
    return grouped.select("doc_id", "key", "piece", F.array_join(F.transform("p", lambda p: p["part"]), "").alias("body"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the bytes of the column ids."""

    def run(batches):
        enc = encoding(path)
        for b in _parts(batches):
            decoded = [enc._core_bpe.decode_bytes(np.frombuffer(i, dtype="<u4").tolist()) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
