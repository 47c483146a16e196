"""Sum-of-squares packing of token sequences into fixed windows.

Each task packs the documents of its partition as they come. Whole windows are cut off a
long document; what remains of it goes, as one piece, to the fill level for which the sum
over all levels of the squared number of windows at that level becomes least (a new window
counts as level 0). The levels are one array of window counts, so a piece costs one pass
over the array, not over the windows.

Windows that are still open when a partition ends are few, but many in proportion where
partitions are small. So their pieces are packed again by the same rule, those of sixteen
tasks together, and what is left of these by sixteens again, until one group is left. Only
there the emptiest windows are dissolved, one by one, until one is left: their pieces are
placed by the same rule, but may be cut where they fill a window. The last window is cut at
powers of two, which need no padding. The column ``moved`` marks ids that were placed so.

A task holds at most ``most_open`` windows; beyond that it dissolves half of them. All
levels are written to the shared folder, so a lost executor costs its own tasks only.

Defined results: a null text counts as empty and still has its end id; repeated rows are
packed as often as they occur; an empty table gives no pieces; other columns are not looked
at; texts of any length and any run of white space have the ids of the tokenizers library.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, text_or_empty, written
from .byte_bpe import encode_text

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, moved boolean"
#: As SCHEMA, but a piece of an open window has its ids and the group that packs it again.
_LEVEL = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("moved", pa.bool_()), ("block", pa.int64()), ("ids", pa.binary())]
)
_LEVEL_SQL = SCHEMA + ", block long, ids binary"
#: Tasks whose open windows are packed together in the next round.
FAN_IN = 16
#: Bits of a sequence id that count windows within a task, and tasks within a round.
WINDOW_BITS, TASK_BITS = 32, 24
#: A space at which the pre-token before it may not have ended, or a text that ends in white space.
_SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f"^ |{_SPACE} |{_SPACE}$"


class WordEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Before a space that follows other than white space every pre-token ends. So the texts of
    a batch are split at such spaces, and each distinct word is encoded once, with the space
    before it: all of them as one text, whose ids fall apart at the words' ends.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(token) for token in ranks]

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(encode_text(self.encoding, text), dtype="<u4")

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        for token, i in self.special.items():
            if token in text:
                return np.uint32(i).astype("<u4").tobytes().join(self.encode(part) for part in text.split(token))
        return self._plain(text).tobytes()

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of each word, with a space before it."""
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        ids = self._plain(" " + pc.binary_join(whole, " ")[0].as_py())
        ends = np.cumsum(self.size[ids])
        last = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        begin = np.concatenate([[0], np.searchsorted(ends, last) + 1]) * 4
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(begin.astype("<i8")), pa.py_buffer(ids)])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts, as encode gives them."""
        safe = pc.invert(pc.match_substring_regex(texts, _UNSAFE))
        for token in self.special:
            safe = pc.and_not(safe, pc.match_substring(texts, token))
        safe = safe.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(~safe).tolist():
            out[i] = self.encode(texts[i].as_py())
        places = np.flatnonzero(safe)
        if not len(places):
            return out
        split = pc.split_pattern(texts.take(pa.array(places)), " ")
        begin = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        at, data = np.frombuffer(ids.buffers()[1], "<i8"), memoryview(ids.buffers()[2])
        # A text's first word has no space before it.
        first = words.dictionary.take(words.indices.take(pa.array(begin[:-1]))).to_pylist()
        for k, (i, word) in enumerate(zip(places.tolist(), first, strict=True)):
            out[i] = self._plain(word).tobytes() + data[at[begin[k] + 1] : at[begin[k + 1]]].tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Piece(NamedTuple):
    """Some ids of a document: which, from where on, of how many, whether a dissolved window gave them."""

    doc: object
    start: int
    total: int
    ids: bytes
    moved: bool = False

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


class SumOfSquares:
    """Open windows of a capacity by fill level; every method gives the windows that it fills."""

    def __init__(self, capacity: int, most_open: int = 4096):
        self.capacity, self.most_open = capacity, most_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # count[h]: open windows filled to h
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def _take(self, h: int) -> list[Piece]:
        self.count[h] -= 1
        self.windows -= 1
        return self.open[h].pop()

    def _keep(self, window: list[Piece], h: int) -> None:
        self.open[h].append(window)
        self.count[h] += 1
        self.windows += 1

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece of at most the capacity, uncut."""
        c, cap, size = self.count, self.capacity, piece.size
        if size == cap:
            yield [piece]
            return
        # Change of the sum of squares when level h loses a window and level h + size gains one.
        change = 2 * (c[size:] - c[: cap - size + 1]) + 2
        change[c[: cap - size + 1] == 0] = np.iinfo(np.int64).max
        if c[cap - size]:
            change[-1] = 1 - 2 * c[cap - size]  # a full window is no level
        change[0] = 2 * c[size] + 1
        h = cap - size - int(np.argmin(change[::-1]))  # of equals, the fullest
        window = self._take(h) if h else []
        window.append(piece)
        if h + size == cap:
            yield window
            return
        self._keep(window, h + size)
        if self.windows > self.most_open:
            yield from self.dissolve(self.most_open // 2)

    def dissolve(self, left: int) -> Iterator[list[Piece]]:
        """Take the emptiest windows apart until so many are left; their pieces may be cut where they fill a window."""
        c, cap = self.count, self.capacity
        while self.windows > left:
            for piece in self._take(int(np.flatnonzero(c)[0])):
                rest = piece._replace(moved=True)
                while rest is not None:
                    levels, size = np.flatnonzero(c), rest.size
                    if not len(levels):
                        self._keep([rest], size)
                        break
                    change = np.where(levels + size < cap, 2 * (c[np.minimum(levels + size, cap)] - c[levels]) + 2, 1 - 2 * c[levels])
                    h = int(levels[len(levels) - 1 - np.argmin(change[::-1])])
                    window = self._take(h)
                    if h + size < cap:
                        self._keep([*window, rest], h + size)
                        break
                    head, tail = rest.cut(cap - h)
                    yield [*window, head]
                    rest = tail if tail.ids else None

    def rest(self) -> Iterator[list[Piece]]:
        """The open windows, the fullest first."""
        for level in reversed(self.open):
            yield from level

    def close(self) -> Iterator[list[Piece]]:
        """All that is left: full windows, and one cut at powers of two."""
        yield from self.dissolve(1)
        for window in self.rest():
            used = sum(p.size for p in window)
            while used:
                need = 1 << (used.bit_length() - 1)
                used, part = used - need, []
                while need:
                    head, tail = window.pop(0).cut(need)
                    part.append(head)
                    need -= head.size
                    if tail.ids:
                        window.insert(0, tail)
                yield part


class _Rows:
    """Rows of a level, given out as record batches."""

    def __init__(self, base: int):
        self.next, self.rows = base, []

    def add(self, window: list[Piece], block: int | None = None) -> None:
        offset = 0
        for p in window:
            held = block is not None
            self.rows.append((p.doc, p.start, p.size, None if held else zlib.crc32(p.ids), p.total, self.next, offset, p.moved, block, p.ids if held else None))
            offset += p.size
        self.next += 1

    def batches(self, least: int = 5000) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            columns = list(zip(*self.rows, strict=True))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _LEVEL, strict=True)], schema=_LEVEL)


def _parts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one have about so many bytes."""
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)) // most
        edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                yield b.slice(a, z - a)


def _first(path: str, capacity: int, end_id: int, most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.uint32(end_id).astype("<u4").tobytes()
        task = TaskContext.get().partitionId()
        packer, rows = SumOfSquares(capacity, most_open), _Rows(task << WINDOW_BITS)
        for b in _parts(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode_all(b.column("text")), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    for window in packer.put(Piece(doc, start, total, ids[4 * start : 4 * (start + capacity)])):
                        rows.add(window)
            yield from rows.batches()
            pa.default_memory_pool().release_unused()
        for window in packer.rest():
            rows.add(window, task // FAN_IN)
            yield from rows.batches(500)
        yield from rows.batches(1)

    return run


def _again(capacity: int, most_open: int, level: int, last: bool):
    """Pack the pieces of one block after another, which come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, block = None, None, None

        def finish():
            for window in packer.close() if last else packer.rest():
                rows.add(window, None if last else block // FAN_IN)
                yield from rows.batches(500)
            yield from rows.batches(1)

        for b in batches:
            for own, doc, start, total, moved, ids in zip(*(b.column(k).to_pylist() for k in ("block", "doc_id", "start", "doc_tokens", "moved", "ids")), strict=True):
                if own != block:
                    if packer:
                        yield from finish()
                    block, packer, rows = own, SumOfSquares(capacity, most_open), _Rows(((level << TASK_BITS) + own) << WINDOW_BITS)
                for window in packer.put(Piece(doc, start, total, ids, moved)):
                    rows.add(window)
            yield from rows.batches(500)
        if packer:
            yield from finish()

    return run


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 1, most_open: int = 4096) -> DataFrame:
    """One row per piece of a document; pieces of one sequence_id make up a training sequence."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    with small_batches(docs.sparkSession, 1000):
        level = written(texts.mapInArrow(_first(path, capacity, end_id, most_open), _LEVEL_SQL), "packed-0")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    packed, number = level.where("ids is null").select(columns), 0
    while True:
        left = level.where("ids is not null")
        top = left.agg(F.max("block")).first()[0]
        if top is None:
            return packed
        number += 1
        sorted_left = left.repartition("block").sortWithinPartitions("block", "sequence_id", "offset")
        with small_batches(docs.sparkSession, 1000):
            level = written(sorted_left.mapInArrow(_again(capacity, most_open, number, top == 0), _LEVEL_SQL), f"packed-{number}")
        packed = packed.unionByName(level.where("ids is null").select(columns))
