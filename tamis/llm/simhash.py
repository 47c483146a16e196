"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints that differ in at most four of 64 bits differ in at most one bit of one of
three segments. So each fingerprint is indexed under every segment with one bit left out
(64 keys), and an equality join on these keys meets every pair in question; the whole
fingerprints are then compared. A pair is accepted under the first key that shows it, once.

The join is a sorted pass: rows of one key lie together, and a task compares them in arrays
and gives back a forest that links what it found, never all pairs of a bucket. Buckets grow
with the table. One of more than ``block`` fingerprints isn't compared as it is: of five
parts of the bits outside the segment at least one is equal for every pair in question, so
its members are dealt to smaller buckets by each of these parts in turn. Only what is too
large even then (fingerprints that hardly differ) is cut into blocks, and each pair of blocks
is a group of its own, so no task holds more than two blocks.

Rows with one fingerprint are one vertex throughout. Components are found by rounds of
alternating star contractions over tables in the shared folder; nothing of the graph comes
to the driver but whether another round is needed. Joins on a fingerprint, a
vertex or a component deal each one's rows to up to 64 tasks. Texts are read whole, however long;
a fingerprint is summed up in parts of bounded memory.

Defined results: null text counts as empty, no words gives fingerprint zero, which links
like any other; repeated rows share a component; a null id is never the smallest one unless
a component has no other; an empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._shared import spread_join, text_or_empty, without, written

WIDTH = 4
SEED = 42
MOST = 4
#: Lowest bit and width of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Parts, and bits of each, that the bits outside a segment are cut into; more parts than MOST, so one is equal.
PARTS, PART_BITS = MOST + 1, 9
#: A link (place is -1), or a member of a bucket that was too large, with its place in it.
_LINKS = "a long, b long, key long, member long, place long"


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """The 64-bit hash of every word shingle of a text, repeats included, as big-endian numbers; of few words one shingle."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, ">u8")
    joined, width = b" ".join(words), min(width, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]), ">u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits: a bit is set if it is in more than half of the hashes; zero without any."""
    if not len(hashes):
        return 0
    octets, ones = hashes.view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for i in range(0, len(octets), 65536):
        ones += np.unpackbits(octets[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(octets)).tobytes(), "big", signed=True)


def fingerprint(text: str, width: int = WIDTH) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash that tells rows of one id apart) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "text_key"]].assign(fp=np.array([fingerprint(t) for t in b["text"]], dtype=np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, text_key long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """key and fp: every fingerprint under all of its 64 one-bit deletions of a segment.

    A key packs the number of the left-out bit above the segment's other bits.
    """
    rows = []
    for low, width in SEGMENTS:
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for k in range(width):
            rows.append(part.bitwiseAND(F.lit(~(1 << k))).bitwiseOR(F.lit((low + k) << 32)))
    return fps.select(F.explode(F.array(*rows)).alias("key"), "fp")


def smaller(large: DataFrame) -> DataFrame:
    """key and fp: members (key, member) of large buckets, once for each part of the bits outside their segment."""
    bit, fp, outside = F.shiftright("key", 32), F.col("member"), F
    for low, width in SEGMENTS:
        above = F.shiftleft(F.shiftrightunsigned(fp, low + width), low) if low + width < 64 else F.lit(0).cast("long")
        outside = outside.when((bit >= low) & (bit < low + width), above.bitwiseOR(fp.bitwiseAND(F.lit((1 << low) - 1))))
    part = lambda j: F.shiftrightunsigned("outside", PART_BITS * j).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    cut = large.select("key", "member", outside.alias("outside"))
    return cut.select(F.explode(F.array(*[F.xxhash64("key", F.lit(j), part(j)) for j in range(PARTS)])).alias("key"), F.col("member").alias("fp"))


def _near(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST


def _accepted(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a and b link, and this key is the first that shows it."""
    diff = a ^ b
    ok = np.bitwise_count(diff) <= MOST
    bit = key >> np.int64(32)
    done = np.zeros(len(a), dtype=bool)  # shown by an earlier segment
    first = np.zeros(len(a), dtype=bool)
    for low, width in SEGMENTS:
        part = (diff >> np.uint64(low)) & np.uint64((1 << width) - 1)
        near = np.bitwise_count(part) <= 1
        own = (bit >= low) & (bit < low + width)
        k = (bit - low).clip(0, 63).astype(np.uint64)
        first |= own & near & ~done & ((part == np.uint64(1) << k) | ((part == 0) & (k == 0)))
        done |= near
    return ok & first


def _links(key: np.ndarray, fp: np.ndarray, accepted) -> tuple[np.ndarray, np.ndarray]:
    """Accepted pairs among rows sorted by key, as places; all rows are compared at one distance after another."""
    at, found = np.arange(len(key)), []
    u = fp.view(np.uint64)
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        ok = at[accepted(u[at], u[at + step], key[at])]
        if len(ok):
            found.append((ok, ok + step))
        step += 1
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Fewest links that connect the same fingerprints: each member with the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(root(x), x) for x in list(parent)]
    out = pd.DataFrame([(p, x) for p, x in pairs if p != x], columns=["a", "b"], dtype=np.int64)
    return out.assign(key=np.int64(0), member=np.int64(0), place=np.int64(-1))


def _meet(block: int, accepted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, large, place = pd.DataFrame({"key": pd.Series(dtype=np.int64), "fp": pd.Series(dtype=np.int64)}), None, 0

        def put_off(rows):
            nonlocal place
            n = len(rows)
            out = pd.DataFrame({"a": np.int64(0), "b": np.int64(0), "key": rows["key"].to_numpy(), "member": rows["fp"].to_numpy(), "place": np.arange(place, place + n)})
            place += n
            return out

        def compare(rows):
            key, fp = rows["key"].to_numpy(), rows["fp"].to_numpy()
            a, b = _links(key, fp, accepted)
            return _forest(fp[a], fp[b])

        for b in batches:
            held = pd.concat([held, b[["key", "fp"]]], ignore_index=True) if len(held) else b[["key", "fp"]]
            if large is not None:  # the rest of a bucket that was too large
                more = held["key"] == large
                yield put_off(held[more])
                held = held[~more].reset_index(drop=True)
                if len(held):
                    large, place = None, 0
            if not len(held):
                continue
            sizes = held.groupby("key", sort=False).size()
            last = held["key"].iloc[-1]
            for k in sizes.index[(sizes > block).to_numpy()]:
                place = 0
                yield put_off(held[held["key"] == k])
                large = k if k == last else None
            held = held[~held["key"].isin(sizes.index[(sizes > block).to_numpy()])]
            whole = held[held["key"] != last]
            yield compare(whole)
            held = held[held["key"] == last].reset_index(drop=True)
        if len(held):
            yield compare(held)

    return run


def _meet_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """One group: a block of a bucket, or two blocks of which each is compared with the other."""
    fp, block = rows["member"].to_numpy(), rows["i"].to_numpy()
    one, other = fp[block == block.min()], fp[block != block.min()]
    a, b = [fp[:0]], [fp[:0]]
    for i, x in enumerate(one):
        rest = other if len(other) else one[i + 1 :]
        found = rest[np.bitwise_count((x ^ rest).view(np.uint64)) <= MOST]
        a.append(np.full(len(found), x))
        b.append(found)
    return _forest(np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame, *, block: int = 8192) -> DataFrame:
    """a and b of links that connect exactly the fingerprints within MOST bits of each other."""
    meet = lambda keyed, accepted, name: written(keyed.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInPandas(_meet(block, accepted), _LINKS), name)
    met = meet(variants(fps), _accepted, "simhash-links")
    more = meet(smaller(met.where("place >= 0")), _near, "simhash-smaller")
    large = more.where("place >= 0")
    size = large.groupBy("key").agg(F.max("place").alias("last"))
    of = lambda place: F.floor(F.col(place) / block).cast("int")
    blocks = spread_join(large.select("key", "member", "place"), size, "key", F.col("place")).select("key", "member", of("place").alias("i"), of("last").alias("n"))
    pairs = blocks.select("key", "member", "i", F.explode(F.transform(F.sequence(F.lit(0), F.col("n")), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))).alias("p"))
    last = pairs.select("key", "member", "i", "p.lo", "p.hi").groupBy("key", "lo", "hi").applyInPandas(_meet_blocks, _LINKS)
    found = [x.where("place < 0").select("a", "b") for x in (met, more)]
    return found[0].unionByName(found[1]).unionByName(last.select("a", "b"))


def near_duplicates(docs: DataFrame, *, block: int = 8192) -> DataFrame:
    """doc_id, text_key, fp and component_id of every row."""
    rows = written(fingerprints(docs), "simhash-fps")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-vertices")
    roots = components(links(fps.select("fp"), block=block))
    known = written(fps.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    first = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = spread_join(known, first, "root", F.col("fp")).select("fp", "component_id")
    return spread_join(rows, of, "fp", F.struct("doc_id", "text_key")).select("doc_id", "text_key", "fp", "component_id")


def representatives(docs: DataFrame, *, block: int = 8192) -> DataFrame:
    """The rows of docs, columns and all, whose id is the smallest of their component; of rows alike in id and text one."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    drop = near_duplicates(docs, block=block).groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    return without(docs, written(drop.where("n > 1 or not stays").select("id", "text_key", "stays"), "simhash-drop"))
