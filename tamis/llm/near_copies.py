"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates are, first, sets whose fingerprints lie in one component of the SimHash operator: its
deletion-variant index, at four bits, over fingerprints of the sets. That radius reaches few pairs at
the bound (they differ in up to 13 bits, which three to seven segments can't index), so sets that
share one of 50 bands of seven min-hashes are candidates too; a pair at the bound shares none with a
chance of (1 - 0.8^7)^50, one in 130,000, and pairs under 0.3 seldom share one. A component of
fingerprints is treated as one more band throughout. A band links its members to a leader, the one whose bands
others share most, so candidates are as many as members. The sets of these pairs are compared first, and those that reach the
bound link: most members of a group of copies, in work that is in proportion to the group. Where
the other members of a band then still lie in different parts, they are compared with each other, those of
one part aside, so no pair is lost that shares a band; nothing else is compared, however large the
components grow. Bands with the same members count once. The sets of such a band are cut into blocks of about
``block`` bytes, a part that fills a block into its own ones, and each pair of blocks is a
group of its own, but for two blocks of one such part. No task holds more than two. Blocks are laid
out by the sizes of sets; the hashes join last, on their way to their groups.

Rows with one set are one vertex throughout. Sets hold 64-bit hashes of shingles, and are
computed again from the texts of candidates alone; a bitmap keeps most other texts, and most bands of
one member, out of the shuffles. Joins on a band, a component or a set deal
each one's rows to up to 64 tasks.

Defined results: null text counts as empty; a text of fewer words than a shingle is one
shingle; texts without words are copies of each other and of nothing else; a null id is
kept only where a component has no other; of rows alike in id and text one is kept; an empty
table has no rows; other columns are carried whatever they are called; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, possible, small_batches, spread_join, text_or_empty, without, written
from .simhash import components, links, majority, shingle_hashes

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 50, 7


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, width).astype(np.uint64))


def _vertex(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


@lru_cache(maxsize=1)
def _salts() -> tuple[np.ndarray, np.ndarray]:
    """For each min-hash what a hash is combined with: bits to flip and an odd factor."""
    import xxhash

    flip, odd = ([xxhash.xxh64_intdigest(f"{kind}{i}") for i in range(BANDS * ROWS)] for kind in ("flip", "odd"))
    return np.array(flip, np.uint64), np.array(odd, np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes; none for an empty set."""
    import xxhash

    if not len(hashes):
        return np.empty(0, np.int64)
    flip, odd = _salts()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        mixed = (hashes[i : i + 256, None] ^ flip) * odd
        least = np.minimum(least, mixed.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def vertices(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash that tells rows of one id apart), v (a hash of the set), fp (a SimHash) and bands of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for text in b["text"]:
                distinct = shingle_set(text)
                # Of the set, so that rows with one set have one fingerprint.
                made.append((_vertex(distinct), majority(distinct.astype(">u8")), bands(distinct)))
            v, fp, keys = zip(*made, strict=True) if made else ((), (), ())
            yield b[["doc_id", "text_key"]].assign(v=np.array(v, np.int64), fp=np.array(fp, np.int64), bands=list(keys))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, text_key long, v long, fp long, bands array<long>")


def by_fingerprint(sets: DataFrame, block: int = 8192) -> DataFrame:
    """v and key (one for each component of the SimHash operator) of the sets (v, fp; a written table)."""
    fps = written(sets.select("fp").distinct(), "near-fps")
    roots = components(links(fps, block=block)).select(F.col("v").alias("fp"), "root")
    return spread_join(sets.select("v", "fp"), roots, "fp", F.col("v"), how="left").select("v", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))


def members(sets: DataFrame) -> DataFrame:
    """key, v, a (the band's leader) and n (its size) of the sets (v, fp, bands) that share a band, but for the leaders; a written table.

    Of bands with the same members one counts. A band's leader is the member whose bands are
    shared most, as those of the least edited copies are; so most of a group lie near it.
    """
    prints = written(by_fingerprint(sets.where(F.size("bands") > 0)), "near-prints")
    keyed = sets.select("v", F.explode("bands").alias("key")).unionByName(prints)
    # Most bands have one member, so only keys and counts of them are shuffled.
    several = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-several")
    keyed = written(possible(keyed, several, "key"), "near-keyed")
    of = keyed.groupBy("key").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("who"))
    shared = written(of.where("first < last").groupBy("first", "last", "n", "who").agg(F.min("key").alias("key")).select("key", "n"), "near-bands")
    met = written(spread_join(keyed, shared, "key", F.col("v")), "near-met")
    told = written(spread_join(met, met.groupBy("v").agg(F.sum("n").alias("shared")), "v", F.col("key")), "near-told")
    leader = told.groupBy("key").agg(F.max_by("v", F.struct("shared", "v")).alias("a"))
    out = written(spread_join(told, leader, "key", F.col("v")).where("v != a").select("key", "v", "a", "n"), "near-members")
    discard(prints, several, keyed, shared, met, told)
    return out


def hashed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """v and hashes of the sets of known (v, and id and text_key of a row), as a written table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t) for t in b["text"]]
            same = np.array([_vertex(s) for s in sets], np.int64) == b["v"].to_numpy()
            yield b[["v"]].assign(hashes=[s.tobytes() for s in sets])[same]

    texts = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_key"), text_or_empty().alias("text"))
    texts = possible(texts, known, "row_key", "text_key").join(known, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("text_key")))
    made = texts.select("v", "text").mapInPandas(run, "v long, hashes binary")
    with small_batches(docs.sparkSession, 1000):
        return written(made.groupBy("v").agg(F.min("hashes").alias("hashes")), "near-sets")  # of rows alike in id and text one


def _similar(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["of_a"], b["of_b"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                keep.append(both >= least * (len(x) + len(y) - both))
            yield b[["a", "b"]][np.array(keep, bool)]

    return run


def direct_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The candidate pairs (a written table) that are similar enough, as a written table."""
    end = lambda k: sets.select(F.col("v").alias(k), F.col("hashes").alias(f"of_{k}"))
    met = spread_join(pairs, end("a"), "a", F.col("b")).join(end("b"), "b").select("a", "b", "of_a", "of_b")
    with small_batches(pairs.sparkSession, 500):
        return written(met.mapInPandas(_similar(least), "a long, b long"), "near-direct")


def _verify(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links that connect exactly the sets of different parts in a group with pairs of similarity least or more.

        A group is one block of sets, or two of which each is compared with the other.
        """
        v, block, part, sets = rows["v"].to_numpy(), rows["i"].to_numpy(), rows["part"].to_numpy(), [np.frombuffer(s, "<u8") for s in rows["hashes"]]
        size = np.array(list(map(len, sets)))
        ends = np.cumsum(size)
        _, hashed = np.unique(np.concatenate(sets), return_inverse=True)
        # The sets that hold each hash lie together.
        order = np.argsort(hashed, kind="stable")
        holder = np.repeat(np.arange(len(v)), size)[order]
        begin = np.concatenate([[0], np.cumsum(np.bincount(hashed))])
        two = block.min() != block.max()
        free, out = np.ones(len(v), bool), []
        for seed in range(len(v)):
            queue = [seed] if free[seed] else []
            free[seed] = False
            while queue:
                s = queue.pop()
                own = hashed[ends[s] - size[s] : ends[s]]
                many = begin[own + 1] - begin[own]
                at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                both = np.bincount(holder[at], minlength=len(v))
                met = np.flatnonzero(free & (part != part[s]) & (both >= least * (size + size[s] - both)) & ((block != block[s]) if two else True))
                free[met] = False
                queue.extend(met.tolist())
                out.extend((v[s], v[m]) for m in met)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def open_bands(member: DataFrame, part: DataFrame) -> DataFrame:
    """key, v and part of the members of bands that direct links leave in different parts, their leaders aside; a written table."""
    rows = spread_join(member.where("n > 2").select("key", "v"), part.select("v", F.col("root").alias("in")), "v", F.col("key"), how="left")
    rows = written(rows.select("key", "v", F.coalesce("in", "v").alias("part")), "near-parts")
    unsettled = rows.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    return written(spread_join(rows, unsettled, "key", F.col("v")), "near-open")


def further_links(band: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links between the sets (v, hashes) of one band (key, v, part; a written table) that lie in different parts."""
    # A band's part has a number of its own, since a part may lie in several bands.
    of = spread_join(band.select("key", "v", F.xxhash64("key", "part").alias("part")), sets.select("v", F.octet_length("hashes").alias("bytes")), "v", F.col("key"))
    parted = written(of.select("key", "v", "part", "bytes"), "near-parted")
    size = parted.groupBy("key", "part").agg(F.sum("bytes").alias("bytes"))
    size = written(size.select("key", "part", F.when(F.col("bytes") > block, F.ceil(F.col("bytes") / block)).otherwise(0).cast("int").alias("own"), "bytes"), "near-sizes")
    # Blocks 0 to shared - 1 hold the small parts of a band; each large part has its own blocks.
    whole = size.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("own") == 0, F.col("bytes")).otherwise(0)) / block).cast("int").alias("shared"))
    number = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    large = size.where("own > 0").join(whole, "key")
    large = large.select("key", "part", "own", (F.col("shared") + F.coalesce(F.sum("own").over(number), F.lit(0))).cast("int").alias("at"))
    last = large.groupBy("key").agg(F.max(F.col("at") + F.col("own")).alias("last"))
    whole = whole.join(last, "key", "left").select("key", "shared", F.coalesce("last", "shared").alias("n"))
    placed = spread_join(size, whole, "key", F.col("part")).join(large.select("part", "at"), "part", "left")
    placed = placed.select("part", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("shared")).alias("blocks"), F.coalesce("at", F.lit(0)).alias("at"), "n", (F.col("own") > 0).alias("alone"))
    cut = spread_join(parted, placed, "part", F.col("v"))
    cut = cut.withColumn("i", F.pmod(F.xxhash64("v", F.lit("block")), F.col("blocks")).cast("int") + F.col("at"))
    partners = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("not alone or j < at or j >= at + blocks")
    groups = written(partners.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "v", "part", "n"), "near-groups")
    # Sets come in last, on their way to their groups; those of bands of one block need one part of the join.
    groups = spread_join(groups, sets, "v", F.when(F.col("n") > 1, F.col("lo") + F.col("hi"))).select("key", "lo", "hi", "i", "v", "part", "hashes")
    return groups.groupBy("key", "lo", "hi").applyInPandas(_verify(least), "a long, b long")


def near_copies(docs: DataFrame, *, least: float = LEAST, block: int = 16 << 20) -> DataFrame:
    """doc_id, text_key, v, and component_id and component_key (id and text_key of the row that stands for its component) of every row."""
    with small_batches(docs.sparkSession, 2000):
        rows = written(vertices(docs), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = written(rows.groupBy("v").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-vertices")
    member = members(sets)
    pairs = written(member.select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")).distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    known = written(ends.join(sets, "v").select("v", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("text_key")), "near-candidates")
    full = hashed(docs, known)
    direct = direct_links(pairs, full, least)
    part = written(components(direct), "near-direct-parts")
    band = open_bands(member, part)
    if band.isEmpty():
        roots = part
    else:
        # A part is a star by now, so that these rounds only have to join parts.
        roots = components(part.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(further_links(band, full, least, block)))
    held = written(sets.join(roots, "v", "left").select("v", "first", F.coalesce("root", "v").alias("root")), "near-roots")
    discard(known, sets, member, pairs, full, direct, part, band)
    stands = held.groupBy("root").agg(F.min("first").alias("stands"))
    of = spread_join(held, stands, "root", F.col("v")).select("v", "stands")
    named = spread_join(rows.select("doc_id", "text_key", "v"), of, "v", F.struct("doc_id", "text_key"))
    return named.select("doc_id", "text_key", "v", F.col("stands.doc_id").alias("component_id"), F.col("stands.text_key").alias("component_key"))


def representatives(docs: DataFrame, *, least: float = LEAST, block: int = 16 << 20) -> DataFrame:
    """The rows of docs, columns and all, that stand for their component: those of its smallest id."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    drop = near_copies(docs, least=least, block=block).groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    return without(docs, written(drop.where("n > 1 or not stays").select("id", "text_key", "stays"), "near-drop"))
