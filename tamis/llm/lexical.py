"""Ranked lexical search with geometric blocks in every posting list.

A document's score for a query is the sum, over the query's terms, of the term's weight times a
saturating count, in integers. The index is made of segments, as many as the table needs, each
with the posting lists of some thousand documents:

* a list is clustered by the similarity of its documents: a document goes to the most similar of
  some of the list's own documents, and a cluster is a block (or several, if it is large);
* a block's summary is the coordinatewise maximum of its documents' weighted impacts. A coordinate
  is a common term or a group of rarer terms, and maxima are rounded up, so that the sum
  over a query's terms is an upper bound of the score of every document in the block;
* a query goes through its terms' lists in the order of their largest impacts, skips a block only when
  its bound is under the query's threshold, scores all other documents of the block exactly, and
  ends when the largest impacts of the lists that are left can't add up to the threshold.

A threshold is a score that the k-th best document is known to reach: the k-th best of the
first segments of up to ``SAMPLE`` tasks, or of the segment itself if that is more. So nothing is approximate and
results are those of scoring every document; ties at the threshold are scored.

Spark counts documents, lengths and document frequencies, deals segments to tasks and merges each segment's
best k. Postings never leave the task that makes them, so a term of every document makes no
hot key; only k rows a query and segment are shuffled, and Spark cuts them to k in each task.
Queries are read in blocks of about ``queries``; only the terms of one block are indexed at a
time, and they are what a task holds besides one segment.

Defined results: null text counts as empty and never scores; a null id is an id that ranks
after others of the same score; repeated rows are ranked each; rows of one item_id are one
query; an item without terms, or whose terms no document holds, has no rows; ties go by id; an empty
table gives no rows; other columns are not looked at. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, small_batches, terms_of, text_or_empty, written

K = 50
#: Documents of a segment, of a block; coordinates of a summary; tasks whose first segments give the first thresholds.
SEGMENT, BLOCK, COORDINATES, SAMPLE = 4096, 64, 256, 4
QUERIES = 2000
#: The arrays of a segment.
_KINDS = {"docs": np.int64, "terms": np.int32, "list_at": np.int64, "places": np.int32, "impacts": np.int32, "block_at": np.int64, "list_block": np.int64, "largest": np.int64, "summaries": np.uint16, "unit": np.int64}
_FORWARD = "doc_id long, n long, ids array<int>, counts array<int>"


@dataclass(frozen=True)
class Weights:
    """What all segments share: number of documents, their terms, a weight and a coordinate for every term of the queries."""

    documents: int
    length: int
    weight: np.ndarray
    coordinate: np.ndarray

    @classmethod
    def of(cls, documents: int, length: int, frequency: np.ndarray) -> Weights:
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)
        # The commonest terms, whose lists are long, have coordinates of their own; others share one with terms of about their weight.
        own, place = COORDINATES // 2, np.arange(len(weight))
        shared = own + (place - own) * (COORDINATES - own) // max(len(weight) - own, 1)
        coordinate = np.empty(len(weight), np.int64)
        coordinate[np.lexsort((place, weight))] = np.where(place < own, place, shared)
        return cls(documents, length, weight, coordinate)

    def impacts(self, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.documents) // self.length
        return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def forward(docs: DataFrame, number: Mapping[str, int]) -> DataFrame:
    """doc_id, n (all terms with repeats), ids and counts of the numbered terms of every row."""
    known = {t.encode(): i for t, i in number.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                n, ids, counts, ends = [], [], [], [0]
                for text in part.column("text").to_pylist():
                    terms = terms_of(text)
                    n.append(len(terms))
                    for t, c in Counter(terms).items():
                        if (i := known.get(t)) is not None:
                            ids.append(i)
                            counts.append(c)
                    ends.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _FORWARD)


def blocked(places: np.ndarray, like: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a list's documents by cluster, and where its blocks begin. like: a vector for each document of the segment."""
    if len(places) <= block:
        return np.arange(len(places)), np.zeros(1, np.int64)
    vectors = like[places]
    chosen = vectors[::block]
    of = np.argmax(vectors @ chosen.T, axis=1)
    order = np.argsort(of, kind="stable")
    of = of[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    size = np.diff(np.append(first, len(of)))
    within = np.arange(len(of)) - np.repeat(first, size)
    return order, np.flatnonzero(within % (2 * block) == 0)


def build(ids: list, n: np.ndarray, term: np.ndarray, counts: np.ndarray, held: np.ndarray, weights: Weights, block: int = BLOCK) -> dict[str, np.ndarray]:
    """One segment: documents (ids), and its postings, held[i] of document i, one after the other."""
    doc = np.repeat(np.arange(len(n)), held)
    impact = weights.impacts(n[doc], counts.astype(np.int64))
    worth = impact * weights.weight[term]
    unit = int(worth.max(initial=0)) // 65535 + 1
    sketch = np.zeros((len(n), COORDINATES), np.uint16)
    np.maximum.at(sketch, (doc, weights.coordinate[term]), (-(-worth // unit)).astype(np.uint16))
    like = sketch.astype(np.float32) @ np.random.default_rng(7).standard_normal((COORDINATES, 32)).astype(np.float32)
    like /= np.maximum(np.linalg.norm(like, axis=1, keepdims=True), 1e-9)
    order = np.lexsort((doc, term))
    doc, term, impact, worth = doc[order], term[order], impact[order], worth[order]
    list_at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
    ends = np.append(list_at, len(term))
    block_at, list_block = [], [0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        by, starts = blocked(doc[a:b], like, block)
        doc[a:b], impact[a:b] = doc[a:b][by], impact[a:b][by]
        block_at.extend((a + starts).tolist())
        list_block.append(len(block_at))
    at = np.array([*block_at, len(doc)], np.int64)
    summaries = np.zeros((len(block_at), COORDINATES), np.uint16)
    step = 512
    for i in range(0, len(block_at), step):
        a, b = at[i], at[min(i + step, len(block_at))]
        summaries[i : i + step] = np.maximum.reduceat(sketch[doc[a:b]], at[i : min(i + step, len(block_at))] - a, axis=0)
    largest = np.maximum.reduceat(worth, list_at) if len(list_at) else np.empty(0, np.int64)
    return {
        "docs": np.array([np.iinfo(np.int64).min if x is None else x for x in ids], np.int64),
        "terms": term[list_at].astype(np.int32),
        "list_at": ends.astype(np.int64),
        "places": doc.astype(np.int32),
        "impacts": impact.astype(np.int32),
        "block_at": at,
        "list_block": np.array(list_block, np.int64),
        "largest": largest.astype(np.int64),
        "summaries": summaries.ravel(),
        "unit": np.array([unit]),
    }


def segments(rows: DataFrame, weights: Weights, *, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Rows of forward as segments, one a row: their task, their place in it, and their arrays as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task, nth = TaskContext.get().partitionId(), count()

        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            of = lambda c: t.column(c).combine_chunks()
            lists = of("ids")
            flat = lambda c: np.asarray(of(c).flatten(), np.int64)
            size = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, np.int64)
            s = build(of("doc_id").to_pylist(), np.asarray(of("n")), flat("ids"), flat("counts"), size, weights, block)
            number = {"task": pa.array([task], pa.int32()), "nth": pa.array([next(nth)], pa.int32())}
            return pa.RecordBatch.from_pydict(number | {k: pa.array([np.ascontiguousarray(s[k], kind).tobytes()], pa.binary()) for k, kind in _KINDS.items()})

        have = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                held.append(part := batch.slice(begin, 512))
                have += part.num_rows
                if have >= segment:
                    yield made(held)
                    held, have = [], 0
        if held:
            yield made(held)

    return rows.mapInArrow(run, ", ".join(["task int", "nth int", *(f"{k} binary" for k in _KINDS)]))


class Segment:
    """A segment as it is searched."""

    def __init__(self, parts: Mapping[str, bytes], weights: Weights):
        for k, kind in _KINDS.items():
            setattr(self, k, np.frombuffer(parts[k], kind))
        self.weights, self.unit = weights, int(self.unit[0])
        self.summaries = self.summaries.reshape(-1, COORDINATES)
        # The same postings by document, for exact scores.
        self.by_doc = np.argsort(self.places, kind="stable")
        self.term = np.repeat(self.terms, np.diff(self.list_at))[self.by_doc]
        self.impact = self.impacts[self.by_doc].astype(np.int64)
        self.doc_at = np.searchsorted(self.places[self.by_doc], np.arange(len(self.docs) + 1))
        self.worth = np.zeros(len(weights.weight), np.int64)
        self.looked = self.skipped = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Of documents, by the weights in worth."""
        begin, size = self.doc_at[docs], self.doc_at[docs + 1] - self.doc_at[docs]
        first = np.cumsum(size) - size
        at = np.repeat(begin - first, size) + np.arange(size.sum())
        upto = np.append(0, np.cumsum(self.worth[self.term[at]] * self.impact[at]))
        return upto[first + size] - upto[first]

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and score of all documents that may be among the best k: those whose score is at least the threshold, least to begin with."""
        i = np.searchsorted(self.terms, terms)
        i = i[(i < len(self.terms)) & (self.terms[np.minimum(i, len(self.terms) - 1)] == terms)] if len(self.terms) else i[:0]
        i = i[np.argsort(-self.largest[i], kind="stable")]
        left = np.cumsum(self.largest[i][::-1])[::-1]
        coordinate, most = self.weights.coordinate[self.terms[i]], self.largest[i]
        self.worth[terms] = self.weights.weight[terms]
        free, docs, found = np.ones(len(self.docs), bool), np.empty(0, np.int64), np.empty(0, np.int64)
        least = max(least, 1)
        for j, rest in zip(i.tolist(), left.tolist(), strict=True):
            if rest < least:
                break
            blocks = np.arange(self.list_block[j], self.list_block[j + 1])
            bound = np.minimum(self.summaries[np.ix_(blocks, coordinate)].astype(np.int64) * self.unit, most).sum(axis=1)
            order = np.argsort(-bound, kind="stable")
            blocks, bound = blocks[order], bound[order]
            at = 0
            while at < len(blocks) and bound[at] >= least:
                upto = min(at + 8, at + int(np.count_nonzero(bound[at:] >= least)))
                new = np.concatenate([self.places[self.block_at[b] : self.block_at[b + 1]] for b in blocks[at:upto]])
                new = new[free[new]].astype(np.int64)
                free[new] = False
                docs, found = np.append(docs, new), np.append(found, self.scores(new))
                if len(found) >= k:
                    least = max(least, int(np.partition(found, len(found) - k)[len(found) - k]))
                keep = found >= least
                docs, found = docs[keep], found[keep]
                self.looked += upto - at
                at = upto
            self.skipped += len(blocks) - at
        self.worth[terms] = 0
        return docs, found


def best(index: DataFrame, weights: Weights, queries: Mapping[int, np.ndarray], least: Mapping[int, int], k: int) -> DataFrame:
    """item_id, doc_id and score of the best k documents of every segment, but none under a query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.to_pylist():
                s, out = Segment(parts, weights), []
                for item, terms in queries.items():
                    places, score = s.search(terms, k, least.get(item, 0))
                    order = np.lexsort((s.docs[places], s.docs[places] == np.iinfo(np.int64).min, -score))[:k]
                    out.append((np.full(len(order), item), s.docs[places[order]], score[order]))
                item, doc, score = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"item_id": item, "doc_id": pa.array(doc, mask=doc == np.iinfo(np.int64).min), "score": score})

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, k: int = K, queries: int = QUERIES, segment: int = SEGMENT, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best k documents with a score above 0."""
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts, out = max(1, math.ceil(asked.count() / queries)), []
    for part in range(parts):
        texts: dict[int, set[str]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect():  # about ``queries`` rows
            texts.setdefault(r["item_id"], set()).update(t.decode() for t in terms_of(r["text"]))
        number = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))}
        with small_batches(docs.sparkSession, 2000):
            rows = written(forward(docs, number), "lexical-forward")
        total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        frequency = np.zeros(len(number), np.int64)
        for r in rows.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # one row a term of these queries
            frequency[r["id"]] = r["count"]
        weights = Weights.of(total["documents"], max(total["length"], 1), frequency)
        wanted = {item: np.array(sorted(number[t] for t in terms if frequency[number[t]]), np.int64) for item, terms in texts.items()}
        wanted = {item: terms for item, terms in wanted.items() if len(terms)} or {0: np.empty(0, np.int64)}
        index = written(segments(rows, weights, segment=segment, block=block), "lexical-segments")
        with small_batches(docs.sparkSession, 1):  # a row is a segment
            some = index.where((F.col("nth") == 0) & (F.col("task") < sample))
            first = ranked(best(some, weights, wanted, {}, k), k).where(F.col("rank") == k)
            least = {r["item_id"]: r["score"] for r in first.select("item_id", "score").collect()}  # one row a query
            out.append(written(ranked(best(index, weights, wanted, least, k), k), "lexical-best"))
        discard(rows, index)
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
s as (select count(*) filter (len(t) > 0) as docs, sum(len(t))::bigint as terms from d),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by term),
x as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from p join w using (term) join q using (term), s group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50"""
