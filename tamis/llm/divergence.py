"""Quality rules by distribution divergence.

For each language, all its documents give two reference histograms: the median document's
shares of classes of characters (a median, so that the junk to be found doesn't shift it),
and the language's commonest words beside all others. A document is compared with the
references of its language by the Jensen-Shannon distance, and is kept if it comes near
enough to both. Texts, and languages, shorter than a minimum length give histograms that say
little, so they aren't judged: the guard keeps such a text, and the texts of a language
without a reference, unless the base rules fail them.

References come from one pass over all rows, in which a task keeps counters that it gives
out when they are full, and aggregations that combine before the shuffle. Medians are exact:
shares are counted on a grid of ``GRID`` steps. References are a written table of one row a
language, and Spark joins it by its measured size; nothing comes to the driver.

Defined results: a null text counts as empty and has no words; a null language is a
language of its own; without any reference all texts pass the method's own verdict; repeated
rows are judged alike; other columns are not looked at; texts are read whole.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, text_or_empty, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Classes of characters; each character belongs to the first class that holds it, or to the rest.
CLASSES = ("space", "lower", "upper", "digit", "symbol", "mark", "rest")
_STRIP = ".,;:!?\"'()[]#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Steps of the grid on which shares of classes are counted.
GRID = 10_000


@dataclass(frozen=True)
class Limits:
    """least_words guards both distances; repeat_percent is a limit of the base rules."""

    chars: float = 0.18
    words: float = 0.45
    least_words: int = 50
    repeat_percent: int = 50


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, CLASSES.index("rest"), dtype=np.uint8)
    for kind, cls in (("Ll", "lower"), ("Lu", "upper"), ("Nd", "digit")):
        table[[c for c in range(0x110000) if unicodedata.category(chr(c)) == kind]] = CLASSES.index(cls)
    for cls, chars in (("mark", ".,;:!?\"'()-"), ("symbol", SYMBOLS), ("space", ASCII_SPACE)):
        table[[ord(c) for c in chars]] = CLASSES.index(cls)
    return table


def class_counts(text: str) -> np.ndarray:
    """Characters of each class, in the order of CLASSES."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(_class_table()[codes], minlength=len(CLASSES))


def tokens(text: str) -> list[str]:
    """Lower-case words without the marks and symbols around them."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def _key(lang: Column) -> Column:
    """A language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _gather(most: int):
    """How often each language's words occur, and each share of a class of characters; a counter is given out when it is full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        cells: Counter = Counter()

        def full():
            yield pd.DataFrame([(k, w, 0, 0, n) for k, c in words.items() for w, n in c.items()], columns=["key", "word", "class", "cell", "n"])
            yield pd.DataFrame([(k, None, i, x, n) for (k, i, x), n in cells.items()], columns=["key", "word", "class", "cell", "n"])
            words.clear()
            cells.clear()

        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                if text:
                    n = len(text)
                    cells.update((key, i, x) for i, x in enumerate(((2 * GRID * class_counts(text) + n) // (2 * n)).tolist()))
                    words.setdefault(key, Counter()).update(tokens(text))
            if sum(map(len, words.values())) + len(cells) > most:
                yield from full()
        yield from full()

    return run


def references(docs: DataFrame, *, common: int = 64, least_words: int = 500, most: int = 200_000) -> DataFrame:
    """key (of a language) and ref of all languages with enough words, over all rows.

    ref is JSON: shares of the classes, the commonest words and their shares of all words.
    """
    texts = docs.select(_key(F.col("lang")).alias("key"), text_or_empty().alias("text"))
    parts = written(texts.mapInPandas(_gather(most), "key string, word string, class int, cell int, n long"), "divergence-parts")
    # The median share of each class: the first step of the grid at which half of the texts are reached.
    each = Window.partitionBy("key", "class")
    steps = parts.where("word is null").groupBy("key", "class", "cell").agg(F.sum("n").alias("n"))
    steps = steps.select("key", "class", "cell", F.sum("n").over(each.orderBy("cell")).alias("upto"), F.sum("n").over(each).alias("all"))
    medians = steps.where("2 * upto >= all").groupBy("key", "class").agg(F.min("cell").alias("cell"))
    chars = medians.groupBy("key").agg(F.sum("cell").alias("sum"), F.sort_array(F.collect_list(F.struct("class", "cell"))).alias("c"))
    chars = chars.where("sum > 0").select("key", F.transform("c", lambda x: x["cell"] / F.col("sum")).alias("chars"))
    counted = parts.where("word is not null").groupBy("key", "word").agg(F.sum("n").alias("n"))
    total = counted.groupBy("key").agg(F.sum("n").alias("total")).where(F.col("total") >= least_words)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), "word"))
    top = counted.withColumn("place", place).where(F.col("place") <= common)
    top = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    ref = F.struct("chars", F.col("w.word").alias("words"), F.transform("w.n", lambda n: n / F.col("total")).alias("shares"))
    return written(chars.join(total, "key").join(top, "key").select("key", F.to_json(ref).alias("ref")), "divergence-references")


def jensen_shannon(p: list[float], q: list[float]) -> float:
    """Distance (0 to 1, base 2) of two distributions over the same bins."""
    d = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        if a:
            d += a * math.log2(a / m)
        if b:
            d += b * math.log2(b / m)
    return math.sqrt(max(0.0, d / 2))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


@lru_cache(maxsize=256)
def _reference(ref: str) -> tuple[list[float], list[str], list[float]]:
    r = json.loads(ref)
    return r["chars"], r["words"], [*r["shares"], max(0.0, 1 - sum(r["shares"]))]


def distances(text: str, counts: np.ndarray, ref: str) -> tuple[float, float]:
    """How far a text that isn't empty is from its language in classes of characters and in words; 1 without a word."""
    chars, common, shares = _reference(ref)
    js_chars, words = jensen_shannon((counts / len(text)).tolist(), chars), tokens(text)
    if not words:
        return js_chars, 1.0
    seen = Counter(words)
    p = [seen.get(w, 0) / len(words) for w in common]
    return js_chars, jensen_shannon([*p, 1 - sum(p)], shares)


def judge(docs: DataFrame, refs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the distances to the language's reference (null without one)."""
    space, symbol = CLASSES.index("space"), CLASSES.index("symbol")

    def row(doc_id, text: str, ref: str | None) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        words, counts = data.split(), class_counts(text)
        lines = [x for x in data.split(b"\n") if x.split()]
        repeat, n_words = repeated_words(words), len(words)
        failed = n_words < limits.least_words or 100 * repeat > limits.repeat_percent * n_words
        js_chars, js_words = distances(text, counts, ref) if ref and text else (None, None)
        near = n_words < limits.least_words or js_chars is None or max(js_chars / limits.chars, js_words / limits.words) <= 1
        return (doc_id, n_words, len(text) - int(counts[space]), int(counts[symbol]), len(lines) - len(set(lines)), repeat, failed, not failed and near, js_chars, js_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [row(i, t, r) for i, t, r in zip(b["doc_id"], b["text"], b["ref"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", *COUNTS, "base_failed", "kept", "js_chars", "js_words"]).astype({"doc_id": "Int64", "js_chars": "float64", "js_words": "float64"})

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, js_chars double, js_words double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("lang")).alias("key"), text_or_empty().alias("text"))
    return texts.join(refs.select("key", "ref"), "key", "left").select("doc_id", "text", "ref").mapInPandas(run, schema)
