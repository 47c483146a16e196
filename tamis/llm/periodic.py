"""Periodic runs of words, by a suffix automaton whose link tree is a link-cut tree.

A run is a stretch of consecutive words with smallest period q, at least ``least_times``
periods and ``least_words`` words long, that no neighbouring word extends. Words are appended
to a suffix automaton one by one. Each state remembers where its words last ended. An append
is an access in the link tree: the path from the new state to the root becomes one preferred
path, whose colour is the new end; every preferred path that the access cuts into is one
segment of states that last ended at one earlier place p. If the deepest state of that
segment has length l, the l words up to the new end i are those up to p, and no longer suffix
recurs there. With d = i - p the stretch of l + d words up to i therefore has the period d, begins
just there, and has no smaller one (a smaller one would have recoloured the segment). So each
segment with l >= (least_times - 1) * d is a run seen up to i, and the last i that shows it is
its end; nothing needs to be compared word by word. Splay trees hold the preferred paths, so
an access costs O(log n) on average, on a text of one repeated word as well.

Only stretches of words that can hold a run are appended. In a run every group of three
words recurs q words on or back, and 4 q is not longer than the stretch, so words
whose groups recur at no such distance lie in no run. The rest of the text falls into stretches, each
of which holds its runs whole, and each gets an automaton of its own. This selection is exact,
works in arrays and drops no run; see ``stretches``.

Texts are independent, so nothing is shuffled; a task holds the automaton of one stretch.

Defined results: null text counts as empty and has no runs; repeated rows give repeated
results; a null id is never turned by ``turned``; an empty table gives no rows; other columns
are not looked at. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty

LEAST_TIMES, LEAST_WORDS = 4, 6
GROUP = 3


class LinkCutAutomaton:
    """A suffix automaton over numbers; ``append`` yields (earlier end, length) of every segment that it recolours."""

    def __init__(self) -> None:
        # Of the automaton: transitions, suffix link, length of the longest word. State 0 is none, 1 the root.
        self.next: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        # Of the link-cut tree: parent (in the splay tree, or the path's parent), nearer and farther from the root, and the
        # colour of a path, which its splay root holds.
        self.up, self.near, self.far, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.end = 1, -1

    def _state(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.up.append(link)
        self.near.append(0)
        self.far.append(0)
        self.colour.append(-1)
        return len(self.link) - 1

    def _splay(self, x: int) -> None:
        """Make x the root of its path's splay tree."""
        up, near, far = self.up, self.near, self.far
        p = up[x]
        if not p or (near[p] != x and far[p] != x):
            return
        while True:
            g = up[p]
            inner = g and (near[g] == p or far[g] == p)
            straight = inner and (near[g] == p) == (near[p] == x)
            for turn in (p, x) if straight else (x, x) if inner else (x,):
                # Rotate turn above its parent.
                a = up[turn]
                b = up[a]
                if near[a] == turn:
                    c = near[a] = far[turn]
                    far[turn] = a
                else:
                    c = far[a] = near[turn]
                    near[turn] = a
                if c:
                    up[c] = a
                if b:
                    if near[b] == a:
                        near[b] = turn
                    elif far[b] == a:
                        far[b] = turn
                up[turn], up[a] = b, turn
            # The colour was at the top that x has replaced or is still below.
            p = up[x]
            if not p or (near[p] != x and far[p] != x):
                self.colour[x] = self.colour[g if inner else a]
                return

    def _extend(self, symbol: int) -> int:
        """The state of the text with one more word."""
        nexts, link, length = self.next, self.link, self.length
        p, new = self.last, self._state(self.length[self.last] + 1, 0, {})
        while p and symbol not in nexts[p]:
            nexts[p][symbol] = new
            p = link[p]
        if not p:
            link[new] = self.up[new] = 1
        else:
            q = nexts[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = self.up[new] = q
            else:
                # The copy has ended where q has, so it joins q's path just above q.
                copy = self._state(length[p] + 1, link[q], dict(nexts[q]))
                while p and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = copy
                    p = link[p]
                self._splay(q)
                if c := self.near[q]:
                    self.up[c] = copy
                self.near[copy], self.near[q], self.up[copy] = c, copy, q
                link[q] = link[new] = self.up[new] = copy
        self.last = new
        return new

    def append(self, symbol: int) -> list[tuple[int, int]]:
        self.end += 1
        up, far, colour, length = self.up, self.far, self.colour, self.length
        below, x, found = self._extend(symbol), self.link[self.last], []
        while x:
            self._splay(x)
            if colour[x] >= 0:
                found.append((colour[x], length[x]))
            if c := far[x]:  # what lies deeper keeps its colour and becomes a path of its own
                colour[c] = colour[x]
            far[x] = below
            below, x = x, up[x]
        colour[below] = self.end
        return found


def runs_of(symbols: Sequence[int], least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS) -> dict[tuple[int, int], int]:
    """(start, period) -> length of every run of a sequence."""
    automaton, out = LinkCutAutomaton(), {}
    append, times = automaton.append, least_times - 1
    for i, s in enumerate(symbols):
        for p, n in append(s):
            d = i - p
            if n >= times * d:
                out[(i - n - d + 1, d)] = n + d
    return {k: n for k, n in out.items() if n >= least_words}


def stretches(ids: np.ndarray, least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """First word and end of the parts of a text (its words as numbers) that can hold a run, each whole."""
    n = len(ids)
    if n < max(least_words, GROUP):
        return []
    width = int(ids.max()) + 1
    gram = ids[: n - 1].astype(np.int64) * width + ids[1:]
    if width > 1 << 20:
        gram = np.unique(gram, return_inverse=True)[1]
    gram = gram[: n - 2] * width + ids[2:]
    order = np.argsort(gram, kind="stable")
    step = np.diff(order)
    step[gram[order[1:]] != gram[order[:-1]]] = n  # another group of words
    gap = np.full(len(gram), n, np.int64)
    gap[order[1:]] = step
    gap[order[:-1]] = np.minimum(gap[order[:-1]], step)
    alive = gap < n
    while alive.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).view(np.int8)))
        begin, end = edge[::2], edge[1::2]  # of groups
        words = end - begin + GROUP - 1
        most = np.where(words >= least_words, words // least_times, 0)  # the longest period that fits
        now = alive & (gap <= np.repeat(most, end - begin).take(np.cumsum(alive) - 1))
        if (now == alive).all():
            return list(zip(begin.tolist(), (end + GROUP - 1).tolist(), strict=True))
        alive = now
    return []


def turned(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, a tenth of all ids with a repeating end: from word a on, p words over and over."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def text_runs(words: list[bytes], least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text, by start, then period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out = []
    for begin, end in stretches(ids, least_times, least_words):
        out.extend((begin + s, n, q) for (s, q), n in runs_of(ids[begin:end].tolist(), least_times, least_words).items())
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text with one period left of each run, words joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most repeats, exactly; of equal ones the first, then the one with the smallest period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(docs: DataFrame, *, rewrite=turned) -> DataFrame:
    """doc_id, runs (start, length, period) and collapsed (the text with each run's repeats taken out) of every row.

    rewrite: (words, doc_id) -> words, applied before; None for the texts as they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, left = [], []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = text.encode().split()
                words = rewrite(words, int(doc_id) if doc_id else None) if rewrite else words
                runs = text_runs(words)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                left.append(collapsed(words, runs))
            yield pd.DataFrame({"doc_id": b["doc_id"].map(lambda x: int(x) if x else None).astype("Int64"), "runs": found, "collapsed": left})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: number of runs, the strongest run, digests of all runs and of the collapsed text.

    The digests are made where the runs are, so that no text leaves its task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                i = int(doc_id) if doc_id else None
                words = turned(text.encode().split(), i)
                runs = text_runs(words)
                s, n, q = strongest(runs) or (None, None, None)
                listed = "".join(f"{s_},{n_},{q_}\n" for s_, n_, q_ in runs)
                rows.append((i, len(runs), s, n, q, 1000 * n // q if q else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
            yield out.astype({c: "Int64" for c in out.columns[:6]})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
