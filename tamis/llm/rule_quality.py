"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on statistics of labelled texts; each path from a root to a
node becomes a conjunctive rule; an L1 logistic regression keeps few of the rules and
weighs them; the kept rules are compiled into one Spark column. Statistics and rules are
built-in expressions, so scoring a corpus is a narrow projection.

The fit sees at most ``limit`` labelled texts of each class, and of those only their
statistics. Defined results: a null text counts as empty; an empty text has all statistics
0; without labels of both classes every score is the share of the class that there is
(0.5 without any). Repeated rows are scored each, alike, and one row of each labelled id is
learned from; a score that equals a threshold is accepted; an empty table gives no rows; very long
texts are read whole; a null id is held out; other columns are carried or not looked at, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, Sparse, class_counts, labelled_sample, lasso_logistic, text_or_empty


#: Statistics of a text, in the order in which they are compiled.
NAMES = ("n_words", "word_length", "words_a_line", "unique_words", "unique_lines", "symbols_a_word", "marks_a_word", "stops_a_word", "digits", "letters", "upper")
#: Characters that are counted, by the one that stands for all of a class.
COUNTED = {"#": "#*$%&|<>{}[]\\^~=_", "!": "!?", ".": ".,;:", "0": "0123456789", " ": ASCII_SPACE}


def _parts(text: Column) -> list[Column]:
    """What the statistics are made of; each costs one pass over the text."""
    kinds = F.translate(text, "".join(COUNTED.values()), "".join(k * len(v) for k, v in COUNTED.items()))
    return [
        text.alias("text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.array_remove(F.split(text, "\n"), "").alias("lines"),
        kinds.alias("kinds"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{L}+", ""))).cast("double").alias("n_letters"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("double").alias("n_upper"),
    ]


def _sizes() -> list[Column]:
    size = lambda c: F.size(c).cast("double")
    count = lambda k: F.octet_length("kinds") - F.octet_length(F.replace("kinds", F.lit(k), F.lit("")))
    return [
        F.char_length("text").cast("double").alias("n_chars"),
        size("words").alias("n_words"),
        size("lines").alias("n_lines"),
        size(F.array_distinct("words")).alias("n_unique_words"),
        size(F.array_distinct("lines")).alias("n_unique_lines"),
        *[count(k).cast("double").alias(f"n_{i}") for i, k in enumerate(COUNTED)],
        "n_letters",
        "n_upper",
    ]


def _shares() -> dict[str, Column]:
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return {
        "n_words": F.col("n_words"),
        "word_length": F.when(F.col("n_words") > 0, (F.col("n_chars") - F.col("n_4")) / F.col("n_words")).otherwise(0.0),
        "words_a_line": share("n_words", "n_lines"),
        "unique_words": share("n_unique_words", "n_words"),
        "unique_lines": share("n_unique_lines", "n_lines"),
        "symbols_a_word": share("n_0", "n_words"),
        "marks_a_word": share("n_1", "n_words"),
        "stops_a_word": share("n_2", "n_words"),
        "digits": share("n_3", "n_chars"),
        "letters": share("n_letters", "n_chars"),
        "upper": share("n_upper", "n_letters"),
    }


def with_statistics(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The kept columns, and a double for each of NAMES.

    A statistic is computed once a row: generators stand between the steps, so that no
    later filter or projection can take an expression back into itself.
    """
    once = lambda of, columns: of.select(*keep, F.inline(F.array(F.struct(*columns))))
    return once(once(once(df, _parts(text)), _sizes()), [c.alias(k) for k, c in _shares().items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above the bound, bound)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, bound in self.terms:
            out = out & ((columns[name] > bound) if above else (columns[name] <= bound))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, bound in self.terms:
            v = x[:, names.index(name)]
            out &= (v > bound) if above else (v <= bound)
        return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, columns: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(columns), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x, grad, cuts, depth, least, path, names, out):
    """Split where the two sides' squared gradient sums gain most; note every path. Returns each row's leaf value."""
    value = np.full(len(x), grad.mean() * 4)
    if not depth or len(x) < 2 * least:
        return value
    best = (1e-9, None, None)
    total, n = grad.sum(), len(x)
    for j, bounds in enumerate(cuts):
        for bound in bounds:
            left = x[:, j] <= bound
            k = int(left.sum())
            if least <= k <= n - least:
                s = grad[left].sum()
                gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, j, bound)
    if best[1] is None:
        return value
    _, j, bound = best
    left = x[:, j] <= bound
    for side, above in ((left, False), (~left, True)):
        longer = (*path, (names[j], above, float(bound)))
        out.add(longer)
        value[side] = _grow(x[side], grad[side], cuts, depth - 1, least, longer, names, out)
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int, depth: int, least: int, cuts: int) -> list[Rule]:
    """Paths of boosted trees, in a fixed order and without repeats."""
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 2)[1:-1], method="lower")) for j in range(x.shape[1])]
    score, paths = np.full(len(x), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))), set()
    for _ in range(trees):
        grad = y - 1 / (1 + np.exp(-score))
        score = score + 0.5 * _grow(x, grad, bounds, depth, least, (), names, paths)
    return [Rule(p) for p in sorted({tuple(sorted(set(p))) for p in paths})]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", limit: int = 6000, trees: int = 16, depth: int = 3, least: int = 20, cuts: int = 24, l1: float = 0.001) -> RuleModel:
    """Learn from labelled documents that aren't held out."""
    share = class_counts(labels, label)
    n0, n1 = share.get(0, 0), share.get(1, 0)
    if not n0 or not n1:
        return RuleModel((), 30.0 if n1 else -30.0 if n0 else 0.0)
    sample = labelled_sample(docs, labels, label, {0: limit, 1: limit})
    names = list(NAMES)
    stats = with_statistics(sample.select("y", F.col("text").alias("body")), F.col("body"), "y")
    got = np.array([tuple(r) for r in stats.collect()], dtype=float).reshape(-1, len(names) + 1)
    y, x = got[:, 0], got[:, 1:]
    s1 = int(y.sum())
    s0 = len(y) - s1
    if not s0 or not s1:
        return RuleModel((), math.log(n1 / n0))
    rules = tree_rules(x, y, names, trees=trees, depth=depth, least=min(least, max(1, len(y) // 10)), cuts=cuts)
    hits = np.array([r.holds(x, names) for r in rules], dtype=np.float32).T.reshape(len(y), len(rules))
    w, bias = lasso_logistic(Sparse.dense(hits), y, l1, rounds=500)
    bias += math.log(n1 / n0) - math.log(s1 / s0)
    return RuleModel(tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4), bias)


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """row (a struct of all columns of docs) and score of every document."""
    rows = docs.select(F.struct("*").alias("row"))
    return with_statistics(rows, F.coalesce(F.col("row.text").cast("string"), F.lit("")), "row").select("row", model.score({k: F.col(k) for k in NAMES}).alias("score"))


def classify(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every document."""
    known = with_statistics(docs.select("doc_id", text_or_empty().alias("body")), F.col("body"), "doc_id")
    return known.select("doc_id", model.score({k: F.col(k) for k in NAMES}).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
