"""Toxicity: a sparse word classifier regularised with counterfactuals.

Labelled texts become sets of words and word prefixes. Wherever a text names an
identity group, counterfactual copies of it name another group, or none, and the fit
penalises the squared difference of their scores beside the usual logistic loss. A word
that merely names a group can then carry no weight, even where most labelled texts that
name it are toxic.

The fit is bounded: at most ``per_class`` labelled texts of each class, at most
``vocabulary`` features. Scoring is a column expression over whole texts and needs no
shuffle. Defined results: a null text counts as empty; an empty text gets the score of
the intercept alone; without labels of both classes every score is the toxic share among
the labels, or 0 without any label. Repeated rows are scored each, alike, and one row of each
labelled id is learned from; a score of exactly one half counts as toxic; an empty table gives no
rows; very long texts are read whole; a null id is held out; other columns are carried or not
looked at, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Sparse, class_counts, labelled_sample, lasso_logistic, text_or_empty

#: By the word that stands for any of them in the second counterfactual, one for each
#: language: groups of words that name people; within a group they can stand for each other.
GROUPS_BY_NEUTRAL = {
    "people": (
        ("women", "men", "girls", "boys", "trans"),
        ("gay", "lesbian", "bisexual", "straight"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "arab"),
        ("african", "european", "american", "mexican", "chinese", "indian"),
        ("immigrants", "refugees", "migrants", "foreigners"),
        ("disabled", "deaf", "blind", "autistic"),
    ),
    "menschen": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("lesben", "schwule", "bisexuelle"),
        ("muslime", "christen", "juden", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiaten", "araber"),
        ("afrikaner", "europäer", "amerikaner", "mexikaner", "chinesen", "inder"),
        ("einwanderer", "flüchtlinge", "migranten", "ausländer"),
        ("behinderte", "gehörlose", "blinde", "autisten"),
    ),
    "personnes": (
        ("femmes", "hommes", "filles", "garçons"),
        ("lesbiennes", "homosexuels", "bisexuels"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("noirs", "blancs", "asiatiques", "arabes"),
        ("africains", "européens", "américains", "mexicains", "chinois", "indiens"),
        ("immigrés", "réfugiés", "étrangers"),
        ("handicapés", "sourds", "aveugles", "autistes"),
    ),
    "personas": (
        ("mujeres", "hombres", "niñas", "niños"),
        ("lesbianas", "homosexuales", "bisexuales"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("negros", "blancos", "asiáticos", "árabes"),
        ("africanos", "europeos", "americanos", "mexicanos", "chinos", "indios"),
        ("inmigrantes", "refugiados", "extranjeros"),
        ("discapacitados", "sordos", "ciegos", "autistas"),
    ),
}
IDENTITY_GROUPS = tuple(g for groups in GROUPS_BY_NEUTRAL.values() for g in groups)
#: Stands for words of groups that aren't in the table.
NEUTRAL = "people"
PREFIX = 5


def words(text: Column) -> Column:
    """The distinct lower-case letter runs of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), ""))


def features(tokens: Column) -> Column:
    """Words, and prefixes of longer words marked with a star, which no word holds."""
    long = F.filter(tokens, lambda w: F.char_length(w) > PREFIX)
    return F.array_union(tokens, F.transform(long, lambda w: F.concat(F.substring(w, 1, PREFIX), F.lit("*"))))


def _swapped(tokens: Column, to: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    return F.array_distinct(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w)))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    intercept: float

    pairs: int = 0  # counterfactual copies that the fit compared

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic."""
        total = F.lit(self.intercept)
        whole = {f: w for f, w in self.weights.items() if not f.endswith("*")}
        starts = {f[:-1]: w for f, w in self.weights.items() if f.endswith("*")}
        if self.weights:
            found = words(text)
            # Few words of a text have a weight; only those are looked up.
            hits = F.filter(found, lambda w: w.isin(*sorted(whole))) if whole else F.array().cast("array<string>")
            begin = lambda w: F.substring(w, 1, PREFIX)
            met = F.filter(found, lambda w: begin(w).isin(*sorted(starts)) & (F.char_length(w) > PREFIX)) if starts else F.array().cast("array<string>")
            total = _summed(hits, whole, total)
            total = _summed(F.array_distinct(F.transform(met, begin)), starts, total)
        return 1 / (1 + F.exp(-total))


def _summed(hits: Column, weights: dict[str, float], total: Column) -> Column:
    if not weights:
        return total
    known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return F.aggregate(hits, total, lambda acc, w: acc + F.element_at(known, w))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 8000, vocabulary: int = 2048, l1: float = 0.0004, counterfactual: float = 1.0, groups=IDENTITY_GROUPS) -> ToxicityModel:
    """Learn from labelled documents that aren't held out.

    Features are the ``vocabulary`` words and prefixes that a chi-square test finds most
    telling, plus every identity word met. The driver sees only which of them each of the
    at most 2 * per_class texts holds.
    """
    share = class_counts(labels, label)
    n0, n1 = share.get(0, 0), share.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel({}, 30.0 if n1 else -30.0)
    sample = labelled_sample(docs, labels, label, {0: per_class, 1: per_class}).select("y", words(F.col("text")).alias("tokens")).persist()
    try:
        size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        s0, s1 = size.get(0, 0), size.get(1, 0)
        if not s0 or not s1:
            return ToxicityModel({}, math.log(n1 / n0))
        counts = sample.select("y", F.explode(features(F.col("tokens"))).alias("f")).groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
        n = float(s0 + s1)
        a, b = F.col("a"), F.col("b")
        chi = F.pow(a * s0 - b * s1, 2) * n / ((a + b) * (n - a - b + 1) * float(s0) * float(s1))
        top = [r["f"] for r in counts.where(a + b >= 3).orderBy(chi.desc(), "f").limit(vocabulary).select("f").collect()]
        named = [w for g in groups for w in g]
        nobody = dict.fromkeys(named, NEUTRAL) | {w: n for n, known in GROUPS_BY_NEUTRAL.items() for g in known for w in g if w in named}
        neutral = list(dict.fromkeys(nobody.values()))
        vocab = list(dict.fromkeys(top + named + [f"{w[:PREFIX]}*" for w in (*named, *neutral) if len(w) > PREFIX] + neutral))
        place = {f: i for i, f in enumerate(vocab)}
        other = {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}
        keep = F.array(*[F.lit(f) for f in vocab])
        held = lambda tokens: F.array_intersect(features(tokens), keep)
        names = F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in named]))
        rows = sample.select(
            "y",
            held(F.col("tokens")).alias("x"),
            F.when(names, held(_swapped(F.col("tokens"), other))).alias("swapped"),
            F.when(names, held(_swapped(F.col("tokens"), nobody))).alias("neutral"),
        ).toLocalIterator()
        lines, ys, pairs = [], [], []

        for r in rows:
            x = {place[f] for f in r["x"]}
            lines.append(dict.fromkeys(x, 1.0))
            ys.append(r["y"])
            for k in ("swapped", "neutral"):
                if r[k] is not None:
                    other_x = {place[f] for f in r[k]}
                    pairs.append(dict.fromkeys(x - other_x, 1.0) | dict.fromkeys(other_x - x, -1.0))
    finally:
        sample.unpersist()
    k = len(vocab)
    w, bias = lasso_logistic(Sparse.of(lines, k), np.array(ys, dtype=float), l1, Sparse.of(pairs, k), counterfactual)
    bias += math.log(n1 / n0) - math.log(s1 / s0)  # from the sample's classes to those of all labels
    return ToxicityModel({f: float(v) for f, v in zip(vocab, w, strict=True) if abs(v) > 1e-6}, bias, len(pairs))


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of every document."""
    return docs.select("doc_id", model.score(text_or_empty()).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
