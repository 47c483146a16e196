import random
import re

from tamis.llm import license_scan as scan

from odd_texts import ODD

FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(text, k=scan.K):
    """All pairs of places, one template after the other."""
    words = split(text)
    at = [(i, label) for phrase, label in scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = sorted({x for _, x in at})
    labels, best = set(base), 0.0
    for label, template in scan.TEMPLATES:
        t = split(template)
        met = sorted({(i - j, j) for i in range(len(words) - k + 1) for j in range(len(t) - k + 1) if words[i : i + k] == t[j : j + k]})
        group, before = [], None
        for d, j in [*met, (10**9, 0)]:
            if before is not None and d - before > scan.SLACK:
                share = len({x + o for x in group for o in range(k)}) / len(t)
                best = max(best, share)
                labels |= {label} if share >= scan.LEAST else set()
                group = []
            group.append(j)
            before = d
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)), 1.0 if at else best


def texts(rng):
    filler = ["".join(rng.choices("abcdeé", k=5)) for _ in range(60)] + ["licensed", "under", "the", "license", "General", "Public", "MIT"]
    out = []
    for _ in range(60):
        words = rng.choices(filler, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            notice = split(rng.choice(scan.TEMPLATES)[1])
            for _ in range(rng.randrange(3)):
                notice.insert(rng.randrange(len(notice)), rng.choice(filler)) if rng.random() < 0.5 else notice.pop(rng.randrange(len(notice)))
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        out.append(rng.choice([" ", ", ", "\n"]).join(words))
    return out


def test_equals_all_pairs(spark, docs_of):
    given = [*texts(random.Random(2)), *[t if t is None or len(t) < 5000 else t[:4000] for t in ODD], "The MIT License, the mit-license", "GNU GENERAL PUBLIC LICENSE", *[t for _, t in scan.TEMPLATES], "\n".join(["Licensed under CC BY-NC 4.0."] * 40)]
    for docs in (docs_of(given, extra=True), docs_of(given).repartition(5)):
        for most in (scan.MOST_PLACES, 10):
            got = {r["doc_id"]: r for r in scan.scan(docs, most_places=most).collect()}
            assert {i: tuple(r[c] for c in FIELDS) for i, r in got.items()} == {i: plain(t) for i, t in enumerate(given)}


def test_each_notice_gives_its_label_alone(spark, docs_of):
    got = {r["doc_id"]: r for r in scan.scan(docs_of([f"some words before {t} and after" for _, t in scan.TEMPLATES])).collect()}
    for i, (label, text) in enumerate(scan.TEMPLATES):
        assert label in got[i]["labels"].split(",") and len(got[i]["labels"].split(",")) <= 1 + ("General Public" in text), (label, got[i]["labels"])
        span = next(s for s in got[i]["spans"] if s["label"] == label)
        assert span["first_word"] <= 3 and span["last_word"] == 2 + len(split(text))


def test_nulls_repeats_and_empty_tables(spark, docs_of):
    notice = "Released under the MIT License."
    rows = [(None, notice), (None, notice), (3, notice), (3, notice), (3, "other"), (4, None)]
    got = scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or -1), r["n_words"], r["labels"]) for r in got) == [(-1, 5, "mit"), (-1, 5, "mit"), (3, 1, ""), (3, 5, "mit"), (3, 5, "mit"), (4, 0, "")]
    assert scan.scan(docs_of(ODD)).count() == len(ODD)
    assert scan.scan(docs_of(ODD).limit(0)).count() == 0


def test_hashes_are_joined_where_they_are(spark, docs_of):
    plan = scan.scan(docs_of(["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.index("Exchange hashpartitioning") < plan.index("posexplode")
