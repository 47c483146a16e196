"""License scans by diagonal voting.

Every document's words give a rolling hash for each group of ``K`` consecutive words. Spark
joins them to the places of the same groups in license templates; a match at word i of the
document and word j of a template votes for the diagonal i - j. Matches are checked word for word
in the join. Votes are added up for each document, template and diagonal; diagonals at most
``SLACK`` apart (a word put in or left out moves what follows it by one) are merged into a span; and a
span counts if the groups that it matches hold at least ``LEAST`` of the template's words.

The hashes of a document never leave its task: they are exploded and joined in one stage with
the templates, a parameter whose number of places is checked before it is broadcast (beyond that,
the join deals each hash to several tasks). So that documents without a match come through as
well, each one's list begins with the hash ``OWN``, which stands beside the templates as an entry of
its own and carries the document's counts. Only matches and one short row a document are shuffled,
after votes were added up in their tasks.

Besides, the places of a few fixed phrases are counted; their labels always count.

Defined results: null text counts as empty; repeated rows (one id and text) are scanned once
and come back as often as they came; a null id is an id like any other; an empty table has no
rows; a document of fewer words than a group can only have base labels; a template of fewer
words than a group never matches; of a passage that matches several templates each one counts, and
labels are sorted and distinct; other columns are not looked at; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import terms_of, text_or_empty

K = 3
SLACK = 2
LEAST = 0.75
#: Most places of templates that are broadcast; about 40 MB.
MOST_PLACES = 500_000
SALTS = 64
OWN = 0

# Phrases, each with its label, and words of public license notices.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("agpl", "GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "CC BY 4.0"),
    ("cc-by", "Creative Commons Attribution 4.0"),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc-by-nc", "Attribution-NonCommercial 4.0"),
    ("cc-by-nc-nd", "CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa", "CC BY-NC-SA 4.0"),
    ("cc-by-nd", "CC BY-ND 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-sa", "Attribution-ShareAlike 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def rolling(words: Sequence[bytes], k: int, known: dict[bytes, int]) -> np.ndarray:
    """A signed 64-bit hash of every k consecutive words; never OWN."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + one[j : j + n]
    out[out == OWN] = 1
    return out.view(np.int64)


def phrase_places(words: Sequence[bytes], phrases: Sequence[tuple[str, str]]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase stands."""
    wanted = [([w.encode() for w in phrase.split()], label) for phrase, label in phrases]
    last = {want[-1] for want, _ in wanted}
    ends = [i + 1 for i, w in enumerate(words) if w in last]
    return [(i - len(want), label) for i in ends for want, label in wanted if i >= len(want) and words[i - len(want) : i] == want]


def template_places(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K) -> tuple[DataFrame, int]:
    """hash, template, label, at, total (words of the template) and gram of every group of k words, the entry OWN, and their number."""
    known, rows = _WordHashes(), [(OWN, -1, None, 0, 0, None)]
    for number, (label, text) in enumerate(templates):
        words = terms_of(text)
        for at, h in enumerate(rolling(words, k, known).tolist()):
            rows.append((h, number, label, at, len(words), b" ".join(words[at : at + k]).decode()))
    return spark.createDataFrame(rows, "hash long, template int, label string, at int, total int, gram string"), len(rows)


def _hashed(phrases, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = _WordHashes(), [p.split()[-1].encode() for p, _ in phrases]
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                if len(known) > 300_000:
                    known.clear()
                hashes, rows = [], []
                for text in part.column("text").to_pylist():
                    words = terms_of(text)
                    places = phrase_places(words, phrases) if any(m in words for m in marks) else []
                    at = [i for i, _ in places]
                    rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), b" ".join(words)))
                    hashes += [np.array([OWN], np.int64), rolling(words, k, known)]
                ends = np.cumsum([0, *(len(a) + len(b) for a, b in zip(hashes[::2], hashes[1::2], strict=True))], dtype=np.int32)
                kinds = (pa.int64(),) * 4 + (pa.string(), pa.string())
                columns = [pa.array([r[i].decode() if i == 5 else r[i] for r in rows], t) for i, t in enumerate(kinds)]
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes)))
                names = ["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base_labels", "words", "hashes"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *columns, listed], names)

    return run


def scan(docs: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, k: int = K, slack: int = SLACK, least: float = LEAST, most_places: int = MOST_PLACES) -> DataFrame:
    """One row a document: counts of words and of phrases, labels, spans (label, first and last word, share) and score.

    score is 1 where a phrase stands, else the largest share of a template's words that one span holds.
    """
    places, n = template_places(docs.sparkSession, templates, k)
    base = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))
    made = rows.mapInArrow(_hashed(phrases, k), "doc_id long, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels string, words string, hashes array<long>")
    grams = made.select("doc_id", "text_key", *base, "words", F.posexplode("hashes").alias("i", "hash"))
    if n <= most_places:
        met = grams.join(F.broadcast(places), "hash")
    else:
        salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = grams.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "i"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    same = F.array_join(F.slice(F.split("words", " "), F.col("i"), F.lit(k)), " ") == F.col("gram")
    met = met.where((F.col("template") < 0) | same)
    key = ["doc_id", "text_key"]
    # The first hash is OWN, so that the group of words at i is the i-th, and begins with word i - 1.
    votes = met.groupBy(*key, "template", "label", "total", (F.col("i") - 1 - F.col("at")).alias("diagonal"), *[F.when(F.col("template") < 0, F.col(c)).alias(c) for c in base]).agg(
        F.count("*").alias("n"), F.min(F.col("i") - 1).alias("lo"), F.max(F.col("i") - 1 + k - 1).alias("hi"), F.collect_set("at").alias("ats")
    )
    w = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > slack, F.lit(True))
    merged = votes.repartition(*key).withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(w))
    held = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ats")), lambda a: F.sequence(a, a + k - 1)))))
    spans = merged.groupBy(*key, "template", "label", "total", "span", *base).agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), held.alias("held"))
    share = F.when(F.col("template") >= 0, F.col("held") / F.col("total"))
    good = F.when(share >= least, F.struct("label", F.col("lo").cast("long").alias("first_word"), F.col("hi").cast("long").alias("last_word"), share.alias("share")))
    found = spans.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in base],
        F.max(F.when(F.col("template") < 0, F.col("n"))).alias("copies"),
        F.array_sort(F.collect_list(good)).alias("spans"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("share"),
    )
    labels = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("share"))
    out = found.select(*key, *base, F.array_join(labels, ",").alias("labels"), "spans", score.alias("score"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.drop("copy", "text_key")


def oracle_sql() -> str:
    """The scan in DuckDB's SQL over its own split of words, without hashes."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    given = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))
    words = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with d as (select doc_id, {words.format('text')} as w from documents),
p as (select doc_id, i, case when w[i] = 'mit' then 'mit' when w[i] = 'apache' then 'apache' else 'gpl' end as label
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)
  where w[i] in ('mit', 'apache') and w[i + 1] = 'license' or w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license'),
b as (select doc_id, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word from p group by 1),
t as (select template, label, {words.format('text')} as w from (values {given}) v(template, label, text)),
tg as (select template, label, len(w) as total, unnest(range(1, len(w) - {K - 2})) as j, w from t),
dg as (select doc_id, unnest(range(1, len(w) - {K - 2})) as i, w from d),
tk as (select template, label, total, j, array_to_string(w[j:j + {K - 1}], ' ') as gram from tg),
dk as (select doc_id, i, array_to_string(w[i:i + {K - 1}], ' ') as gram from dg),
m as (select doc_id, template, label, total, i - j as diagonal, j from dk join tk using (gram)),
s as (select *, diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) as step from (select distinct doc_id, template, diagonal from m)),
g as (select *, sum(case when step <= {SLACK} then 0 else 1 end) over (partition by doc_id, template order by diagonal) as span from s),
c as (select doc_id, template, label, count(distinct j + o) / max(total) as share from m join g using (doc_id, template, diagonal), range({K}) r(o) group by doc_id, template, label, span),
l as (select doc_id, label from p union select doc_id, label from c where share >= {LEAST}),
n as (select doc_id, max(share) as share from c group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word,
  coalesce((select string_agg(distinct label, ',' order by label) from p where p.doc_id = d.doc_id), '') as base_labels,
  coalesce((select string_agg(distinct label, ',' order by label) from l where l.doc_id = d.doc_id), '') as labels,
  case when b.n_base > 0 then 1.0 else coalesce(n.share, 0.0) end::double as score
from d left join b using (doc_id) left join n using (doc_id)"""
