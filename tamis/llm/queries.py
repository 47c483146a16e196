"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, chat, divergence, exact_dedup, lexical, license_scan, packing, periodic, rule_quality, simhash, slots, toxicity, url_lists
from ._shared import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(byte_bpe.RANKS)
    made = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = slots.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return divergence.judge(docs, divergence.references(docs)).select("doc_id", *divergence.COUNTS, "base_failed", "kept")


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose two texts hold control strings."""
    probe = "</s>[INST] ok [/INST]"
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(
        turns.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    )


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = chat.read_back(chat.examples(with_probe(table(spark, sf_dir, "conversations"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = exact_dedup.merge(table(spark, sf_dir, "documents"))
    return merged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: each was fetched on a day of 2024 that follows from its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 365).cast("int")).alias("fetched"))


def entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the sites among the pages: the last three labels of a host.

    Each site is added to one of four lists, every third one is removed again, and every
    ninth one comes back.
    """
    host = url_lists.host_of(F.col("url"))
    site = F.substring_index(host, ".", -3)
    sites = pages.where(host.isNotNull()).groupBy(site.alias("pattern")).agg(F.min("page_id").alias("m"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    m = F.col("m")
    first = m * 31 % 250
    acts = F.array(
        F.struct(F.lit("add").alias("action"), day(first).alias("day")),
        F.when(m % 3 == 0, F.struct(F.lit("remove").alias("action"), day(first + 40 + m % 20).alias("day"))),
        F.when(m % 9 == 0, F.struct(F.lit("add").alias("action"), day(first + 70 + m % 30).alias("day"))),
    )
    names = F.element_at(F.array(*[F.lit(x) for x in ("adult", "malware", "spam", "allow")]), (m % 4 + 1).cast("int"))
    return sites.select(names.alias("list"), "pattern", F.explode(F.array_compact(acts)).alias("a")).select("list", "pattern", "a.action", "a.day")


def op9_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.evaluate(captures(pages), entries(pages)).select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "lists", "pattern", "blocked")


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_quality.fit(docs, table(spark, sf_dir, "labels"))
    return rule_quality.classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_byte_bpe,
        op3_virtual_slots,
        op4_divergence,
        op5_prefix_targets,
        op6_simhash,
        op7_packing,
        op8_exact_dedup,
        op9_temporal_url_lists,
        op10_rule_ensemble,
        op11_lexical_search,
        op12_periodic_runs,
        op13_license_scan,
    )
}

ORACLE_SQL = {
    "op11_lexical_search": lexical.ORACLE,
    "op13_license_scan": license_scan.oracle_sql(),
    "op4_divergence": r"""
with d as (select doc_id, lang, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
k as (select doc_id, lang, n, n - length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as c1, n - length(regexp_replace(t, '\p{Ll}+', '', 'g')) as c2, n - length(regexp_replace(t, '\p{Lu}+', '', 'g')) as c3,
  n - length(regexp_replace(t, '\p{Nd}+', '', 'g')) as c4, n - length(translate(t, '#*$%&|<>', '')) as c5, n - length(translate(t, '.,;:!?"''()-', '')) as c6 from d),
s as (select doc_id, lang, c5 as n_symbols, n - c1 as word_chars, [c1, c2, c3, c4, c5, c6, n - c1 - c2 - c3 - c4 - c5 - c6] as c, n from k),
e as (select doc_id, lang, unnest(c) as c, n, unnest(range(7)) as i from s where n > 0),
hist as (select lang, i, (20000 * c + n) // (2 * n) as cell, count(*) as n from e group by all),
cum as (select lang, i, cell, sum(n) over (partition by lang, i order by cell) as upto, sum(n) over (partition by lang, i) as total from hist),
m as (select lang, i, min(cell) as cell from cum where 2 * upto >= total group by all),
tok as (select doc_id, lang, trim(unnest(regexp_split_to_array(lower(t), '\s+')), '.,;:!?"''()[]#*$%&|<>') as word from d),
tc as (select doc_id, lang, word, count(*) as n from tok where word <> '' group by all),
lw as (select lang, word, sum(n) as n from tc group by all),
en as (select lang, sum(n) as total from lw group by 1 having sum(n) >= 500),
rc as (select lang, i, cell / (sum(cell) over (partition by lang))::double as q from m join en using (lang)),
rw as (select lang, word, n / total as q from lw join en using (lang) qualify row_number() over (partition by lang order by n desc, word) <= 64),
jc as (select doc_id, sqrt(greatest(0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as js
  from (select e.doc_id, e.c::double / e.n as p, rc.q from e join rc using (lang, i)) group by 1),
dn as (select doc_id, lang, sum(n) as n from tc group by all),
bins as (select dn.doc_id, coalesce(tc.n, 0) / dn.n as p, rw.q from dn join rw using (lang) left join tc on tc.doc_id = dn.doc_id and tc.word = rw.word),
full_bins as (from bins union all select doc_id, 1 - sum(p), greatest(0, 1 - sum(q)) from bins group by 1),
jw as (select doc_id, sqrt(greatest(0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as js from full_bins group by 1),
near as (select doc_id, greatest(jc.js / 0.18, coalesce(jw.js, 1) / 0.45) as worst from jc left join jw using (doc_id)),
w as (select doc_id, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as word, unnest(range(len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')))) as i from d),
g as (select doc_id, i, word || ' ' || lead(word) over v || ' ' || lead(word, 2) over v as gram from w window v as (partition by doc_id order by i)),
h as (select doc_id, i from g where gram is not null qualify count(*) over (partition by doc_id, gram) > 1),
r as (select doc_id, count(distinct i + o) as n from h cross join (values (0), (1), (2)) x(o) group by 1),
nw as (select doc_id, count(*) as n from w group by 1),
ln as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
dl as (select doc_id, count(*) - count(distinct line) as n from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
b as (select s.doc_id, coalesce(nw.n, 0) as n_words, word_chars, n_symbols, coalesce(dl.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, worst
  from s left join nw using (doc_id) left join dl using (doc_id) left join r using (doc_id) left join near using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(worst, 0) <= 1 as kept from f""",
    "op5_prefix_targets": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
  length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\]|\[NL\])', '\1+', 'g')) as c,
  length(regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\]|\[NL\])', '\1+', 'g')) + 3 * (length(role) - length(replace(role, chr(10), ''))) as rc
  from t),
f as (select *, case when role = 'assistant' then c + 7 else c + rc + 20 end - case when role = 'assistant' then 0 else 1 end as size from e),
g as (select *, sum(size) over (partition by conv_id order by pos) as upto, count(*) over (partition by conv_id) as n from f)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'assistant' or pos = n then upto else 0 end)::bigint as formatted_chars
from g group by conv_id""",
    "op8_exact_dedup": r"""
with d as (select doc_id, length(coalesce(text, '')) as n_chars,
  sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as text_sha256 from documents),
r as (select *, first_value(doc_id) over w as keep_id, row_number() over w as nth, count(*) over (partition by text_sha256) as group_size
  from d window w as (partition by text_sha256 order by n_chars desc, doc_id nulls last))
select doc_id, keep_id, group_size, nth = 1 as kept, text_sha256 from r""",
    "op9_temporal_url_lists": r"""
with p as (select page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', ''), '') as host,
  (date '2024-01-01' + (page_id * 7919 % 365)::int)::date as fetched from pages),
s as (select regexp_extract(host, '([^.]*\.)?([^.]*\.)?[^.]*$') as pattern, min(page_id) as m from p where host is not null group by 1),
e as (
  select case m % 4 when 0 then 'adult' when 1 then 'malware' when 2 then 'spam' else 'allow' end as list, pattern, a.action, (date '2024-01-01' + a.day::int)::date as day
  from (select m, pattern, unnest([{'action': 'add', 'day': m * 31 % 250},
    case when m % 3 = 0 then {'action': 'remove', 'day': m * 31 % 250 + 40 + m % 20} end,
    case when m % 9 = 0 then {'action': 'add', 'day': m * 31 % 250 + 70 + m % 30} end]) as a from s) where a is not null),
c as (select list, pattern, day, max(action) as action from e group by all),
b as (select *, lag(action) over (partition by list, pattern order by day) as before from c),
i as (select list, pattern, action, day as valid_from, lead(day) over (partition by list, pattern order by day) as valid_to from b where action is distinct from before),
t as (select distinct host, fetched from p where host is not null),
u as (select host, fetched, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) as domain from t),
v as (select host, fetched, string_agg(distinct list, ',' order by list) as lists, arg_max(pattern, length(pattern)) as pattern,
  coalesce(max(case when list <> 'allow' then length(pattern) end), 0) > coalesce(max(case when list = 'allow' then length(pattern) end), 0) as blocked
  from u join i on u.domain = i.pattern and i.action = 'add' and valid_from <= fetched and (valid_to is null or fetched < valid_to) group by host, fetched)
select p.page_id, p.host, p.fetched::varchar as fetched, coalesce(v.lists, '') as lists, v.pattern, coalesce(v.blocked, false) as blocked
from p left join v on p.host = v.host and p.fetched = v.fetched""",
}
