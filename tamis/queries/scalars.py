"""Text, key and inference functions over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infer, text
from ..plans import adapters as A
from . import lexicons as L
from . import query

S = r"[ \t\n\r\f\x0B]"
#: Reusable SQL fragments.
COLLAPSE = "trim(regexp_replace({}, '" + S + "+', ' ', 'g'))"


def sql_any(col: str, terms) -> str:
    return "(" + " or ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def sql_hits(col: str, terms) -> str:
    return "(" + " + ".join(f"contains({col}, '{t}')::int" for t in terms) + ")"


def pages(spark, d):
    return A.table(spark, d, "pages")


@query("strip_html", f"select page_id, sha256({COLLAPSE.format(chr(32).join(['replace(replace(replace(replace(regexp_replace(html, ', chr(39) + '<[^>]+>' + chr(39), ',', chr(39) + ' ' + chr(39), ',', chr(39) + 'g' + chr(39), ')']) + ''', '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')''')}) as text_sha from pages")
def _(spark, d):
    return pages(spark, d).select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("text_sha"))


@query("strip_html_lines", r"""select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?i)<br[ ]*/?>|<p>', chr(10), 'g'), '<[^>]+>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#x2F;', '/'), '&nbsp;', ' '), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'))) as text_sha from pages""")
def _(spark, d):
    return pages(spark, d).select("page_id", F.sha2(text.strip_html_lines(F.col("html")), 256).alias("text_sha"))


@query("resolve_url", """select page_id, case when page_id % 3 = 0 then url when page_id % 3 = 1 then 'https://base.example.org/' || ltrim(path, '/') else 'https://base.example.org/jobs/' || ltrim(path, '/') end as resolved
from (select page_id, url, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) as path from pages)""")
def _(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)?", 1)
    slug = F.ltrim(path, F.lit("/"))
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), slug)).otherwise(slug)
    return pages(spark, d).select("page_id", text.resolve_url("https://base.example.org/jobs/", raw).alias("resolved"))


@query("slugify", "select posting_id, regexp_replace(lower(company || ' ' || title), '[^a-z0-9]+', '-', 'g') as slug from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", text.slugify(F.concat_ws(" ", "company", "title")).alias("slug"))


@query("slug_title", """select n_nationkey, array_to_string(list_transform(string_split(replace(lower(n_name), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as name from nation""")
def _(spark, d):
    return A.table(spark, d, "nation").select("n_nationkey", text.slug_title(F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))).alias("name"))


@query("title_split", """with r as (select posting_id, case posting_id % 4 when 0 then company || ' | ' || title when 1 then company || ': ' || title when 2 then title || ' at ' || company else title end as raw from postings),
p as (select *, strpos(raw, '|') as a, strpos(raw, ':') as b, case when contains(raw, ' at ') then length(raw) - strpos(reverse(raw), ' ta ') + 1 else 0 end as w from r)
select posting_id, case when a > 1 then trim(raw[:a - 1]) when b > 1 and b <= 40 then trim(raw[:b - 1]) when w > 4 then trim(raw[w + 1:]) end as company,
  case when a > 1 then trim(raw[a + 1:]) when b > 1 and b <= 40 then trim(raw[b + 1:]) when w > 4 then trim(raw[:w - 4]) else trim(raw) end as title from p""", "postings")
def _(spark, d):
    i = F.col("posting_id") % 4
    raw = F.when(i == 0, F.concat_ws(" | ", "company", "title")).when(i == 1, F.concat_ws(": ", "company", "title")).when(i == 2, F.concat_ws(" at ", "title", "company")).otherwise(F.col("title"))
    return A.postings(spark, d).select("posting_id", text.title_split(raw).alias("t")).select("posting_id", "t.company", "t.title")


NORM_URL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '#.*$', ''), '([?&])((utm_campaign|utm_content|utm_medium|utm_source|utm_term|referrer|source|ref|trk)(=[^&]*)?(&|$))+', '\1', 'g'), '[?&]$', ''), '^([A-Za-z][^:/?]*://[^/?]+/[^?]*[^?/])/(\?|$)', '\1\2')"""


@query("normalize_url", f"select page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) || u[length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) + 1:] as url_norm from (select page_id, {NORM_URL.format('url')} as u from pages)")
def _(spark, d):
    return pages(spark, d).select("page_id", text.normalize_url(F.col("url")).alias("url_norm"))


@query("url_hash", "select page_id, substring(sha256(url), 1, 20) as id from pages")
def _(spark, d):
    return pages(spark, d).select("page_id", text.url_hash(F.col("url")).alias("id"))


DASHED = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
ROLE_KEY = f"{DASHED.format('company')} || '::' || {DASHED.format(chr(116) + 'rim(split_part(title, ' + repr('|') + ', 1))')}"


@query("role_key", f"select posting_id, {ROLE_KEY} as role_key from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", text.role_key(F.col("company"), F.col("title")).alias("role_key"))


FORMS = "|".join(s.replace(".", "[.]") + "[.]?" for s in sorted(text.COMPANY_SUFFIXES, key=lambda s: (-len(s), s)))
NORM_COMPANY = "regexp_replace(regexp_replace(regexp_replace(" + COLLAPSE.format("lower({})") + f", '[.]$', ''), '( ({FORMS})| & ?co[.]?)+$', ''), '[.]$', '')"


@query("normalize_company", f"select posting_id, {NORM_COMPANY.format('company')} as company_key from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", text.normalize_company(F.col("company")).alias("company_key"))


STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9.+#]+'), lambda w: length(w) >= 3 and not list_contains(" + STOPS + ", w)))"


TITLE_TOKENS = TOKENS.format("title || ' ' || company")


@query("tokenize", f"select posting_id, array_to_string(list_sort({TITLE_TOKENS}), ' ') as tokens from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", F.array_join(F.array_sort(text.tokenize(F.concat_ws(" ", "title", "company"))), " ").alias("tokens"))


@query("strip_dashes", f"""select posting_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '{S}*[—–―‒]{S}*', ', ', 'g'), '{S}+-{S}+', ', ', 'g'), '([A-Za-z0-9_])-([A-Za-z0-9_])', '\\1 \\2', 'g'), '-', ''), ',{S}*,', ',', 'g'), '[ \t]{{2,}}', ' ', 'g')) as clean
from (select posting_id, title || ' — ' || company || ' - ' || replace(title, ' ', '-') as t from postings)""", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", text.strip_dashes(F.concat("title", F.lit(" — "), "company", F.lit(" - "), F.replace("title", F.lit(" "), F.lit("-")))).alias("clean"))


WORDS = "len(list_filter(regexp_split_to_array({}, '" + S + "+'), lambda w: w <> ''))"
LANGUAGE = f"""case when fa / w > 0.02 or fa > 5 then 'fr' when da / w > 0.02 or da > 5 then 'de' when fs > es or ds > es then case when fs >= ds then 'fr' else 'de' end else 'en' end"""


def language_sql(where="documents", col="text", key="doc_id") -> str:
    p = infer.PHRASES
    return f"""(select {key}, greatest({WORDS.format(f'lower({col})')}, 1)::double as w, len(regexp_extract_all(lower({col}), '[àâéèêëîïôùûçœæ]')) as fa, len(regexp_extract_all(lower({col}), '[äöüß]')) as da,
  {sql_hits(f'lower({col})', p['fr'])} as fs, {sql_hits(f'lower({col})', p['de'])} as ds, {sql_hits(f'lower({col})', p['en'])} as es from {where})"""


@query("detect_language", f"select doc_id, {LANGUAGE} as detected from {language_sql()}")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", infer.detect_language(F.col("text")).alias("detected"))


@query("detect_language_votes", f"select doc_id, case when {sql_hits('lower(text)', L.PHRASES['fr'])} >= 2 then 'fr' when {sql_hits('lower(text)', L.PHRASES['de'])} >= 2 then 'de' else 'en' end as detected from documents")
def _(spark, d):
    packs = {k: L.PHRASES[k] for k in ("fr", "de")}
    return A.table(spark, d, "documents").select("doc_id", infer.detect_language_votes(F.col("text"), packs).alias("detected"))


@query("work_mode", f"""select posting_id, case when posting_id % 10 = 0 then work_mode else case when {sql_any('lower(description)', L.MODES[0][1])} then 'remote' when {sql_any('lower(description)', L.MODES[1][1])} then 'hybrid'
  when {sql_any('lower(description)', L.MODES[2][1])} then 'remote' else 'on-site' end end as mode from postings""", "postings")
def _(spark, d):
    hint = F.when(F.col("posting_id") % 10 == 0, F.col("work_mode"))
    return A.postings(spark, d).select("posting_id", infer.work_mode(F.col("description"), L.MODES, hint).alias("mode"))


PADDED = r"' ' || regexp_replace(lower({}), '[^\p{{L}}0-9]+', ' ', 'g') || ' '"


@query("infer_country", "with dim as (select * from (values " + ", ".join(f"('{n}', '{c}', {i})" for i, (n, c) in enumerate(L.PLACES)) + f""") v(name, code, ord)),
h as (select posting_id, min_by(code, ord) as code from postings join dim on contains({PADDED.format('title')}, ' ' || name || ' ') group by posting_id)
select p.posting_id, coalesce(h.code, case when lower(trim(title)) in ('', 'europe', 'remote') then 'FR' end) as country_code from postings p left join h using (posting_id)""", "postings")
def _(spark, d):
    dim = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(L.PLACES)], "name string, code string, ord int")
    return infer.infer_country(A.postings(spark, d), "title", dim, home="FR").select("posting_id", "country_code")


@query("infer_country_label", f"select posting_id, case " + " ".join(f"when contains({PADDED.format('title')}, ' {n} ') then '{c}'" for n, c in L.PLACES) + " end as country_code from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", infer.label_country(F.col("title"), dict(L.PLACES)).alias("country_code"))


NEAR = "der|und|of the"


@query("office_override", f"select posting_id, posting_id % 11 = 0 or regexp_matches(lower(description), '(?s)(with|dans).{{0,120}}({NEAR})|({NEAR}).{{0,120}}(with|dans)') as overseas from postings", "postings")
def _(spark, d):
    codes = F.when(F.col("posting_id") % 11 == 0, F.array(F.lit("FR"), F.lit("US"))).when(F.col("posting_id") % 11 == 1, F.array(F.lit("DE")))
    return A.postings(spark, d).select("posting_id", infer.office_override(codes, F.col("description"), ("with", "dans"), near=NEAR).alias("overseas"))


@query("city_extract", """select posting_id, coalesce(case when posting_id % 4 = 0 then country when posting_id % 4 = 1 then null end,
  case when contains(lower(label), 'ermany') then 'ermany' when contains(lower(label), 'apan') then 'apan' else nullif(regexp_replace(label, '^[0-9]+ - ', ''), '') end) as city
from (select *, (posting_id % 95)::varchar || ' - ' || country as label from postings)""", "postings")
def _(spark, d):
    label = F.concat((F.col("posting_id") % 95).cast("string"), F.lit(" - "), "country")
    area = F.when(F.col("posting_id") % 4 == 0, F.array(F.lit("world"), F.col("country")))
    return A.postings(spark, d).select("posting_id", infer.city_extract(label, area, ("ermany", "apan")).alias("city"))


YEARS_TEXT = """case doc_id % 6 when 0 then 'we ask ' || (doc_id % 12)::varchar || '-' || (doc_id % 12 + 3)::varchar || ' years' when 1 then (doc_id % 9)::varchar || '+ ans requis' when 2 then 'mindestens ' || (doc_id % 7)::varchar || ' Jahre'
  when 3 then (doc_id % 8)::varchar || ' years of solid experience' when 4 then 'Erfahrung von ' || (doc_id % 5)::varchar || ' Jahren' else text end"""


def years_text():
    i, n = F.col("doc_id"), lambda m: (F.col("doc_id") % m).cast("string")
    return (
        F.when(i % 6 == 0, F.concat(F.lit("we ask "), n(12), F.lit("-"), (i % 12 + 3).cast("string"), F.lit(" years")))
        .when(i % 6 == 1, F.concat(n(9), F.lit("+ ans requis")))
        .when(i % 6 == 2, F.concat(F.lit("mindestens "), n(7), F.lit(" Jahre")))
        .when(i % 6 == 3, F.concat(n(8), F.lit(" years of solid experience")))
        .when(i % 6 == 4, F.concat(F.lit("Erfahrung von "), n(5), F.lit(" Jahren")))
        .otherwise(F.col("text"))
    )


def years_sql(pack: str, col: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(lower({col}), '{p}', {g}), '')::int" for p, g in infer.YEAR_PACKS[pack]) + ")"


@query("min_years", f"select doc_id, {years_sql('en_fr_de', 'x')} as years from (select doc_id, {YEARS_TEXT} as x from documents)")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", infer.min_years(years_text()).alias("years"))


@query("min_years_packs", f"select doc_id, {years_sql('en', 'x')} as en, case when contains(lower(x), 'solid') then 0 else {years_sql('label', 'x')} end as label, coalesce(case when doc_id % 5 = 0 then (doc_id % 10)::int end, {years_sql('en_fr_de', 'x')}) as structured from (select doc_id, {YEARS_TEXT} as x from documents)")
def _(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", years_text().alias("x"))
    given = F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 10).cast("int"))
    return docs.select("doc_id", infer.min_years(F.col("x"), "en").alias("en"), infer.min_years(F.col("x"), "label", zero=("solid",)).alias("label"), infer.min_years(F.col("x"), structured=given).alias("structured"))


@query("salary_parse", r"""with r as (select posting_id, lower(case posting_id % 4 when 0 then 'de ' || (posting_id + 30000)::varchar || ' à ' || (posting_id + 40000)::varchar || ' Euros annuel' when 1 then '$' || (posting_id % 90 + 60)::varchar || 'k-$' || (posting_id % 90 + 80)::varchar || 'k'
   when 2 then (posting_id % 9 + 3)::varchar || ' 500 PLN / month' else 'competitive' end) as low from postings),
q as (select *, regexp_replace(low, '([0-9])[ ,.]([0-9]{3})', '\1\2', 'g') as plain from r),
v as (select *, nullif(regexp_extract(plain, '([0-9]+)(k?)[^0-9]+([0-9]+)(k?)', 1), '')::double as a, nullif(regexp_extract(plain, '([0-9]+)(k?)', 1), '')::double as s, nullif(regexp_extract(plain, '([0-9]+)(k?)[^0-9]+([0-9]+)(k?)', 3), '')::double as b, regexp_matches(plain, '[0-9]k') as k from q)
select posting_id, case when k and coalesce(a, s) < 1000 then coalesce(a, s) * 1000 else coalesce(a, s) end as lo, case when k and b < 1000 then b * 1000 else b end as hi,
 case when regexp_matches(low, '€|eur') then 'EUR' when regexp_matches(low, '[$]|usd') then 'USD' when regexp_matches(low, '£|gbp') then 'GBP' when regexp_matches(low, 'pln|zł') then 'PLN' when regexp_matches(low, 'chf') then 'CHF' end as currency,
 case when regexp_matches(low, 'annuel|/ ?an|year|annual|/ ?yr') then 'yearly' when regexp_matches(low, 'mensuel|/ ?mois|month') then 'monthly' end as period from v""", "postings")
def _(spark, d):
    i, n = F.col("posting_id"), lambda c: c.cast("string")
    label = (
        F.when(i % 4 == 0, F.concat(F.lit("de "), n(i + 30000), F.lit(" à "), n(i + 40000), F.lit(" Euros annuel")))
        .when(i % 4 == 1, F.concat(F.lit("$"), n(i % 90 + 60), F.lit("k-$"), n(i % 90 + 80), F.lit("k")))
        .when(i % 4 == 2, F.concat(n(i % 9 + 3), F.lit(" 500 PLN / month")))
        .otherwise("competitive")
    )
    return A.postings(spark, d).select("posting_id", infer.salary_parse(label).alias("s")).select("posting_id", F.col("s.low").alias("lo"), F.col("s.high").alias("hi"), "s.currency", "s.period")


MONTHLY = """m as (select p.posting_id, p.salary_yearly_min, p.salary_currency, case when posting_id % 7 = 0 then (2000 + posting_id % 3000)::double end as salary_min,
  case when posting_id % 7 = 0 then case when posting_id % 2 = 0 then 'monthly' else 'yearly' end end as salary_period from postings p),
e as (select m.*, case when salary_yearly_min is null and salary_period in ('month', 'monthly') then salary_min * rate else floor(coalesce(salary_yearly_min, salary_min) * rate / 12 + 0.5) end as monthly_eur
  from m left join rates on upper(coalesce(salary_currency, 'EUR')) = currency)"""


def with_monthly(spark, d):
    i = F.col("posting_id")
    p = A.postings(spark, d).withColumns({"salary_min": F.when(i % 7 == 0, (2000 + i % 3000).cast("double")), "salary_period": F.when(i % 7 == 0, F.when(i % 2 == 0, "monthly").otherwise("yearly"))})
    return infer.monthly_eur(p, A.rates(spark))


@query("monthly_eur", f"with {MONTHLY} select posting_id, round(monthly_eur, 2) as monthly_eur from e", "postings", "rates")
def _(spark, d):
    return with_monthly(spark, d).select("posting_id", F.round("monthly_eur", 2).alias("monthly_eur"))


SALARY_LABEL = """case when coalesce(salary_yearly_min, salary_min) is null or monthly_eur is null then 'salary not listed' else
  salary_currency || ' ' || format('{:,}', round_even(coalesce(salary_yearly_min, salary_min), 0)::bigint) || case when salary_yearly_min is not null then '/year' else '/month' end || ' (~EUR ' || format('{:,}', round_even(monthly_eur, 0)::bigint) || '/month)' end"""


def salary_label():
    return infer.salary_label(F.col("salary_yearly_min"), F.col("salary_min"), F.col("salary_currency"), F.col("monthly_eur"))


@query("salary_label", f"with {MONTHLY} select posting_id, {SALARY_LABEL} as label from e", "postings", "rates")
def _(spark, d):
    return with_monthly(spark, d).select("posting_id", salary_label().alias("label"))


@query("lexicon_flags", f"select posting_id, {sql_any('lower(description)', L.SPONSOR)} as sponsor, {sql_any('lower(description)', L.CLAUSES)} as clause from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", *infer.lexicon_flags(F.col("description"), {"sponsor": L.SPONSOR, "clause": L.CLAUSES}))


@query("signal_array", f"select posting_id, concat_ws(',', case when offers_relocation then 'flag' end, case when {sql_any('lower(description)', L.DOMAIN)} then 'language' end, case when posting_id % 400 <= 300 then 'small-team' end, case when 2000 + posting_id % 30 >= 2014 then 'recent' end) as signals from postings", "postings")
def _(spark, d):
    i = F.col("posting_id")
    signals = {"flag": F.col("offers_relocation"), "language": text.any_of(F.lower("description"), L.DOMAIN), "small-team": i % 400 <= 300, "recent": 2000 + i % 30 >= 2014}
    return A.postings(spark, d).select("posting_id", F.array_join(infer.signal_array(signals), ",").alias("signals"))


@query("partial_flag", "select posting_id, (length(x) > 0 and length(x) < 120) or length(x) >= 500 as partial, length(x) as n from (select posting_id, substring(description, 1, 500) as x from postings)", "postings")
def _(spark, d):
    cut = F.substring("description", 1, 500)
    return A.postings(spark, d).select("posting_id", infer.partial_flag(cut).alias("partial"), F.char_length(cut).cast("long").alias("n"))


@query("time_canon", """select event_id, strftime(case event_id % 5 when 4 then timestamp '2024-01-31 00:00:00' else date_trunc('second', ts) end, '%Y-%m-%d %H:%M:%S') as at from events""")
def _(spark, d):
    i, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    k, day = F.col("event_id") % 4, F.when(F.col("event_id") % 3 == 0, "E, ").otherwise("")
    east = F.date_format(ts - F.expr("interval 5 hours"), "d MMM yyyy HH:mm:ss")
    mail = F.when(k == 0, F.date_format(ts, "E, dd MMM yyyy HH:mm:ss Z")).when(k == 1, F.date_format(ts, "E, d MMM yyyy HH:mm:ss 'GMT'")).when(k == 2, F.concat(F.when(day != "", "Tue, ").otherwise(""), east, F.lit(" EST"))).otherwise(F.date_format(ts, "d MMM yyyy HH:mm:ss 'utc'"))
    e = A.table(spark, d, "events").select("event_id", F.when(i == 0, F.unix_timestamp(ts)).alias("s"), F.when(i == 1, F.unix_millis(ts)).alias("ms"), F.when(i == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 3, mail).when(i == 4, "no date").alias("t"))
    at = infer.time_canon(F.col("s"), F.col("ms"), F.col("t"), A.as_of())
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("array_join_text", "select posting_id, concat_ws(', ', company, country, nullif(language, 'en')) as joined from postings", "postings")
def _(spark, d):
    parts = F.array_compact(F.array("company", "country", F.nullif(F.col("language"), F.lit("en"))))
    return A.postings(spark, d).select("posting_id", F.array_join(parts, ", ").alias("joined"))


@query("stack_tag", "select posting_id, case when regexp_matches(lower(title), 'tion') then 'a' when regexp_matches(lower(title), 'und|der') then 'b' when regexp_matches(lower(title), 'que') then 'c' else 'other' end as tag from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", infer.first_label(F.col("title"), (("a", "tion"), ("b", "und|der"), ("c", "que")), "other").alias("tag"))


@query("score_band", "select posting_id, case when model_score >= 80 then 'high' when model_score >= 65 then 'good' else 'low' end as band from model_scores", "model_scores")
def _(spark, d):
    return A.model_scores(spark, d).select("posting_id", infer.score_band(F.col("model_score")).alias("band"))


@query("required_langs", """select posting_id, case when posting_id % 3 = 0 then upper(language) || ':B2:true' when posting_id % 3 = 1 then upper(language) || ':' || ':true' else '' end as langs from postings""", "postings")
def _(spark, d):
    from ..sources.variant import required_languages

    i = F.col("posting_id") % 3
    raw = F.when(i == 0, F.concat(F.lit('[{"languageCode":"'), "language", F.lit('","level":"b2"}]'))).when(i == 1, F.concat(F.lit('["'), "language", F.lit('"]'))).otherwise("[]")
    langs = required_languages(F.try_parse_json(raw))
    shown = F.transform(langs, lambda x: F.concat_ws(":", x["code"], F.coalesce(x["level"], F.lit("")), x["required"].cast("string")))
    return A.postings(spark, d).select("posting_id", F.array_join(shown, ",").alias("langs"))
