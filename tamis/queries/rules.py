"""Rules, scores and second opinions over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infer, text
from ..operators import rules as R
from ..operators import score as P
from ..plans import adapters as A
from . import lexicons as L
from . import query
from .scalars import LANGUAGE, MONTHLY, NORM_COMPANY, WORDS, language_sql, sql_any, sql_hits, with_monthly

FULL = "lower(concat_ws(' ', title, description))"


def full():
    return F.concat_ws(" ", "title", "description")


def rule_query(name: str, sql: str, column):
    """A query that gives one boolean for each posting."""
    query(name, f"select posting_id, {sql} as rejected from postings", "postings")(lambda spark, d: A.postings(spark, d).select("posting_id", column().alias("rejected")))


rule_query("fresh_postings", "published_at < timestamp '2024-01-31 00:00:00' - interval 168 hours", lambda: R.older_than(F.col("published_at"), A.as_of(), 168))
rule_query("feed_relevance", f"not {sql_any(FULL, L.TECH)} or {sql_any('lower(title)', L.UNRELATED)}", lambda: R.off_topic(F.col("title"), F.col("description"), L.TECH, L.UNRELATED))
rule_query("region_allow", "posting_id % 3 <> 0 and not (contains(lower(country), 'an') or (posting_id % 3 = 2 and contains(lower(source), 'an')))", lambda: R.region_blocked(F.when(F.col("posting_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("posting_id") % 3 == 1, F.array("country")).otherwise(F.array("country", "source")), ("an",)))
rule_query("url_path_class", "regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '^/[a-z]{2}/') and not regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '^/en/')", lambda: R.article_url(F.col("url"), "^/[a-z]{2}/", "^/en/"))
rule_query("blocked_company", f"regexp_matches({NORM_COMPANY.format('company')}, '(^|[^a-z0-9_])({'|'.join(L.BLOCKED)})([^a-z0-9_]|$)')", lambda: R.blocked_company(text.normalize_company(F.col("company")), L.BLOCKED))
rule_query("title_exclusion", "regexp_matches(lower(title), '(^|[^a-z0-9_])(ein|que|the)([^a-z0-9_]|$)')", lambda: text.any_of(F.lower("title"), L.TITLE_OUT, "word"))
rule_query("role_exclusion", f"{sql_any('lower(title)', L.ROLE_OUT)} or (not {sql_any('lower(title)', L.ROLE_NOUNS)} and {sql_any('lower(split_part(description, chr(10), 1))', L.ROLE_OUT)})", lambda: R.role_excluded(F.col("title"), F.col("description"), L.ROLE_OUT, L.ROLE_NOUNS))


@query("language_fit", f"""with t as (select posting_id, {LANGUAGE} as lang from {language_sql('postings', 'title', 'posting_id')} w),
x as (select posting_id, {LANGUAGE} as lang from {language_sql('postings', 'description', 'posting_id')} w)
select p.posting_id, ((x.lang <> 'en' and not {sql_any('lower(p.description)', L.SPONSOR)}) or (x.lang = 'en' and regexp_matches(lower(p.title), '[àâéèêëîïôùûüçœæäöüß]') and t.lang <> 'en')) and p.country <> '{L.HOME_COUNTRY}' as rejected
from postings p join x using (posting_id) join t using (posting_id)""", "postings")
def _(spark, d):
    found = R.wrong_language(infer.detect_language(F.col("description")), "en", text.any_of(F.lower("description"), L.SPONSOR), F.col("country") == L.HOME_COUNTRY, F.col("title"))
    return A.postings(spark, d).select("posting_id", found.alias("rejected"))


def count_sql(col: str, terms) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"len(list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9_]+'), lambda w: w in ({names})))"


@query("term_dominance", f"""with c as (select posting_id, {count_sql("concat_ws(' ', title, description)", L.STACK_A)} as a, {count_sql("concat_ws(' ', title, description)", L.STACK_B)} as b,
  {count_sql('title', L.STACK_A)} > 0 as ta, {count_sql('title', L.STACK_B)} > 0 as tb, {sql_any(FULL, L.CLAUSES)} as stated from postings)
select posting_id, a::int as a, b::int as b, case when stated then true when tb and b >= 3 then false else (ta and b <= 2) or (a >= 3 and b <= 1) end as rejected from c""", "postings")
def _(spark, d):
    p = A.postings(spark, d).select("posting_id", "title", "description")
    return R.term_dominance(p, "title", "description", L.STACK_A, L.STACK_B, L.CLAUSES).select("posting_id", "a", "b", "rejected")


rule_query("distinct_hits_gate", f"{sql_any('lower(title)', L.UNRELATED)} or ({sql_hits(FULL, L.TOOLS)} >= 3 and {sql_hits(FULL, L.CORE)} <= 1)", lambda: R.distinct_hits(F.col("title"), F.col("description"), L.UNRELATED, L.TOOLS, L.CORE))


@query("language_requirement", f"""select posting_id, (language <> 'en' and posting_id % 2 = 0 and posting_id % 4 >= 2) or {sql_any('lower(description)', L.CLAUSES)} as rejected,
  case when language <> 'en' then upper(language) || ' ' || case when posting_id % 4 >= 2 then 'B2' else 'A2' end || case when posting_id % 2 = 0 then '' else ' (optional)' end end as note from postings""", "postings")
def _(spark, d):
    i = F.col("posting_id")
    langs = F.array(F.struct(F.col("language").alias("code"), F.when(i % 4 >= 2, "B2").otherwise("A2").alias("level"), (i % 2 == 0).alias("required")))
    return A.postings(spark, d).select("posting_id", R.language_requirement(langs, F.col("description"), L.CLAUSES).alias("r")).select("posting_id", F.col("r.reject").alias("rejected"), "r.note")


rule_query("clause_reject", sql_any(FULL, L.CLAUSES), lambda: text.any_of(F.lower(full()), L.CLAUSES))
rule_query("cooccurrence", f"contains(lower(description), 'tion') and {sql_any('lower(description)', L.UNRELATED)}", lambda: R.cooccurrence(F.col("description"), "tion", L.UNRELATED))

@query("blocked_company_list", f"""with b as (select lower(s_name) as name from supplier where s_acctbal < 0 union select lower(s_name) || ' gmbh' from supplier where s_acctbal > 9000 union select lower(n_name) || ' holding' from nation),
k as (select posting_id, {NORM_COMPANY.format('company')} as c from (select posting_id, case posting_id % 4 when 0 then country || ' Holding und ' || company when 1 then company || ' Werke' else company end as company from postings))
select posting_id from k where not exists (select 1 from b where regexp_matches(k.c, '(^|[^a-z0-9_])' || b.name || '([^a-z0-9_]|$)'))""", "postings")
def _(spark, d):
    """Postings whose company isn't on a long list, which is a table: names of one to three words."""
    s, n = (A.table(spark, d, x) for x in ("supplier", "nation"))
    low = F.lower("s_name")
    names = s.where("s_acctbal < 0").select(low.alias("name")).unionByName(s.where("s_acctbal > 9000").select(F.concat(low, F.lit(" gmbh")).alias("name"))).unionByName(n.select(F.concat(F.lower("n_name"), F.lit(" holding")).alias("name")))
    i = F.col("posting_id") % 4
    company = F.when(i == 0, F.concat("country", F.lit(" Holding und "), "company")).when(i == 1, F.concat("company", F.lit(" Werke"))).otherwise(F.col("company"))
    p = A.postings(spark, d).select("posting_id", text.normalize_company(company).alias("company_key"))
    return R.blocked_by_list(p, "company_key", names).select("posting_id")


# Labels and beginnings of texts that say, or only seem to say, where remote work is allowed.
LABELS = ("Remote", "Remote (US/CA)", "United States (Remote)", "Remote EMEA", "Remote (Global)", "Fully remote", "Lyon, France", "Poland-based candidates only")
HEADS = (
    "",
    "You must be based in the Netherlands for this role. ",
    "Our company is based in Germany. We hire worldwide. ",
    "Poland residents only, a distributed team. ",
    "Open only to Spain residents. ",
    "Candidates must reside in Germany. ",
    "Residents of the Czech Republic only. ",
    "Only candidates currently living in Italy. ",
    "Must overlap with US Pacific hours. ",
    "US citizens, please. ",
    "Canada only. ",
)
COUNTRY = "(netherlands|belgium|germany|poland|italy|spain|sweden|denmark|austria|portugal|ireland|luxembourg|finland|greece|hungary|romania|bulgaria|croatia|slovakia|slovenia|estonia|latvia|lithuania|malta|cyprus|norway|switzerland|united[ -]kingdom|the[ -]uk|great[ -]britain|czech[ -]republic|czechia)"
DEMANDS = f"must (be (based|located)|reside) in (the )?{COUNTRY}|{COUNTRY} residents? only|residents? of (the )?{COUNTRY} only|only candidates? (currently )?living in (the )?{COUNTRY}|{COUNTRY}[ -]based candidates? only|open only to {COUNTRY} residents"


def word_sql(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '(^|[^a-z0-9_])({pattern})([^a-z0-9_]|$)')"


@query("remote_scope", f"""with s as (select posting_id, lower({list(LABELS)}[posting_id % {len(LABELS)} + 1]) as a, lower(substring({list(HEADS)}[posting_id % {len(HEADS)} + 1] || description, 1, 1500)) as b from postings)
select posting_id, case when {word_sql('a', '|'.join(R.SCOPES['restricted']))} or {word_sql('b', '|'.join(R.SCOPES['restricted']))} or {word_sql('a', 'united states')} then 'restricted'
 when {word_sql('a', DEMANDS)} or {word_sql('b', DEMANDS)} then 'single-country' when {sql_any('a', R.SCOPES['open'])} or {sql_any('b', R.SCOPES['open'])} then 'open'
 when contains(a, 'fully remote') or contains(b, 'fully remote') then 'global' else 'unknown' end as scope from s""", "postings")
def _(spark, d):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("posting_id") % len(values) + 1).cast("int"))
    return A.postings(spark, d).select("posting_id", R.remote_scope(pick(LABELS), F.concat(pick(HEADS), "description")).alias("scope"))


PLACES = R.Places(preferred=(L.HOME_COUNTRY,), excluded=L.EXCLUDED_COUNTRIES, europe=L.EUROPE, relocate=("ROMANIA",), overseas=L.OVERSEAS, overseas_allowed=True, needs_support=("UNITED KINGDOM",), tiers=((L.HOME_COUNTRY,), L.TIER2, L.TIER3))


PLACED_SQL = """p as (select posting_id, work_mode as m, offers_relocation as s, case when posting_id % 13 = 0 then null else case posting_id % 9 when 0 then 'FRANCE' when 1 then 'GERMANY' when 2 then 'ROMANIA' when 3 then 'RUSSIA' when 4 then 'UNITED KINGDOM' when 5 then 'UNITED STATES' when 6 then 'CHINA' when 7 then 'CANADA' else country end end as c,
  case posting_id % 4 when 0 then 'open' when 1 then 'restricted' else 'unknown' end as scope from postings),
v as (select *, case when m = 'remote' and scope = 'restricted' then 0 when m = 'remote' and scope = 'open' then 95 when m = 'remote' then 85 when c is null and m = 'on-site' then 0 when c is null then 70
  when c in ('CHINA', 'RUSSIA') then 0 when c = 'FRANCE' then 100 when c = 'UNITED KINGDOM' and not s then 0 when c = 'ROMANIA' and m = 'on-site' then case when s then 75 else 65 end when c in ('GERMANY', 'UNITED KINGDOM') and m = 'on-site' and s then 70
  when c = 'ROMANIA' then case when s then 80 else 70 end when c in ('GERMANY', 'UNITED KINGDOM') and s then 80 when c in ('GERMANY', 'UNITED KINGDOM') then 0 when c in ('UNITED STATES', 'CANADA') then case when s then 70 else 50 end else 0 end as base from p)"""


def placed(postings):
    """postings with c (a country of the profile's, or none) and scope."""
    i = F.col("posting_id")
    names = F.element_at(F.array(*[F.lit(x) for x in ("FRANCE", "GERMANY", "ROMANIA", "RUSSIA", "UNITED KINGDOM", "UNITED STATES", "CHINA", "CANADA", "")]), (i % 9 + 1).cast("int"))
    country = F.when(i % 13 != 0, F.when(i % 9 == 8, F.col("country")).otherwise(names))
    return postings.withColumns({"c": country, "scope": F.when(i % 4 == 0, "open").when(i % 4 == 1, "restricted").otherwise("unknown")})


@query("location_score", f"""with {PLACED_SQL}
select posting_id, base > 0 as accept, case when base > 0 then least(100, base + case when c = 'FRANCE' then 15 when c in ('GERMANY', 'ROMANIA') then 10 when c = 'UNITED KINGDOM' then 5 else 0 end) else 0 end as score from v""", "postings")
def _(spark, d):
    rows = placed(A.postings(spark, d)).select("posting_id", "work_mode", "offers_relocation", "c", "scope")
    return rows.select("posting_id", R.location_score(F.col("c"), F.col("work_mode"), F.col("offers_relocation"), F.col("scope"), PLACES).alias("l")).select("posting_id", "l.accept", "l.score")


@query("location_eligible", f"""select posting_id, case when country = 'Nation_1' or {sql_any(FULL, ('les la',))} then true when country in ('Nation_2', 'Nation_3') then {sql_any(FULL, L.SPONSOR)} when country in ('Nation_4', 'Nation_5') then {sql_any(FULL, L.DOMAIN)}
  when country in ('Nation_6') then contains({FULL}, 'remote') and {sql_any(FULL, L.DOMAIN)} when country is null and work_mode = 'remote' then true else contains({FULL}, 'remote') end as eligible from (select * exclude (country), case when posting_id % 12 = 0 then null else country end as country from postings)""", "postings")
def _(spark, d):
    p = A.postings(spark, d).withColumn("country", F.when(F.col("posting_id") % 12 != 0, F.col("country")))
    got = R.location_eligible(F.col("country"), F.col("work_mode"), full(), "Nation_1", ("les la",), ("Nation_2", "Nation_3"), L.SPONSOR, ("Nation_4", "Nation_5"), L.DOMAIN, ("Nation_6",), L.DOMAIN)
    return p.select("posting_id", got.alias("eligible"))


rule_query("experience_band", "coalesce(experience_min < 2 or experience_min > 6, false)", lambda: R.outside_band(F.col("experience_min"), 2, 6))


@query("experience_cap", """with t as (select doc_id, case when doc_id % 2 = 0 then 'we ask 3 years of experience. nice to have: ' else '' end || (doc_id % 9)::varchar || '+ years' as x from documents),
r as (select doc_id, case when regexp_replace(x, '(?is).(nice to have).*$', '') = '' then x else regexp_replace(x, '(?is).(nice to have).*$', '') end as x from t)
select doc_id, coalesce(coalesce(nullif(regexp_extract(x, '([0-9]{1,2})[+] *years', 1), ''), nullif(regexp_extract(x, '([0-9]{1,2}) *years[^.]{0,40}experience', 1), ''))::int > 5, false) as rejected from r""")
def _(spark, d):
    i = F.col("doc_id")
    x = F.concat(F.when(i % 2 == 0, "we ask 3 years of experience. nice to have: ").otherwise(""), (i % 9).cast("string"), F.lit("+ years"))
    return A.table(spark, d, "documents").select("doc_id", F.coalesce(infer.min_years(R.required_part(x, "nice to have")) > 5, F.lit(False)).alias("rejected"))


@query("salary_floor", f"with {MONTHLY} select posting_id, coalesce(monthly_eur < 2500, false) as under_floor, coalesce(monthly_eur < 3300, false) as under_minimum from e", "postings", "rates")
def _(spark, d):
    return with_monthly(spark, d).select("posting_id", R.below_salary(F.col("monthly_eur"), 2500).alias("under_floor"), R.below_salary(F.col("monthly_eur"), 3300).alias("under_minimum"))


rule_query("keyword_groups", f"not ({sql_any(FULL, L.GROUP_A)} or ({sql_any(FULL, L.GROUP_B)} and {sql_any(FULL, L.GROUP_C)}) or source in ('src1', 'src2'))", lambda: R.lacks_groups(full(), L.GROUP_A, L.GROUP_B, L.GROUP_C, F.col("source").isin(*L.TRUSTED)))
rule_query("proximity_reject", "regexp_matches(lower(description), '(dans|und|was).{0,60}(that|nicht)|(that|nicht).{0,60}(dans|und|was)') and not (contains(lower(description), 'with') or contains(lower(description), 'les'))", lambda: R.near_demand(F.col("description"), ("was", "und", "dans"), ("with", "les"), "that|nicht"))


@query("adaptive_threshold", f"""select posting_id, case when {sql_any('lower(description)', L.PHRASES['de'])} then case when w < 120 then 45 when w < 350 then 48 else 52 end else case when w < 120 then 54 when w < 350 then 56 else 59 end end as threshold
from (select posting_id, description, greatest({WORDS.format('trim(description)')}, 1) as w from postings)""", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", R.adaptive_threshold(F.col("description"), text.any_of(F.lower("description"), L.PHRASES["de"])).alias("threshold"))


@query("dead_pages", "select page_id, status in (404, 410) or (status = 200 and (contains(lower(html), 'the of') or contains(lower(html), 'no longer'))) as dead from (select page_id, html, case page_id % 7 when 0 then 404 when 1 then 410 when 2 then 500 else 200 end as status from pages)")
def _(spark, d):
    i = F.col("page_id") % 7
    status = F.when(i == 0, 404).when(i == 1, 410).when(i == 2, 500).otherwise(200)
    return A.table(spark, d, "pages").select("page_id", R.dead_page(status, F.col("html"), ("the of", "no longer")).alias("dead"))


# The rule pack that the funnel, the purge and the ranking share.
PACK_SQL = f"""coalesce(case when regexp_matches({NORM_COMPANY.format('company')}, '(^|[^a-z0-9_])({'|'.join(L.BLOCKED)})([^a-z0-9_]|$)') then 'blocked_company' end,
  case when regexp_matches(lower(title), '(^|[^a-z0-9_])(ein|que|the)([^a-z0-9_]|$)') then 'title' end,
  case when {sql_any(FULL, L.CLAUSES)} then 'clause' end,
  case when not ({sql_any(FULL, L.GROUP_A)} or ({sql_any(FULL, L.GROUP_B)} and {sql_any(FULL, L.GROUP_C)}) or source in ('src1', 'src2')) then 'keywords' end,
  case when coalesce(experience_min < 0 or experience_min > 7, false) then 'experience' end,
  case when published_at < timestamp '2024-01-31 00:00:00' - interval 200 hours then 'stale' end)"""


def pack() -> R.RulePack:
    return R.RulePack(
        (
            ("blocked_company", R.blocked_company(text.normalize_company(F.col("company")), L.BLOCKED)),
            ("title", text.any_of(F.lower("title"), L.TITLE_OUT, "word")),
            ("clause", text.any_of(F.lower(full()), L.CLAUSES)),
            ("keywords", R.lacks_groups(full(), L.GROUP_A, L.GROUP_B, L.GROUP_C, F.col("source").isin(*L.TRUSTED))),
            ("experience", R.outside_band(F.col("experience_min"), 0, 7)),
            ("stale", R.older_than(F.col("published_at"), A.as_of(), 200)),
        )
    )


REST_SQL = PACK_SQL[: PACK_SQL.rindex(",")] + ")"  # without the last rule, freshness
FUNNEL_SQL = REST_SQL[:-1] + ", case when not v.base > 0 then 'location' end)"
STAGES = "(values (0, 'blocked_company'), (1, 'title'), (2, 'clause'), (3, 'keywords'), (4, 'experience'), (5, 'location')) s(stage, reason)"


@query("filter_funnel", f"""with {PLACED_SQL},
f as (select {FUNNEL_SQL} as reason, case when c in ('FRANCE', 'GERMANY', 'ROMANIA', 'RUSSIA', 'UNITED KINGDOM') and work_mode = 'on-site' then 'europe on site' when c in ('FRANCE', 'GERMANY', 'ROMANIA', 'RUSSIA', 'UNITED KINGDOM') and work_mode = 'hybrid' then 'europe hybrid' else 'other' end as place
  from postings join v using (posting_id) where published_at >= timestamp '2024-01-31 00:00:00' - interval 200 hours),
r as (select reason, case when reason = 'location' then place end as detail, count(*) as n from f group by all)
select stage, s.reason, detail, coalesce(n, 0)::bigint as n, coalesce(round(n * 100.0::double / (select count(*) from f), 2), 0) as percent from {STAGES} left join r on r.reason = s.reason""", "postings")
def _(spark, d):
    """Of the fresh postings, those that each rule rejects first; rejected places by their kind."""
    where = R.location_score(F.col("c"), F.col("work_mode"), F.col("offers_relocation"), F.col("scope"), PLACES)
    rules = R.RulePack((*pack().rules[:-1], ("location", ~where["accept"])))
    fresh = placed(A.postings(spark, d)).where(~R.older_than(F.col("published_at"), A.as_of(), 200))
    return rules.funnel(fresh, {"location": R.location_break(F.col("c"), F.col("work_mode"), PLACES)})


@query("rule_purge_rows", f"""with r as (select *, {PACK_SQL} as rule from postings)
select posting_id, rule, case rule when 'blocked_company' then company when 'title' then title when 'experience' then experience_min || ' years required' when 'stale' then 'found ' || strftime(published_at, '%Y-%m-%d') else '' end as detail from r where rule is not null""", "postings")
def _(spark, d):
    told = {"blocked_company": F.col("company"), "title": F.col("title"), "experience": F.concat(F.col("experience_min").cast("string"), F.lit(" years required")), "stale": F.concat(F.lit("found "), F.date_format("published_at", "yyyy-MM-dd"))}
    return pack().purge(A.postings(spark, d), "posting_id", told)


@query("rule_purge", f"select reason as rule, count(*) as n, min(posting_id) as first_id, max(posting_id) as last_id from (select posting_id, {PACK_SQL} as reason from postings) where reason is not null group by 1", "postings")
def _(spark, d):
    hit = pack().apply(A.postings(spark, d)).where(F.col("reject_reason").isNotNull())
    return hit.groupBy(F.col("reject_reason").alias("rule")).agg(F.count("*").alias("n"), F.min("posting_id").alias("first_id"), F.max("posting_id").alias("last_id"))


SIGNAL_SQL = "(" + " + ".join(f"case when contains({FULL}, '{t}') then {w} else 0 end" for t, w, _ in L.SIGNALS) + ")"
KEYWORD_SQL = f"(least({sql_hits(FULL, L.KEYWORDS)} * 3, 18) + " + " + ".join(f"case when {sql_any(FULL, g)} then 6 else 0 end" for g in L.GROUPS) + ")"


@query("signal_points", f"select posting_id, {SIGNAL_SQL} as points, concat_ws('; ', {', '.join(f'case when contains({FULL}, {chr(39)}{t}{chr(39)}) then {chr(39)}{r}{chr(39)} end' for t, _, r in L.SIGNALS)}) as reasons from postings", "postings")
def _(spark, d):
    points, reasons = P.signal_points(full(), L.SIGNALS)
    return A.postings(spark, d).select("posting_id", points.alias("points"), F.array_join(reasons, "; ").alias("reasons"))


@query("keyword_points", f"select posting_id, {KEYWORD_SQL} as points from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", P.keyword_points(full(), L.KEYWORDS, L.GROUPS).alias("points"))


TITLE_SQL = f"case when {sql_any('lower(title)', L.CORE)} then 8 else 0 end"
STARTUP_SQL = f"(case when posting_id % 5 = 1 then 8 else 0 end + case when source = 'src3' then 6 else 0 end + case when {sql_any(FULL, L.DOMAIN)} then 8 else 0 end + case when posting_id % 700 <= 300 then 5 else 0 end + case when 2000 + posting_id % 30 >= 2014 then 3 else 0 end)"
SPONSOR_SQL = f"case when offers_relocation or {sql_any(FULL, L.SPONSOR)} then 6 else 0 end"
DOMAIN_SQL = "case when regexp_matches(lower(description), '(^|[^a-z0-9_])(los|est|er)([^a-z0-9_]|$)') then 5 else 0 end"


def title_points():
    return F.when(text.any_of(F.lower("title"), L.CORE), 8).otherwise(0)


def startup():
    i = F.col("posting_id")
    return P.startup_points(i % 5 == 1, F.col("source") == "src3", text.any_of(F.lower(full()), L.DOMAIN), i % 700, 2000 + i % 30, 2024)


def sponsor():
    return F.when(F.col("offers_relocation") | text.any_of(F.lower(full()), L.SPONSOR), 6).otherwise(0)


def domain():
    return F.when(text.any_of(F.lower("description"), L.DOMAIN, "word"), 5).otherwise(0)


@query("component_points", f"select posting_id, {TITLE_SQL} as title, {STARTUP_SQL}::int as startup, {SPONSOR_SQL} as sponsor, {DOMAIN_SQL} as domain from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", title_points().alias("title"), startup().cast("int").alias("startup"), sponsor().alias("sponsor"), domain().alias("domain"))


SCORE_SQL = f"least(100, greatest(0, least(100, {SIGNAL_SQL} + {KEYWORD_SQL} + {TITLE_SQL} + {STARTUP_SQL} + {SPONSOR_SQL} + {DOMAIN_SQL})) + case when contains(lower(title), 'nicht') then 20 else 0 end)::int"


def score_parts():
    points, _ = P.signal_points(full(), L.SIGNALS)
    return {"signals": points, "keywords": P.keyword_points(full(), L.KEYWORDS, L.GROUPS), "title": title_points(), "startup": startup(), "sponsor": sponsor(), "domain": domain()}


def score_bonus():
    return F.when(F.contains(F.lower("title"), F.lit("nicht")), 20).otherwise(0)


def scored(postings):
    """postings with score and breakdown."""
    score, parts = P.final_score(score_parts(), score_bonus())
    return postings.withColumns({"score": score, "breakdown": parts})


@query("score_postings", f"select posting_id, {SCORE_SQL} as score, {SIGNAL_SQL}::int as signals, {KEYWORD_SQL}::int as keywords, {STARTUP_SQL}::int as startup from postings", "postings")
def _(spark, d):
    return scored(A.postings(spark, d)).select("posting_id", "score", "breakdown.signals", "breakdown.keywords", "breakdown.startup")


REASONS_SQL = f"array_to_string(list_filter([{', '.join(f'case when contains({FULL}, {chr(39)}{t}{chr(39)}) then {chr(39)}{r}{chr(39)} end' for t, _, r in L.SIGNALS)}, case when {SPONSOR_SQL} > 0 then 'sponsor' end, case when {DOMAIN_SQL} > 0 then 'domain' end, 'place: ' || country], lambda x: x is not null)[1:5], '; ')"


def reasons():
    """The first five reasons of a score, as one text."""
    _, found = P.signal_points(full(), L.SIGNALS)
    more = F.array_compact(F.array(F.when(sponsor() > 0, "sponsor"), F.when(domain() > 0, "domain"), F.concat(F.lit("place: "), "country")))
    return F.array_join(P.top_reasons(found, more), "; ")


@query("reasons_top5", f"select posting_id, {REASONS_SQL} as reasons from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", reasons().alias("reasons"))


RECONCILE_SQL = """case when model_score is null then case when code_veto then 'hard_skip' else 'no_model_data' end when code_veto or model_veto then 'hard_skip' when model_score < 55 then 'below_threshold' when fraud_score >= 72 then 'suspicious_fraud' else 'relevant' end"""


@query("reconcile_scores", f"select posting_id, reason, reason in ('relevant', 'no_model_data') as relevant from (select posting_id, {RECONCILE_SQL} as reason from (select *, posting_id % 17 = 0 as code_veto from model_scores))", "model_scores")
def _(spark, d):
    return P.reconcile(A.model_scores(spark, d).withColumn("code_veto", F.col("posting_id") % 17 == 0)).select("posting_id", "reason", "relevant")


@query("audit_scores", "select posting_id, case when model_veto then 0 else least(100, greatest(0, coalesce(case when posting_id % 19 = 0 then 170 when posting_id % 23 = 0 then -4 else model_score end, 50))) end as score from model_scores", "model_scores")
def _(spark, d):
    i = F.col("posting_id")
    raw = F.when(i % 19 == 0, 170).when(i % 23 == 0, -4).otherwise(F.col("model_score"))
    return A.model_scores(spark, d).select("posting_id", P.audit_score(raw, F.col("model_veto")).alias("score"))


@query("model_post_rules", f"""with {MONTHLY}, w as (select posting_id, {WORDS.format('trim(description)')} as w, array_to_string(string_split(title, ' ')[:3], ' ') as issues, array_to_string(string_split(description, ' ')[:8], ' ') as missing from postings)
select s.posting_id, fraud_score >= 72 as suspicious, coalesce(model_score, 50) >= case when w < 120 then 45 when w < 350 then 50 else 55 end as letter, coalesce(monthly_eur < 3299, false) as below_permit,
  (floor(coalesce(salary_yearly_min, salary_min) / 100 + 0.5) * 100)::bigint as rounded, issues, missing from model_scores s join w using (posting_id) join e using (posting_id)""", "postings", "model_scores", "rates")
def _(spark, d):
    n = text.word_count(F.trim("description"))
    said = P.capped({"issues": 3, "missing": 8})  # longer lists of a model's are cut
    p = with_monthly(spark, d).withColumns({"issues": F.split("title", " "), "missing": F.split("description", " ")}).withColumns(said)
    p = p.select("posting_id", n.alias("w"), "monthly_eur", F.coalesce("salary_yearly_min", "salary_min").alias("amount"), *[F.array_join(c, " ").alias(c) for c in said])
    least = F.when(F.col("w") < 120, 45).when(F.col("w") < 350, 50).otherwise(55)
    return A.model_scores(spark, d).join(p, "posting_id").select("posting_id", (F.col("fraud_score") >= 72).alias("suspicious"), (F.coalesce("model_score", F.lit(50)) >= least).alias("letter"), R.below_salary(F.col("monthly_eur"), 3299).alias("below_permit"), P.rounded_hundreds(F.col("amount")).alias("rounded"), "issues", "missing")


RANK = "offers_relocation desc, score desc, source_priority desc, published_at desc, posting_id"


def ranked(spark, d):
    """Postings that pass the pack, scored, with the keys of the ranking."""
    return scored(pack().passed(A.postings(spark, d)))


def rank_order():
    return [F.col("offers_relocation").desc(), F.col("score").desc(), F.col("source_priority").desc(), F.col("published_at").desc(), F.col("ingest_ordinal")]


@query("top_matches", f"select posting_id, title, company, score, published_at::varchar as published_at from (select *, {SCORE_SQL} as score from postings where {PACK_SQL} is null) order by {RANK} limit 20", "postings")
def _(spark, d):
    top = ranked(spark, d).orderBy(*rank_order()).limit(20)
    return top.select("posting_id", "title", "company", "score", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("near_misses", f"select posting_id, score from (select posting_id, {SCORE_SQL} as score from postings where {PACK_SQL} is null) where score < 90 order by score desc, posting_id limit 5", "postings")
def _(spark, d):
    return ranked(spark, d).where("score < 90").orderBy(F.col("score").desc(), "posting_id").limit(5).select("posting_id", "score")
