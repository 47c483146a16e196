"""Rule packs: ordered rejections that give a row one reason, the filter, the funnel and the purge.

A pack is a list of (reason, Column). Everything that depends on the rules is derived from
the one column that they compile to, so the parts can't drift apart.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.infer import detect_language
from ..functions.text import SPACE, alternation, any_of, hits, word_count


@dataclass(frozen=True)
class RulePack:
    rules: tuple[tuple[str, Column], ...]

    def reason(self) -> Column:
        """The first rule that rejects a row; null if none does. A rule that is null doesn't reject."""
        return F.coalesce(*[F.when(c, F.lit(r)) for r, c in self.rules])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn("reject_reason", self.reason())

    def passed(self, df: DataFrame) -> DataFrame:
        """Rows that no rule rejects; one filter a rule, so that each can move below the joins it doesn't need."""
        for _, c in self.rules:
            df = df.where(~F.coalesce(c, F.lit(False)))
        return df

    def funnel(self, df: DataFrame, breaks: Mapping[str, Column] | None = None) -> DataFrame:
        """stage, reason, detail, n and percent (of all rows of df), in the rules' order, in one pass.

        breaks gives a detail for the rows that a rule rejects; such a rule has one line a detail.
        """
        parts = F.coalesce(*[F.when(F.col("reject_reason") == r, c) for r, c in (breaks or {}).items()], F.lit(None).cast("string"))
        counts = self.apply(df).groupBy("reject_reason", parts.alias("detail")).agg(F.count("*").alias("n"))
        everything = Window.partitionBy()  # a row a rule and detail
        counts = counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 2))
        order = df.sparkSession.createDataFrame([(i, r) for i, (r, _) in enumerate(self.rules)], "stage int, reason string")
        lines = order.join(counts, F.col("reason") == F.col("reject_reason"), "left")
        return lines.select("stage", "reason", "detail", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("percent", F.lit(0.0)).alias("percent"))

    def purge(self, df: DataFrame, key: str, details: Mapping[str, Column]) -> DataFrame:
        """key, rule and detail of every row that a rule rejects, as a purge of old rows lists them."""
        text = F.coalesce(*[F.when(F.col("reject_reason") == r, c.cast("string")) for r, c in details.items()], F.lit(""))
        return self.apply(df).where(F.col("reject_reason").isNotNull()).select(key, F.col("reject_reason").alias("rule"), text.alias("detail"))


def older_than(published: Column, as_of: Column, hours: int, missing_passes: bool = True) -> Column:
    """Rejects what was published more than so many hours ago."""
    return F.coalesce(published < as_of - F.expr(f"interval {hours} hours"), F.lit(not missing_passes))


def off_topic(title: Column, text: Column, needed: Sequence[str], unrelated: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return ~any_of(F.concat(low, F.lit(" "), F.lower(F.coalesce(text, F.lit("")))), needed) | any_of(low, unrelated)


def region_blocked(regions: Column, allowed: Sequence[str]) -> Column:
    """Rejects a non-empty list of regions of which none holds an allowed name."""
    return (F.size(regions) > 0) & ~F.exists(regions, lambda r: any_of(F.lower(r), allowed))


def article_url(url: Column, article: str, wanted: str) -> Column:
    path = F.lower(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    return path.rlike(article) & ~path.rlike(wanted)


def blocked_company(company_key: Column, names: Sequence[str]) -> Column:
    """Rejects a normalised company name that holds a listed one as whole words."""
    return company_key.rlike(alternation(names))


def blocked_by_list(df: DataFrame, company_key: str, names: DataFrame) -> DataFrame:
    """As blocked_company for a list (name) of any length: rows without a blocked name.

    An index from one word of each name to the name, the word that fewest names hold, is met by
    equality with the words of the distinct company names, and what meets is then compared as
    a whole. A name without a letter or digit blocks nothing.
    """
    word = "[a-z0-9_]+"
    told = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(word), F.lit(0)))).alias("_word"))
    held = told.groupBy("_word").agg(F.count("*").alias("_n"))
    index = told.join(held, "_word").groupBy("name").agg(F.min_by("_word", F.struct("_n", "_word")).alias("_word"))
    companies = df.select(F.col(company_key).alias("_key")).where("_key is not null").distinct()
    words = companies.select("_key", F.explode(F.array_distinct(F.regexp_extract_all("_key", F.lit(word), F.lit(0)))).alias("_word"))
    whole = F.concat(F.lit(r"(^|[^a-z0-9_])\Q"), "name", F.lit(r"\E([^a-z0-9_]|$)"))
    bad = words.join(index, "_word").where(F.rlike("_key", whole)).select("_key").distinct()
    return df.join(bad, F.col(company_key) == F.col("_key"), "left_anti")


def wrong_language(found: Column, wanted: str, team_signal: Column, home: Column, title: Column | None = None, accents: str = "[àâéèêëîïôùûüçœæäöüß]") -> Column:
    """Rejects another language, and the wanted one where an accented title is in another; the home country passes."""
    other = (found != wanted) & ~team_signal
    if title is not None:
        other = other | ((found == wanted) & F.lower(title).rlike(accents) & (detect_language(title) != wanted))
    return other & ~home


def role_excluded(title: Column, text: Column, roles: Sequence[str], nouns: Sequence[str]) -> Column:
    """Rejects excluded roles in a title, or in the text's first line where the title names no role at all."""
    low = F.lower(title)
    first = F.lower(F.substring_index(text, "\n", 1))
    return any_of(low, roles) | (~any_of(low, nouns) & any_of(first, roles))


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    """Whole-word occurrences of terms: plain words in one pass over the text, others (like node.js) in one each."""
    low, plain = F.lower(text), [t for t in terms if re.fullmatch("[a-z0-9_]+", t)]
    whole = lambda names: F.regexp_count(low, F.lit(f"(?<![a-z0-9_])(?:{'|'.join(map(re.escape, names))})(?![a-z0-9_])"))
    out = whole(plain) if plain else F.lit(0)
    for t in terms:
        if t not in plain:
            out = out + whole([t])
    return out


def term_dominance(df: DataFrame, title: str, text: str, terms_a: Sequence[str], terms_b: Sequence[str], phrases: Sequence[str] = ()) -> DataFrame:
    """df with a and b (how often the terms occur) and rejected: where the wanted terms B are a passing mention beside A.

    A title with B and three mentions of B pass; a title with A and at most two of B, or
    three of A and at most one of B, are rejected; so are the given phrases, always. Terms
    are counted in a projection of their own, so each text is read once a list.
    """
    both = F.concat_ws(" ", title, text)
    n = df.withColumns({"a": count_terms(both, terms_a), "b": count_terms(both, terms_b), "_a": count_terms(F.col(title), terms_a), "_b": count_terms(F.col(title), terms_b)})
    stated = any_of(F.lower(both), phrases) if phrases else F.lit(False)
    a, b = F.col("a"), F.col("b")
    verdict = F.when(stated, True).when((F.col("_b") > 0) & (b >= 3), False).otherwise(((F.col("_a") > 0) & (b <= 2)) | ((a >= 3) & (b <= 1)))
    return n.withColumn("rejected", verdict).drop("_a", "_b")


def distinct_hits(title: Column, text: Column, title_out: Sequence[str], tools: Sequence[str], core: Sequence[str], least: int = 3, most: int = 1) -> Column:
    both = F.lower(F.concat_ws(" ", title, text))
    return any_of(F.lower(title), title_out) | ((hits(both, tools) >= least) & (hits(both, core) <= most))


# Levels of language skill in their order.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")


def language_requirement(langs: Column, text: Column, phrases: Sequence[str], known: Sequence[str] = ("EN", "ENG"), reject_from: str = "B1") -> Column:
    """struct(reject, note) from array<struct<code, level, required>> and phrases.

    A required language at a level to be rejected, or a phrase, rejects; optional or lower
    ones are noted.
    """
    rank = lambda level: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.upper(level)).cast("int"), F.lit(0))
    foreign = F.filter(F.coalesce(langs, F.array().cast("array<struct<code:string,level:string,required:boolean>>")), lambda x: ~F.upper(x["code"]).isin(*known))
    hard = F.filter(foreign, lambda x: F.coalesce(x["required"], F.lit(True)) & (rank(x["level"]) >= LEVELS.index(reject_from) + 1))
    shown = F.array_join(F.transform(foreign, lambda x: F.concat_ws(" ", F.upper(x["code"]), F.upper(x["level"]), F.when(~F.coalesce(x["required"], F.lit(True)), "(optional)"))), ", ")
    return F.struct(((F.size(hard) > 0) | any_of(F.lower(text), phrases)).alias("reject"), F.nullif(shown, F.lit("")).alias("note"))


def cooccurrence(text: Column, token: str, others: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit(token)) & any_of(low, others)


# Patterns of where remote work is allowed, as whole words; open ones are met anywhere.
SCOPES: Mapping[str, Sequence[str]] = {
    "restricted": (
        "us[ -]?only", "usa only", "united states only", "remote *[(]us[)]", "remote us", "us remote", "remote in the us",
        "us[ -]based", "based in the us", "us residents?", "must be located in the us", "must reside in the us",
        "us work authorization", "authorized to work in the us", "us citizens?", "green card", "w-?2",
        "canada only", "us or canada", "us/canada", "us & canada", "north america only", "na only", "us/ca",
        "latam", "latin america", "argentina only", "brazil only", "mexico only", "americas only", "apac", "asia-pacific",
        "india only", "australia only", "us or latam",
        "pacific hours", "pst hours", "est hours", "us pacific", "us eastern", "overlap with us", "us time ?zone", "us timezones", "us business hours",
        "strong overlap w(?:ith)?/? ?(?:us )?eastern(?: us)? time ?zone", "est overlap", "us east coast hours", "americas time ?zone",
    ),
    "label": ("united states",),
    "open": (
        "emea", "europe", "european", "eu remote", "remote eu", "eu only", "cet", "cest", "utc+1", "utc+2", "worldwide", "global", "anywhere",
        "germany", "deutschland", "belgium", "belgique", "belgie", "netherlands", "nederland", "luxembourg", "france", "ireland", "poland", "polska",
        "spain", "españa", "sweden", "sverige", "italy", "italia", "denmark", "danmark", "czech", "austria", "portugal", "finland", "greece",
        "hungary", "romania", "bulgaria", "croatia", "slovakia", "slovenia", "estonia", "latvia", "lithuania", "malta", "cyprus",
    ),
    "global": ("fully remote",),
}
# How a text demands residence in one country, C, and countries other than home.
RESIDENCE = (
    "must be based in (?:the )?C",
    "must be located in (?:the )?C",
    "C residents? only",
    "residents? of (?:the )?C only",
    "must reside in (?:the )?C",
    "only candidates? (?:currently )?living in (?:the )?C",
    "C[ -]based candidates? only",
    "open only to C residents",
)
COUNTRIES = (
    "netherlands", "belgium", "germany", "poland", "italy", "spain", "sweden", "denmark", "austria", "portugal", "ireland", "luxembourg", "finland", "greece",
    "hungary", "romania", "bulgaria", "croatia", "slovakia", "slovenia", "estonia", "latvia", "lithuania", "malta", "cyprus", "norway", "switzerland",
    "united kingdom", "the uk", "great britain", "czech republic", "czechia",
)


def remote_scope(label: Column, text: Column, countries: Sequence[str] = COUNTRIES, scopes: Mapping[str, Sequence[str]] = SCOPES, residence: Sequence[str] = RESIDENCE, head: int = 1500) -> Column:
    """Where remote work is allowed: restricted, single-country, open, global or unknown.

    The label and the text's first 1500 characters are asked. A region that is shut out comes first,
    then a demand to live in one country, which a mere mention of that country isn't; then
    mentions that open the place up.
    """
    a, b = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    either = lambda terms: any_of(a, terms) | any_of(b, terms)
    words = lambda patterns: F.lit(f"(^|[^a-z0-9_])(?:{'|'.join(patterns)})([^a-z0-9_]|$)")
    told = lambda patterns: F.rlike(a, words(patterns)) | F.rlike(b, words(patterns))
    names = "(?:" + "|".join(sorted((re.escape(c).replace("\\ ", "[ -]") for c in countries), key=lambda c: (-len(c), c))) + ")"
    return (
        F.when(told(scopes["restricted"]) | F.rlike(a, words(scopes["label"])), "restricted")
        .when(told([r.replace("C", names) for r in residence]), "single-country")
        .when(either(scopes["open"]), "open")
        .when(either(scopes["global"]), "global")
        .otherwise("unknown")
    )


@dataclass(frozen=True)
class Places:
    """Countries of a profile; codes or names, as the data has them."""

    preferred: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    europe: tuple[str, ...] = ()
    relocate: tuple[str, ...] = ()
    overseas: tuple[str, ...] = ()
    overseas_allowed: bool = False
    needs_support: tuple[str, ...] = ()
    tiers: tuple[tuple[str, ...], ...] = ()


def _verdict(score, priority: str, reason: str) -> Column:
    score = F.lit(score) if isinstance(score, int) else score
    return F.struct((F.lit(priority) != "rejected").alias("accept"), score.alias("score"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason"))


def location_score(country: Column, mode: Column, support: Column, scope: Column, places: Places) -> Column:
    """struct(accept, score, priority, reason) of where a posting is and how it is worked.

    The first case that fits decides; then an accepted posting in a tier's country gains 15,
    10 or 5 points, up to 100.
    """
    no = lambda why: _verdict(0, "rejected", why)
    plus = lambda base, more: F.when(support, base + more).otherwise(base)
    within = lambda names: country.isin(*names) if names else F.lit(False)
    remote, site = mode == "remote", mode == "on-site"
    europe = within(places.europe)
    core = (
        F.when(remote & (not places.overseas_allowed) & within(places.overseas), no("overseas"))
        .when(remote & scope.isin("restricted", "single-country"), no("remote is restricted"))
        .when(remote & scope.isin("open", "global"), _verdict(95, "acceptable", "open remote"))
        .when(remote, _verdict(85, "acceptable", "remote"))
        .when(country.isNull() & site, no("on site, place unknown"))
        .when(country.isNull(), _verdict(70, "backup", "place unknown"))
    )
    if places.targets:
        core = core.when(~country.isin(*places.targets), no("not a target country"))
    core = (
        core.when(within(places.excluded), no("excluded country"))
        .when(within(places.preferred), _verdict(100, "preferred", "preferred country"))
        .when(europe & within(places.needs_support) & ~support, no("needs relocation support"))
        .when(europe & site & within(places.relocate), _verdict(plus(65, 10), "acceptable", "target on site"))
        .when(europe & site & support, _verdict(70, "acceptable", "on site with support"))
        .when(europe & ~site & within(places.relocate), _verdict(plus(70, 10), "acceptable", "target hybrid"))
        .when(europe & ~site & support, _verdict(80, "acceptable", "hybrid with support"))
        .when(europe, no("no relocation support"))
        .when(F.lit(places.overseas_allowed) & within(places.overseas), _verdict(plus(50, 20), "acceptable", "overseas"))
        .otherwise(no("not an acceptable region"))
    )
    boost = F.lit(0)
    for names, points in reversed(list(zip(places.tiers, (15, 10, 5), strict=False))):
        boost = F.when(within(names), points).otherwise(boost)
    raised = F.when(core["accept"] & country.isNotNull(), F.least(F.lit(100), core["score"] + boost)).otherwise(core["score"])
    return F.struct(core["accept"].alias("accept"), raised.alias("score"), core["priority"].alias("priority"), core["reason"].alias("reason"))


def location_eligible(country: Column, mode: Column, text: Column, home: str, home_names: Sequence[str], near: Sequence[str], near_signals: Sequence[str], far: Sequence[str], far_signals: Sequence[str], strict: Sequence[str], strict_signals: Sequence[str]) -> Column:
    """The second gate on places: home always passes, the nearer a country the less it must say."""
    low = F.lower(text)
    remote = F.contains(low, F.lit("remote"))
    return (
        F.when((country == home) | any_of(low, home_names), True)
        .when(country.isin(*near), any_of(low, near_signals))
        .when(country.isin(*far), any_of(low, far_signals))
        .when(country.isin(*strict), remote & any_of(low, strict_signals))
        .when(country.isNull() & (mode == "remote"), True)
        .otherwise(remote)
    )


def outside_band(years: Column, least: int, most: int) -> Column:
    return F.coalesce(~years.between(least, most), F.lit(False))


def required_part(text: Column, optional: str = "nice to have|bonus points|preferred qualifications") -> Column:
    """The text before what is only nice to have; all of it if that comes first."""
    cut = F.regexp_replace(text, f"(?is).({optional}).*$", "")
    return F.when(cut == "", text).otherwise(cut)


def below_salary(monthly: Column, floor: float) -> Column:
    """Rejects a known salary under a floor."""
    return F.coalesce(monthly < floor, F.lit(False))


def lacks_groups(text: Column, a: Sequence[str], b: Sequence[str], c: Sequence[str], trusted: Column) -> Column:
    """Rejects what has neither a word of A nor one each of B and C, unless its feed is trusted."""
    low = F.lower(text)
    return ~(any_of(low, a) | (any_of(low, b) & any_of(low, c)) | trusted)


def near_demand(text: Column, others: Sequence[str], wanted: Sequence[str], demand: str = "required|must", within: int = 60) -> Column:
    """Rejects another term near a demand where the wanted ones don't occur."""
    low, names = F.lower(text), "|".join(map(re.escape, sorted(others, key=lambda t: (-len(t), t))))
    return low.rlike(f"({names}).{{0,{within}}}({demand})|({demand}).{{0,{within}}}({names})") & ~any_of(low, wanted)


def adaptive_threshold(text: Column, other_language: Column, english: Sequence[int] = (54, 56, 59), others: Sequence[int] = (45, 48, 52)) -> Column:
    """The score a posting must reach: lower for short texts and for other languages."""
    n = F.greatest(word_count(F.trim(text)), F.lit(1))
    step = lambda t: F.when(n < 120, t[0]).when(n < 350, t[1]).otherwise(t[2])
    return F.when(other_language, step(others)).otherwise(step(english))


def location_break(country: Column, mode: Column, places: Places) -> Column:
    """What kind of place was rejected: remote overseas, on site or hybrid in Europe, or another."""
    europe = country.isin(*places.europe)
    overseas = country.isin(*places.overseas) & F.lit(not places.overseas_allowed)
    return F.when((mode == "remote") & overseas, "overseas remote").when(europe & (mode == "on-site"), "europe on site").when(europe & (mode == "hybrid"), "europe hybrid").otherwise("other")


def dead_page(status: Column, body: Column, phrases: Sequence[str]) -> Column:
    """Whether a landed page says that its posting is gone; other errors don't."""
    return status.isin(404, 410) | ((status == 200) & any_of(F.lower(body), phrases))


