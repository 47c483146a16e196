"""Inference from text: language, country, place, work mode, experience, salary, tags, time.

Lexicons and pattern packs are parameters; the defaults are neutral.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, any_of, hits, let, word_count

# Phrases that tell languages apart.
PHRASES = {
    "fr": (
        "rejoignez", "nous recherchons", "vous serez", "vos missions", "votre profil", "profil recherché", "rémunération", "poste",
        "entreprise", "développeur", "ingénieur", "expérience", "compétences", "télétravail", "candidature", "nous vous", "dans le cadre",
    ),
    "de": (
        "wir suchen", "ihre aufgaben", "ihr profil", "was wir bieten", "kenntnisse", "entwickler", "berufserfahrung", "standort",
        "vollzeit", "festanstellung", "deutschkenntnisse",
    ),
    "en": (
        "we are looking", "you will", "requirements", "responsibilities", "join our", "we offer", "about us", "must have", "nice to have",
        "experience with", "what you", "the role", "ideal candidate",
    ),
}
# Phrase groups for work modes, asked in this order.
WORK_MODES = (
    ("remote", ("fully remote", "100% remote", "remote only", "full remote", "work from anywhere", "télétravail complet", "vollständig remote")),
    ("hybrid", ("hybrid", "hybride", "hybrides", "télétravail", "partial remote", "work from home", "homeoffice", "thuiswerken")),
    ("remote", ("remote",)),
)
# Words of the experience patterns.
YEARS = "(years?|yrs?|ann[ée]es?|ans|jahre?)"
KEYWORD = "(experience|exp[ée]rience|berufserfahrung|erfahrung)"
MINIMUM = "(minimum|at +least|au +moins|mindestens|mind[.]?)"

#: Pattern packs for min_years: (pattern on lower-case text, group of the number), asked in order.
YEAR_PACKS: Mapping[str, tuple[tuple[str, int], ...]] = {
    "en_fr_de": (
        (rf"([0-9]{{1,2}}){SPACE}*(to|-|–|à|bis){SPACE}*[0-9]{{1,2}}{SPACE}*{YEARS}", 1),
        (rf"([0-9]{{1,2}})[+]{SPACE}*{YEARS}", 1),
        (rf"{MINIMUM}{SPACE}*(of{SPACE}+|de{SPACE}+)?([0-9]{{1,2}}){SPACE}*{YEARS}", 3),
        (rf"([0-9]{{1,2}}){SPACE}*{YEARS}[^.]{{0,40}}?{KEYWORD}", 1),
        (rf"{KEYWORD}[^.]{{0,40}}?([0-9]{{1,2}}){SPACE}*{YEARS}", 2),
    ),
    "en": (
        (r"([0-9]{1,2})[+] *(years?|yrs?)", 1),
        (r"([0-9]{1,2}) *(to|-) *[0-9]{1,2} *(years?|yrs?)", 1),
        (r"(minimum|at least|min[.]?) +([0-9]{1,2}) +(years?|yrs?)", 2),
        (r"([0-9]{1,2}) +(years?|yrs?) +(of +)?(professional +)?experience", 1),
    ),
    "label": ((r"([0-9]{1,2}) *an", 1),),
}


def detect_language(text: Column, phrases: Mapping[str, Sequence[str]] = PHRASES, share: float = 0.02, most: int = 5) -> Column:
    """fr or de where a text has many of their letters or phrases, else en. Ties go to fr."""

    def of(low: Column) -> Column:
        words, out = F.greatest(word_count(low), F.lit(1)), F
        for code, letters in (("fr", "[àâéèêëîïôùûçœæ]"), ("de", "[äöüß]")):
            n = F.regexp_count(low, F.lit(letters))
            out = out.when((n / words > share) | (n > most), code)
        counted = F.struct(*[hits(low, phrases[k]).alias(k) for k in ("fr", "de", "en")])
        leads = lambda n: F.when((n["fr"] > n["en"]) | (n["de"] > n["en"]), F.when(n["fr"] >= n["de"], "fr").otherwise("de")).otherwise("en")
        return out.otherwise(let(counted, leads))

    return let(F.lower(text), of)


def detect_language_votes(text: Column, phrases: Mapping[str, Sequence[str]], least: int = 2, default: str = "en") -> Column:
    """The first language of which a text holds at least so many phrases."""
    low, out = F.lower(text), F
    for code, terms in phrases.items():
        out = out.when(hits(low, terms) >= least, code)
    return out.otherwise(default)


def work_mode(text: Column, modes: Sequence[tuple[str, Sequence[str]]] = WORK_MODES, hint: Column | None = None) -> Column:
    """A structured hint, or the first mode of which the text holds a phrase, or on-site."""
    low = F.lower(text)
    found = reduce(lambda acc, m: acc.when(any_of(low, m[1]), m[0]), modes, F).otherwise("on-site")
    return found if hint is None else F.coalesce(hint, found)


def place_words(text: Column) -> Column:
    """Lower-case words of a place or label, split at whatever is no letter or digit."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}0-9]+"), "")


def infer_country(df: DataFrame, label: str, dim: DataFrame, home: str | None = None, vague: Sequence[str] = ("", "europe", "remote")) -> DataFrame:
    """df with country_code: the code of the first place name (by ord) that the label holds as whole words.

    dim: name, code, ord. Labels are matched once each, however many rows carry one: every run
    of a label's words that is no longer than the longest name meets the names by equality.
    """
    low = F.lower(F.trim(label))
    names = dim.select(place_words(F.col("name")).alias("_words"), "code", "ord")
    longest = names.agg(F.max(F.size("_words"))).first()[0] or 0
    labels = df.select(F.col(label).alias("_label")).distinct().select("_label", place_words(F.col("_label")).alias("_w"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
    runs = [F.when(F.size("_w") >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]
    tried = labels.select("_label", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("_name")) if runs else labels.select("_label", F.lit(None).cast("string").alias("_name"))
    named = tried.join(names.select(F.array_join("_words", " ").alias("_name"), "code", "ord"), "_name")
    codes = named.groupBy("_label").agg(F.min_by("code", "ord").alias("_code"))
    joined = df.join(codes, F.col(label) == F.col("_label"), "left")
    return joined.withColumn("country_code", F.coalesce("_code", F.when(low.isin(*vague), F.lit(home)))).drop("_label", "_code")


def label_country(label: Column, hints: Mapping[str, str]) -> Column:
    """The code of the first hint that a label holds as whole words; null if none."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(label), "[^\\p{L}0-9]+", " "), F.lit(" "))
    return reduce(lambda acc, h: acc.when(F.contains(padded, F.lit(f" {h[0]} ")), h[1]), hints.items(), F).otherwise(F.lit(None).cast("string"))


def office_override(codes: Column, text: Column, cities: Sequence[str], country: str = "us", near: str = "office|per week|in[- ]person|on[- ]site") -> Column:
    """Whether any office code is the country's, or one of its cities stands within 120 characters of office words."""
    names = "|".join(sorted(cities, key=lambda c: (-len(c), c)))
    pattern = f"(?s)({names}).{{0,120}}({near})|({near}).{{0,120}}({names})"
    return F.coalesce(F.exists(codes, lambda c: F.lower(c) == country), F.lit(False)) | F.lower(text).rlike(pattern)


def city_extract(label: Column, area: Column, known: Sequence[str]) -> Column:
    """The last of an area list, or a known city in the label, or the label without a department number."""
    named = reduce(lambda acc, c: acc.when(F.contains(F.lower(label), F.lit(c)), c), known, F).otherwise(F.nullif(F.regexp_replace(label, "^[0-9]+ - ", ""), F.lit("")))
    return F.coalesce(F.try_element_at(area, F.lit(-1)), named)


def min_years(text: Column, pack: str | Sequence[tuple[str, int]] = "en_fr_de", structured: Column | None = None, zero: Sequence[str] = ()) -> Column:
    """Least years of experience a text asks for; a structured value comes first, words of zero mean 0."""
    low = F.lower(text)
    found = [F.nullif(F.regexp_extract(low, p, g), F.lit("")).cast("int") for p, g in (YEAR_PACKS[pack] if isinstance(pack, str) else pack)]
    none = [F.when(any_of(low, zero), F.lit(0))] if zero else []
    return F.coalesce(*([structured] if structured is not None else []), *none, *found)



def salary_parse(label: Column) -> Column:
    """struct(low, high, currency, period) of labels like '$100k-$150k', '3000 - 4000 EUR / month', 'de 30000 à 40000 Euros annuel'."""
    low = F.lower(label)
    plain = F.regexp_replace(low, "([0-9])[ ,.]([0-9]{3})", "$1$2")
    number = lambda g: F.nullif(F.regexp_extract(plain, r"([0-9]+)(k?)[^0-9]+([0-9]+)(k?)", g), F.lit(""))
    single = F.nullif(F.regexp_extract(plain, "([0-9]+)(k?)", 1), F.lit(""))
    thousand = plain.rlike("[0-9]k")
    scaled = lambda c: F.when(thousand & (c.cast("double") < 1000), c.cast("double") * 1000).otherwise(c.cast("double"))
    currency = F.when(low.rlike("€|eur"), "EUR").when(low.rlike("[$]|usd"), "USD").when(low.rlike("£|gbp"), "GBP").when(low.rlike("pln|zł"), "PLN").when(low.rlike("chf"), "CHF")
    period = F.when(low.rlike("annuel|/ ?an|year|annual|/ ?yr"), "yearly").when(low.rlike("mensuel|/ ?mois|month"), "monthly")
    return F.struct(scaled(F.coalesce(number(1), single)).alias("low"), scaled(number(3)).alias("high"), currency.alias("currency"), period.alias("period"))


def monthly_eur(df: DataFrame, rates: DataFrame) -> DataFrame:
    """df with monthly_eur from salary_yearly_min, or else salary_min and salary_period; null without a known rate.

    rates: currency, rate; a table of a few rows, which Spark broadcasts by its size.
    """
    yearly = F.col("salary_yearly_min").isNotNull()
    amount = F.coalesce("salary_yearly_min", "salary_min")
    month = ~yearly & F.col("salary_period").isin("month", "monthly")
    value = amount * F.col("rate")
    joined = df.join(rates.select(F.col("currency").alias("_currency"), "rate"), F.upper(F.coalesce("salary_currency", F.lit("EUR"))) == F.col("_currency"), "left")
    return joined.withColumn("monthly_eur", F.when(month, value).otherwise(F.floor(value / 12 + 0.5).cast("double"))).drop("_currency", "rate")


def salary_label(yearly: Column, amount: Column, currency: Column, monthly: Column) -> Column:
    """A readable salary: what is listed, and a month of it in EUR. By the rule of monthly_eur, also for the period."""
    known = F.coalesce(yearly, amount)
    unit = F.when(yearly.isNotNull(), "/year").otherwise("/month")
    text = F.concat(currency, F.lit(" "), F.format_number(known, 0), unit, F.lit(" (~EUR "), F.format_number(monthly, 0), F.lit("/month)"))
    return F.when(known.isNull() | monthly.isNull(), "salary not listed").otherwise(text)


def lexicon_flags(text: Column, lexicons: Mapping[str, Sequence[str]], match: str = "substring") -> list[Column]:
    """One boolean column for each named word list."""
    low = F.lower(text)
    return [any_of(low, terms, match).alias(name) for name, terms in lexicons.items()]


def signal_array(signals: Mapping[str, Column]) -> Column:
    """Names of the signals that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in signals.items()]))


def partial_flag(text: Column, short: int = 120, cap: int = 500) -> Column:
    """Whether a description is an excerpt: very short, or cut at a feed's cap."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return ((n > 0) & (n < short)) | (n >= cap)


# Zone names of mail dates.
ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def mail_time(text: Column) -> Column:
    """A timestamp from a date like 'Tue, 3 Jun 2003 04:00:00 GMT'; weekday and seconds may be missing."""
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]+, *", "")
    zones = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.try_element_at(zones, F.upper(F.regexp_extract(plain, "([A-Za-z]+)$", 1)))
    plain = F.coalesce(F.concat(F.regexp_replace(plain, "[A-Za-z]+$", ""), offset), plain)
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f"d MMM yyyy {t} Z")) for t in ("HH:mm:ss", "HH:mm")])


def time_canon(seconds: Column | None = None, millis: Column | None = None, text: Column | None = None, first_seen: Column | None = None) -> Column:
    """A timestamp from whichever form a feed gives; first_seen where it gives none."""
    found = []
    if seconds is not None:
        found.append(F.timestamp_seconds(seconds))
    if millis is not None:
        found.append(F.timestamp_millis(millis))
    if text is not None:
        found += [F.try_to_timestamp(text), mail_time(text)]
    return F.coalesce(*found, *([first_seen] if first_seen is not None else []))


def first_label(text: Column, patterns: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern found in the lower-case text."""
    low = F.lower(text)
    return reduce(lambda acc, p: acc.when(low.rlike(p[1]), p[0]), patterns, F).otherwise(F.lit(default))


def score_band(score: Column, high: int = 80, good: int = 65) -> Column:
    return F.when(score >= high, "high").when(score >= good, "good").otherwise("low")
