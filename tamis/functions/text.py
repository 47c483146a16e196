"""Text and key functions: HTML to text, urls, slugs, company and role keys, tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, written out: Java's \s and other engines' differ on what it holds.
SPACE = r"[ \t\n\r\f\x0B]"

# Query parameters that only track where a visitor came from.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "source", "ref", "referrer", "trk")
# Legal forms at the end of company names.
COMPANY_SUFFIXES = (
    "gmbh", "mbh", "ug", "sas", "sa", "s.a.", "sarl", "s.a.r.l.", "bv", "b.v.", "nv", "n.v.",
    "ltd", "llc", "inc", "plc", "ag", "kg", "oy", "ab", "as",
    "spa", "s.p.a.", "srl", "s.r.l.", "sro", "s.r.o.", "oyj", "kft",
)
# Words that say nothing about a preference.
STOP_WORDS = (
    "the", "and", "for", "with", "a", "an", "of", "in", "to", "on", "at", "by",
    "or", "as", "is", "be", "our", "we", "you", "your", "this", "that", "from",
    "month", "months", "fixed", "term", "contract", "permanent", "time", "full",
    "part", "remote", "hybrid", "onsite", "on-site", "role", "job", "position",
    "team", "new", "all", "are", "will", "have", "has",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_html(html: Column, entities: bool = True) -> Column:
    """Text of HTML on one line; entities also decodes the commonest four."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    if entities:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def strip_html_lines(html: Column) -> Column:
    """Text of HTML with line breaks where paragraphs and breaks were."""
    out = F.regexp_replace(html, r"(?i)<br[ ]*/?>|<p>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def resolve_url(base: str, url: Column) -> Column:
    """An absolute url; a path from the root, or a bare slug, is put under base (which ends in a slash for slugs)."""
    origin = re.match(r"[a-z]+://[^/]+", base)[0]
    return F.when(F.lower(url).rlike("^https?:"), url).when(F.startswith(url, F.lit("/")), F.concat(F.lit(origin), url)).otherwise(F.concat(F.lit(base), url))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def slug_title(slug: Column) -> Column:
    """A display name from a lower-case slug."""
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def title_split(raw: Column) -> Column:
    """struct(company, title) of 'Company | Title', 'Company: Title' or 'Title at Company'; company is null otherwise."""
    at_pipe, at_colon = F.locate("|", raw), F.locate(":", raw)
    at_word = F.char_length(raw) - F.char_length(F.substring_index(raw, " at ", -1))
    rest = lambda n: F.trim(F.substring(raw, n, F.char_length(raw)))
    head = lambda n: F.trim(F.substring(raw, F.lit(1), n))
    piped = F.struct(head(at_pipe - 1).alias("company"), rest(at_pipe + 1).alias("title"))
    colon = F.struct(head(at_colon - 1).alias("company"), rest(at_colon + 1).alias("title"))
    worded = F.struct(rest(at_word + 1).alias("company"), head(at_word - 4).alias("title"))
    plain = F.struct(F.lit(None).cast("string").alias("company"), F.trim(raw).alias("title"))
    return F.when(at_pipe > 1, piped).when((at_colon > 1) & (at_colon <= 40), colon).when(at_word > 4, worded).otherwise(plain)


def normalize_url(url: Column, drop: Sequence[str] = TRACKING_PARAMS) -> Column:
    """A url without tracking parameters, fragment and one slash at the path's end, its host in lower case."""
    out = F.regexp_replace(url, "#.*$", "")
    names = "|".join(re.escape(p) for p in sorted(drop, key=lambda p: (-len(p), p)))
    out = F.regexp_replace(out, f"([?&])(({names})(=[^&]*)?(&|$))+", "$1")
    out = F.regexp_replace(out, "[?&]$", "")
    out = F.regexp_replace(out, r"^([A-Za-z][^:/?]*://[^/?]+/[^?]*[^?/])/(\?|$)", "$1$2")
    origin = F.regexp_extract(out, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.concat(F.lower(origin), F.substring(out, F.char_length(origin) + 1, F.char_length(out)))


def url_hash(url: Column) -> Column:
    """A stable id: the first 20 hex digits of the url's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 20)


def dashed(text: Column) -> Column:
    """A slug without dashes at its ends."""
    return F.regexp_replace(slugify(text), "^-+|-+$", "")


def role_key(company: Column, title: Column) -> Column:
    """company::title, both as slugs; what follows a bar in a title doesn't count."""
    return F.concat(dashed(company), F.lit("::"), dashed(F.trim(F.substring_index(title, "|", 1))))


def normalize_company(name: Column, suffixes: Sequence[str] = COMPANY_SUFFIXES) -> Column:
    """Lower-case company name without legal forms, however many of them end it."""
    forms = "|".join(re.escape(s) + "[.]?" for s in sorted(suffixes, key=lambda s: (-len(s), s)))
    out = F.regexp_replace(collapse(F.lower(name)), "[.]$", "")
    return F.regexp_replace(F.regexp_replace(out, f"( ({forms})| & ?co[.]?)+$", ""), "[.]$", "")


def base_title(title: Column) -> Column:
    return collapse(F.lower(F.substring_index(title, "|", 1)))


def tokenize(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct lower-case tokens of three characters or more that are no stop words."""
    parts = F.split(F.lower(text), "[^a-z0-9.+#]+")
    return F.array_except(F.filter(parts, lambda w: F.char_length(w) >= 3), F.array(*[F.lit(w) for w in stop]))


def strip_dashes(text: Column) -> Column:
    """Prose without dashes: spaced ones become commas, those inside words spaces."""
    out = F.regexp_replace(text, f"{SPACE}*[—–―‒]{SPACE}*", ", ")
    out = F.regexp_replace(out, f"{SPACE}+-{SPACE}+", ", ")
    out = F.regexp_replace(out, "([A-Za-z0-9_])-([A-Za-z0-9_])", "$1 $2")
    out = F.replace(out, F.lit("-"), F.lit(""))
    out = F.regexp_replace(out, f",{SPACE}*,", ",")
    return F.trim(F.regexp_replace(out, "[ \t]{2,}", " "))


def word_count(text: Column) -> Column:
    """Words between white space; 0 in an empty text."""
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def any_of(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    """Whether a lower-case text holds one of the terms, as a substring or as whole words."""
    if match == "word":
        return text.rlike(alternation(terms))
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a lower-case text holds."""
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(text, F.lit(t)).cast("int")
    return out


def alternation(terms: Sequence[str]) -> str:
    """A pattern of whole words for lower-case text; ASCII boundaries, without look-around."""
    return "(^|[^a-z0-9_])(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")([^a-z0-9_]|$)"
