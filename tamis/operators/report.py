"""Analytics and reports over decided and pending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_rows(rows: DataFrame, as_of: Column, days: int | str | None) -> DataFrame:
    """Rows of the last 7, 30 or 90 days, or all; any other value means 30."""
    if days == "all":
        return rows
    n = days if days in (7, 30, 90) else 30
    return rows.where(F.col("ts") >= as_of - F.expr(f"interval {n} days"))


def within_windows(rows: DataFrame, as_of: Column, windows: tuple) -> DataFrame:
    """days and n for each window, all counted in one pass; days as in window_rows."""
    since = lambda d: F.lit(True) if d == "all" else F.col("ts") >= as_of - F.expr(f"interval {d if d in (7, 30, 90) else 30} days")
    once = rows.agg(*[F.count_if(since(d)).alias(str(d)) for d in windows])
    return once.select(F.explode(F.array(*[F.struct(F.lit(str(d)).alias("days"), F.col(str(d)).alias("n")) for d in windows])).alias("w")).select("w.*")


def primary_else(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary rows, or the fallback's where there isn't one primary row."""
    return primary.unionByName(fallback.where(~primary.select(F.lit(1)).exists()))


def counts(rows: DataFrame, by: Column, name: str) -> DataFrame:
    return rows.groupBy(by.alias(name)).agg(F.count("*").alias("n"))


def status_breakdown(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("applied", "dismissed", "pending")])


def bundle(rows: DataFrame) -> DataFrame:
    """section, label and n of all counts: each row gives one label for each section, counted together."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = rows.select("status", F.col("source").alias("source"), F.coalesce("country", F.lit("Unknown")).alias("country"), day.alias("day"), F.when(F.col("status") == "applied", F.col("source")).alias("applied_source"))
    sets = ("source", "country", "status", "day", "applied_source")
    labelled = rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("label")) for s in sets])).alias("x")).select("x.section", "x.label")
    return labelled.where(F.col("label").isNotNull()).groupBy("section", "label").agg(F.count("*").alias("n"))


def markdown_row(*cells: Column) -> Column:
    """A table row; bars inside cells are escaped."""
    safe = [F.replace(F.coalesce(c.cast("string"), F.lit("n/a")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))


def details(rows: DataFrame, place: str, lines: list[Column]) -> DataFrame:
    """place, nth and line: some lines on each of a few best rows; a line that is null is left out."""
    told = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return rows.select(place, F.posexplode(told).alias("nth", "line"))


#: From what risk on a match is marked. The two marks.
RISKY, MARKS = 40, ("⚠️", "✓")


def match_lines(title: Column, company: Column, url: Column, score: Column, country: Column, mode: Column, reasons: Column, salary: Column, risk: Column) -> list[Column]:
    """What a report says of one match; a line whose value is null isn't told."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return [
        line("## ", title, " — ", company),
        line("- Link: ", url),
        line("- Match score: ", score, "%"),
        line("- Place: ", country, ", ", mode),
        line("- Why it fits: ", reasons),
        line("- Salary: ", salary),
        line("- Fraud risk: ", risk, "% ", F.when(risk >= RISKY, MARKS[0]).otherwise(MARKS[1])),
    ]


def slim(df: DataFrame, caps: dict[str, int], blank: tuple[str, ...], lists: dict[str, int]) -> DataFrame:
    """A copy for keeping: large texts blank or cut, arrays short."""
    return df.withColumns({c: F.lit("") for c in blank} | {c: F.substring(c, 1, n) for c, n in caps.items()} | {c: F.slice(c, 1, n) for c, n in lists.items()})
