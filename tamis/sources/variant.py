"""Fields of loosely typed JSON, read through Spark's variant type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_path(value: Column, paths: Sequence[str], kind: str) -> Column:
    """The first of several paths that holds a value of a kind."""
    return F.coalesce(*[F.try_variant_get(value, p, kind) for p in paths])


def string_or_object(value: Column, names: Sequence[str] = ("displayName", "name", "addressLocality", "city")) -> Column:
    """A text that a feed gives either plainly or within an object."""
    return F.coalesce(*[F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, f"$.{n}", "string")) for n in names], F.when(~F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", "string")))


def first_list(value: Column, paths: Sequence[str]) -> Column:
    """The first path that holds a list with anything in it, as an array of variants."""
    lists = [F.try_variant_get(value, p, "array<variant>") for p in paths]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])


def required_languages(value: Column) -> Column:
    """array<struct<code, level, required>> of a list that mixes plain codes and objects with alias keys."""
    one = lambda v: F.struct(
        F.upper(F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("languageCode", "code", "language")], F.try_variant_get(v, "$", "string"))).alias("code"),
        F.upper(F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("level", "languageLevel")])).alias("level"),
        F.coalesce(F.try_variant_get(v, "$.required", "boolean"), F.lit(True)).alias("required"),
    )
    return F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), one), lambda x: x["code"].isNotNull())
