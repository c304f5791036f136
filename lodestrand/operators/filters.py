"""Metadata filters: normalisation, and chunks meeting many filters at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import strip

FILTER_KEYS = ("document_id", "domain", "category", "version", "origin", "visibility")
#: Columns of a chunk that filters compare.
META = FILTER_KEYS
#: Bit of each field that a filter may leave open; visibility always counts.
BITS = {key: 1 << i for i, key in enumerate(FILTER_KEYS[:-1])}


def normalize_filters(filters: Column) -> Column:
    """Struct (filters, error) of a map: known keys with stripped, non-blank values, or why not. Visibility is no key: it is always public."""
    cleaned = F.transform_values(filters, lambda k, v: strip(v))
    unknown = F.array_except(F.map_keys(filters), F.array(*map(F.lit, BITS)))
    blank = F.exists(F.map_values(cleaned), lambda v: v == "")
    error = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(F.array_sort(unknown), ","))).when(blank, "blank")
    return F.struct(F.when(error.isNull(), cleaned).alias("filters"), error.alias("error"))


def matches_filter(chunk: str = "", flt: str = "f_") -> Column:
    """Null means any value in five fields; visibility always has to be equal (default public)."""
    out = F.coalesce(F.col(f"{flt}visibility"), F.lit("public")) == F.col(f"{chunk}visibility")
    for key in FILTER_KEYS[:-1]:
        out = out & (F.col(f"{flt}{key}").isNull() | (F.col(f"{flt}{key}") == F.col(f"{chunk}{key}")))
    return out


def with_filter_prefix(filters: DataFrame) -> DataFrame:
    return filters.select("filter_id", *(F.col(k).alias(f"f_{k}") for k in FILTER_KEYS))


def _mask() -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.col(k).isNotNull(), bit).otherwise(0) for k, bit in BITS.items()))


def filter_masks(filters: DataFrame) -> list[int]:
    """Which fields filters ask for, as sums of :data:`BITS`: at most 32 numbers, however many filters there are."""
    return sorted(r[0] for r in filters.select(_mask().alias("mask")).distinct().collect())


def asked_fields(masks: list[int]) -> list[str]:
    """Fields that some filter asks for; visibility is one always."""
    return [k for k, bit in BITS.items() if any(m & bit for m in masks)] + ["visibility"]


def meet(rows: DataFrame, filters: DataFrame, masks: list[int], on: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the columns of each filter of ``filters`` that lets them through, and whose columns ``on`` are equal.

    A row is looked up once for each set of fields that filters ask for, under its own values of just
    these fields. So the join is on equal keys, and no row meets a filter that it fails.
    """
    fields = asked_fields(masks)
    others = [c for c in filters.columns if c not in FILTER_KEYS and c not in on]
    asked = filters.select(
        *others, *(F.col(c).alias(f"_f_{c}") for c in on), _mask().alias("_f_mask"), *(F.col(k).alias(f"_f_{k}") for k in fields[:-1]),
        F.coalesce("visibility", F.lit("public")).alias("_f_visibility"),
    )
    spread = rows.select("*", F.explode(F.array(*map(F.lit, masks or [-1]))).alias("_mask"))
    same = (F.col("_mask") == F.col("_f_mask")) & (F.col("visibility") == F.col("_f_visibility"))
    for key in fields[:-1]:
        same = same & F.when(F.col("_mask").bitwiseAND(F.lit(BITS[key])) != 0, F.col(key)).eqNullSafe(F.col(f"_f_{key}"))
    for c in on:
        same = same & (F.col(c) == F.col(f"_f_{c}"))
    return spread.join(asked, same).select(*rows.columns, *others)


def apply_filters(chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """``(filter_id, chunk_id)`` of chunks that each filter lets through."""
    return meet(chunks, filters, filter_masks(filters)).select("filter_id", "chunk_id")
