"""Joins, set operations and reshaping of feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """(left with the columns of right it lacks, their names); of right's rows with the same key the smallest counts."""
    added = [c for c in right.columns if c not in left.columns]
    if not added:
        return left, []
    one = right.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in added])).alias("_b"))
    return left.join(one, key, "left").select(*left.columns, *[F.col(f"_b.`{c}`").alias(c) for c in added]), added


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that replaces left's columns by right's of the same name."""
    stale = [c for c in right.columns if c in left.columns and c != key]
    return left.drop(*stale).join(right, key)


def in_all(df: DataFrame, key: str, item: str, items: Sequence[str]) -> DataFrame:
    """key: those that have every one of items."""
    return df.where(F.col(item).isin(*items) & F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(item).alias("_n")).where(F.col("_n") == len(set(items))).select(key)


def in_any(df: DataFrame, key: str, item: str, items: Sequence[str]) -> DataFrame:
    """key: those that have at least one of items."""
    return df.where(F.col(item).isin(*items) & F.col(key).isNotNull()).select(key).distinct()


def without(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key: those of a that b lacks."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_anti")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns by name; a column a frame lacks is null there; of two columns whose names differ in letter case only, the first stays."""

    def first_of_each(df: DataFrame) -> DataFrame:
        seen: set[str] = set()
        keep = [c for c in df.columns if not (c.lower() in seen or seen.add(c.lower()))]
        return df.select(*[F.col(f"`{c}`") for c in keep])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [first_of_each(f) for f in frames])


def replicas_or_pooled(replicas: DataFrame, pooled: DataFrame, key: str) -> DataFrame:
    """All replica rows, and the pooled rows of keys without any."""
    return replicas.unionByName(pooled.join(replicas.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def select_tokens(text: str, universe: Sequence[str]) -> list[str]:
    """The tokens of a text (parted by blanks, commas, semicolons) that are in the universe, each once, in order."""
    import re

    known = set(universe)
    return list(dict.fromkeys(t for t in re.split(r"[\s,;]+", text) if t in known))


def change_selection(current: Sequence[str], tokens: Sequence[str], how: str, universe: Sequence[str]) -> list[str]:
    """set, add, remove, toggle, invert or clear a selection within its universe; order is the universe's."""
    now, new = set(current), set(tokens)
    chosen = {"set": new, "add": now | new, "remove": now - new, "toggle": now ^ new, "invert": set(universe) - now, "clear": set()}[how]
    return [u for u in dict.fromkeys(universe) if u in chosen]


def pivot_stats(df: DataFrame, key: str, metric: str, stats: Sequence[str], names: Sequence[str]) -> DataFrame:
    """key and a column <metric>__<stat> for each name and stat (long rows, one per key and metric); the smallest non-null value.

    The names are given, so there is no job to find them, and the pivot is one aggregate.
    """
    return df.groupBy(key).agg(*[F.min(F.when(F.col(metric) == n, F.col(s))).alias(f"{n}__{s}") for n in names for s in stats])


def melt(df: DataFrame, key: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """key, name, value: one row per key row and column."""
    return df.unpivot([F.col(k) for k in key], [F.col(f"`{c}`") for c in columns], name, value)


def codes(df: DataFrame, column: str) -> DataFrame:
    """column, code: distinct non-null values numbered from 0 in sorted order (a small set of categories)."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def condensed_index(i: int, j: int, n: int) -> int:
    """Place of the pair i < j in the condensed form of an n x n distance matrix."""
    return n * i - i * (i + 1) // 2 + j - i - 1


def sample_keys(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """key: max(1, round(share * distinct keys)) keys, chosen by the order of their seeded hash (the sampling operator)."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    n = keys.count()
    return keys.orderBy(F.xxhash64(F.lit(seed), key), key).limit(max(1, int(share * n + 0.5)) if n else 0)


def cover(sets: dict[str, set[str]], most: int) -> list[str]:
    """Greedy set cover: again and again the set with the most uncovered members, the smaller name on ties."""
    left, out = set().union(*sets.values()) if sets else set(), []
    while left and len(out) < most:
        name = min(sets, key=lambda s: (-len(sets[s] & left), s))
        if not sets[name] & left:
            break
        out.append(name)
        left -= sets[name]
    return out
