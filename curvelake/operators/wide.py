"""Attribute-value rows into one wide, typed row per entity.

Method: the rows are parted by attribute into typed narrow tables (entity, value, row_id). Balanced groups of narrow
tables are each combined by one multiway outer join: their union is exchanged once by entity and one aggregate puts the
values of an entity side by side. The groups, by then co-partitioned and sorted by entity, hang on the list of all
entities by left outer joins, which lose none and, unlike full ones, keep partitioning and order. So every narrow table is
exchanged once, nothing between the levels, and no task holds more than GROUPS sorted inputs however many attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.session import cut

WAYS, GROUPS = 8, 8  # narrow tables of a group at least; groups at most


def norm_name(name: Column) -> Column:
    """The letters and digits of an attribute name, letter case aside."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def reads_as(val: Column, value_type: Column, unit: Column) -> Column:
    """The value in a plain spelling where val, trimmed, reads as value_type, else null.

    double: a finite number, decimal comma, exponent and the unit behind it allowed. bigint: whole, a fraction of zeros
    allowed. boolean: true, false, yes, no, 1, 0 in any case. string: not empty.
    """
    text = F.regexp_replace(val, r"^[\s ]+|[\s ]+$", "")
    bare = F.when(unit.isNotNull() & text.endswith(unit) & (F.length(unit) > 0), F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(unit)))).otherwise(text)
    number = F.regexp_replace(F.regexp_extract(bare, r"^([-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][-+]?\d+)?)$", 1), ",", ".").try_cast("double")
    double = F.when(number.isNotNull() & (F.abs(number) < float("inf")), number.cast("string"))
    whole = F.regexp_extract(text, r"^([-+]?\d+)(?:[.,]0*)?$", 1).try_cast("bigint").cast("string")
    flag = F.lower(text)
    boolean = F.when(flag.isin("true", "yes", "1"), F.lit("true")).when(flag.isin("false", "no", "0"), F.lit("false"))
    string = F.when(F.length(text) > 0, text)
    return F.when(value_type == "double", double).when(value_type == "bigint", whole).when(value_type == "boolean", boolean).when(value_type == "string", string)


def filled_cells(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """variant, metric, value (as text), row_id: the row that fills each cell, latest recorded_at, then smaller row_id.

    Rows with a null variant, an attribute that isn't in the catalog or a value that doesn't read as its type fill
    nothing. A null recorded_at is older than any other. Folds map-side, so a hot variant or attribute stays small.
    """
    known = catalog.select(F.col("metric").alias("_metric"), "value_type", "unit", norm_name(F.col("metric")).alias("_key"))
    joined = rows.select("variant", "metric", "val", "recorded_at", "row_id").withColumn("_key", norm_name(F.col("metric"))).join(known, "_key")
    read = joined.withColumn("_value", reads_as(F.col("val"), F.col("value_type"), F.col("unit"))).where(F.col("_value").isNotNull() & F.col("variant").isNotNull())
    best = F.max_by(F.struct("_value", "row_id"), F.struct("recorded_at", (-F.col("row_id")).alias("r")))
    return read.groupBy("variant", F.col("_metric").alias("metric")).agg(best.alias("b")).select("variant", "metric", F.col("b._value").alias("value"), F.col("b.row_id").alias("row_id"))


def widen(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per variant that has a filled cell; per catalog attribute a typed column and <attribute>__row_id.

    The catalog is a small fixed table; its names and types are read on the driver, as they become the columns. An
    attribute without a value stays as a column of nulls. Empty rows: no rows, all columns. Further columns of rows are
    ignored, so their names can't clash.
    """
    attributes = [(r["metric"], r["value_type"]) for r in catalog.select("metric", "value_type").where(F.col("metric").isNotNull()).distinct().orderBy("metric").collect()]
    # As they come out of the aggregate, by (variant, attribute): a hot attribute is spread over all tasks, however large.
    # Sorted by attribute, so that a narrow table's scan skips the row groups of the others.
    cells = cut(filled_cells(rows, catalog).sortWithinPartitions("metric", "variant"), "cells")
    entities = cells.select("variant").distinct()
    ways = max(WAYS, -(-len(attributes) // GROUPS))
    wide = entities
    for at in range(0, len(attributes), ways):
        wide = wide.join(_multiway(cells, attributes[at : at + ways]), "variant", "left")
    return wide


def _multiway(cells: DataFrame, attributes: list[tuple[str, str]]) -> DataFrame:
    """The outer join of the attributes' narrow tables: variant, and of each attribute its typed value and row_id."""
    pair = lambda i, value, row_id: F.struct(value.alias("v"), row_id.alias("r")).alias(f"c{i}")
    union = None
    for i, (name, kind) in enumerate(attributes):
        empty = [F.lit(None).cast(f"struct<v:{k},r:bigint>").alias(f"c{j}") for j, (_, k) in enumerate(attributes)]
        empty[i] = pair(i, F.col("value").cast(kind), F.col("row_id"))
        narrow = cells.where(F.col("metric") == name).select("variant", *empty)
        union = narrow if union is None else union.unionAll(narrow)
    side_by_side = union.groupBy("variant").agg(*[F.first(f"c{i}", ignorenulls=True).alias(f"c{i}") for i in range(len(attributes))])
    return side_by_side.select("variant", *[c for i, (name, _) in enumerate(attributes) for c in (F.col(f"c{i}.v").alias(name), F.col(f"c{i}.r").alias(f"{name}__row_id"))])


def filled(wide: DataFrame) -> DataFrame:
    """variant, metric, row_id of each filled cell of a table made by widen."""
    names = [c[: -len("__row_id")] for c in wide.columns if c.endswith("__row_id")]
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}__row_id`").alias("row_id")) for n in names])
    return wide.select("variant", F.explode(entries).alias("c")).where(F.col("c.row_id").isNotNull()).select("variant", "c.metric", "c.row_id")
