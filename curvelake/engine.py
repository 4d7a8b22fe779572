"""The engine: a session, the tables of a folder as views, and the queries by name."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from curvelake import plans
from curvelake.operators.tables import sample_keys
from curvelake.session import table


class Engine:
    """Tables of a folder, lazily. share: a seeded part of the variants, for a first look."""

    def __init__(self, spark: SparkSession, folder: str, share: float | None = None, seed: int = 0) -> None:
        self.spark, self.folder, self.share, self.seed = spark, folder, share, seed

    @property
    def names(self) -> list[str]:
        return sorted(p.stem for p in Path(self.folder).glob("*.parquet"))

    def table(self, name: str) -> DataFrame:
        df = table(self.spark, self.folder, name)
        if self.share is not None and "variant" in df.columns:
            df = df.join(sample_keys(df, "variant", self.share, self.seed), "variant", "left_semi")
        return df

    def sql(self, text: str) -> DataFrame:
        """SQL over all tables of the folder."""
        for name in self.names:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def run(self, query: str) -> DataFrame:
        """A query by its name, over the whole tables."""
        return plans.all_queries()[query](self.spark, self.folder)
