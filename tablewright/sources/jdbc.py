"""Tables of a database over JDBC, read and written in parallel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcSource:
    url: str
    driver: str
    user: str = ""
    password: str = ""
    fetch_size: int = 10_000

    def options(self, table: str) -> dict[str, str]:
        options = {
            "url": self.url,
            "driver": self.driver,
            "dbtable": table,
            "fetchsize": str(self.fetch_size),
        }
        if self.user:
            options |= {"user": self.user, "password": self.password}
        return options

    def split_options(self, column: str, low, high, partitions: int) -> dict[str, str]:
        """One range of `column` per task. The outer ranges are open, so rows beyond the bounds
        and rows with NULL are read too."""
        return {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }

    def read(self, spark: SparkSession, table: str, column: str, partitions: int) -> DataFrame:
        """A table in `partitions` ranges of an indexed column, between bounds the database
        looks up. Filters and column selection reach the database."""
        bounds = f"(select min({column}) lo, max({column}) hi from {table}) b"
        low, high = spark.read.format("jdbc").options(**self.options(bounds)).load().first()
        options = self.options(table)
        if low is not None:
            options |= self.split_options(column, low, high, partitions)
        return spark.read.format("jdbc").options(**options).load()

    def write(self, df: DataFrame, table: str, mode: str = "append", batch_size: int = 1000):
        df.write.format("jdbc").options(**self.options(table), batchsize=str(batch_size)).mode(
            mode
        ).save()
