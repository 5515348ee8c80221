"""Write semantics over immutable files: upsert, insert-if-absent, targeted update, artifacts, copy over JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def last_write(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order given: what a sequence of upserts leaves. Null keys are a key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key. new must have one row per key (see last_write)."""
    kept = old.join(new.select(*key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def absent(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key isn't in old; rows with a null key are new."""
    return new.join(old.select(*key), key, "left_anti")


def corrected(df: DataFrame, fixes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df with the columns taken from fixes where they are given there; fixes has one row per key."""
    f = fixes.select(*key, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    out = df.join(f, key, "left")
    return out.withColumns({c: F.coalesce(f"_fix_{c}", c) for c in columns}).drop(*[f"_fix_{c}" for c in columns]).select(*df.columns)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df holds: rescoring leaves no stale rows behind."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Appends to a history; every part file carries the header, readers take it with header=true."""
    df.write.mode("append").option("header", "true").csv(path)


def copy_jdbc(df: DataFrame, url: str, table: str, batch: int = 500, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


def report_lines(df: DataFrame, line: Column, order: list[Column], title: str) -> DataFrame:
    """A markdown report of a bounded result as one row: title and ordered lines. For digests, not for tables."""
    rows = df.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")).alias("x"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body")).select(F.concat(F.lit(f"# {title}\n\n"), F.col("body")).alias("report"))
