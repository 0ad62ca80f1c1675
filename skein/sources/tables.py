"""Cluster maps, metric files and run logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, local_id, vec_id) of a map: text (a cluster and its ids in a line; other lines are skipped), binary, JSON (an object in a line) or parquet."""
    end = path.rstrip("/").rsplit(".", 1)[-1]
    if end == "parquet":
        return spark.read.parquet(path)
    if end == "bin":
        vectors.register(spark)
        return spark.read.format("xclusters").load(path)
    if end == "json":
        pairs = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<bigint>>")).alias("c", "ids"))
        return pairs.select(F.col("c").cast("long").alias("cluster_id"), F.posexplode("ids").alias("local_id", "vec_id")).withColumn("local_id", F.col("local_id").cast("long"))
    if end == "txt":
        words = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+(\s+\d+)*\s*$")).select(F.split(F.trim("value"), r"\s+").cast("array<bigint>").alias("w"))
        return words.select(F.element_at("w", 1).alias("cluster_id"), F.posexplode(F.slice("w", F.lit(2), F.size("w"))).alias("local_id", "vec_id")).withColumn("local_id", F.col("local_id").cast("long"))
    raise ValueError(f"unknown cluster map {end}")


def write_cluster_map(members: DataFrame, path: str, form: str = "parquet") -> None:
    """A map as parquet, as text or JSON with a line for each cluster, or as a folder of binary files of whole clusters."""
    if form == "parquet":
        members.write.parquet(path)
        return
    ids = F.transform(F.array_sort(F.collect_list(F.struct("local_id", "vec_id"))), lambda s: s["vec_id"])
    each = members.groupBy("cluster_id").agg(ids.alias("ids"))
    if form == "bin":
        vectors.register(members.sparkSession)
        each.write.format("xclusters").mode("append").save(path)
    elif form == "txt":
        each.select(F.concat_ws(" ", F.col("cluster_id").cast("string"), F.array_join(F.col("ids").cast("array<string>"), " ")).alias("value")).write.text(path)
    elif form == "json":
        each.select(F.to_json(F.create_map(F.col("cluster_id").cast("string"), F.col("ids"))).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown cluster map {form}")


def write_metrics(rows: DataFrame, path: str) -> None:
    """A few rows of measurements as one CSV file with a header."""
    rows.coalesce(1).write.option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Measurements with the columns of a search run; missing values are null."""
    schema = "QPS double, Recall double, EFS int, POST_EFS int, Method string, Memory double, NPROBE int"
    return spark.read.option("header", True).schema(schema).csv(path)


def read_log(spark: SparkSession, path: str, fields: Mapping[str, str], block: str | None = None) -> DataFrame:
    """A row for each log (or for each part that begins where ``block`` matches), a double column for each pattern's first group; null without a match."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    if block:
        text = text.select("file", F.posexplode(F.split("value", f"(?={block})")).alias("part", "value")).where(F.col("value").rlike(block))
    else:
        text = text.withColumn("part", F.lit(0))
    got = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit("")).cast("double")
    return text.select("file", "part", *[got(p).alias(c) for c, p in fields.items()])
