"""The catalogue of known objects and its aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The published JSON (one array of objects, compressed or not), lower-case columns, numbers without parentheses."""
    raw = spark.read.option("multiLine", True).json(path)
    names = raw.toDF(*[c.lower().replace(" ", "_").replace(".", "_") for c in raw.columns])
    return names.withColumn("number", bare_number("number")) if "number" in names.columns else names


def bare_number(column: str):
    return F.regexp_extract(F.col(column), r"(\d+)", 1)


def aliases(catalogue: DataFrame) -> DataFrame:
    """All names of each object in long form: ``principal_desig, kind, alias``; an alias counts once per kind."""
    keys = F.array(
        F.struct(F.lit("number").alias("kind"), bare_number("number").alias("alias")),
        F.struct(F.lit("name").alias("kind"), F.col("name").alias("alias")),
        F.struct(F.lit("principal").alias("kind"), F.regexp_replace("principal_desig", " ", "").alias("alias")),
    )
    plain = catalogue.select("principal_desig", F.explode(keys).alias("k")).select("principal_desig", "k.kind", "k.alias")
    other = catalogue.select("principal_desig", F.lit("other").alias("kind"), F.explode("other_desigs").alias("alias"))
    both = plain.unionByName(other.withColumn("alias", F.regexp_replace("alias", " ", "")))
    return both.where(F.col("alias").isNotNull() & (F.col("alias") != "")).distinct()
