"""Queries of the text problems 7 to 9, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import leakage, packing, sentences
from tabulon.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of its pieces where it exceeds the capacity, for each container class."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p7_space(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused space of each class."""
    return packing.space(p7_containers(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Token share of each source in each class against its target."""
    return packing.mixture(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them and their greatest containment."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("containment").alias("max_containment"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.units(table(spark, d, "documents"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Units and their mean length per document."""
    u = sentences.units(table(spark, d, "documents"))
    return u.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.avg(F.col("end_pos") - F.col("start_pos")).alias("mean_chars"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p7_containers, p7_space, p7_mixture, p8_found, p8_items, p9_found, p9_documents)}
ORACLE: dict[str, str] = {}
