"""Problems 7 and 8 as queries: token ids of the documents, and containers of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.llm.bpe import DEFAULT_RANK_FILE, encode_corpus, read_ranks
from deuceframe.llm.packing import Limits, fill_containers
from deuceframe.sources.tables import table

CONTAINER = Limits(tokens=2048, segments=128, loss_tokens=2048)


def p7_ids(spark: SparkSession, folder: str, rank_path: str = DEFAULT_RANK_FILE) -> DataFrame:
    docs = table(spark, folder, "documents")
    return encode_corpus(docs, F.col("doc_id"), F.col("text"), read_ranks(rank_path))


def p8_containers(spark: SparkSession, folder: str, rank_path: str = DEFAULT_RANK_FILE) -> DataFrame:
    """Where each document's tokens went; documents without tokens are in no container."""
    docs = table(spark, folder, "documents")
    sizes = encode_corpus(docs, F.col("doc_id"), F.col("text"), read_ranks(rank_path), counts_only=True)
    return fill_containers(sizes, CONTAINER)


def p8_fill(spark: SparkSession, folder: str, rank_path: str = DEFAULT_RANK_FILE) -> DataFrame:
    """How full the containers are: their number, the least possible number, and the share of space used."""
    placed = p8_containers(spark, folder, rank_path)
    bins = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("segments"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("used") / CONTAINER.tokens).alias("lower_bound"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.max("segments").alias("most_segments"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * CONTAINER.tokens), 6).alias("fill"),
    )


QUERIES = {"p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
