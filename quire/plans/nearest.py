"""Registered queries for nearest vectors: dense ones exactly and behind an inverted file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import dense, integrate
from quire.operators.components import shared_folder
from quire.plans.queries import neighbours_sql, query, table


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))


_DENSE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
z AS (SELECT vec_id, e, len(list_filter(e, lambda x: x <> 0)) > 0 AS some FROM g),
p AS (SELECT q.vec_id AS qid, x.vec_id AS key, CASE WHEN q.some AND x.some THEN round(list_cosine_similarity(q.e, x.e), 9) ELSE 0 END AS cosine FROM z q JOIN z x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(x.e) = len(q.e))"""


@query(f"WITH {_DENSE} SELECT qid, rank::INTEGER AS rank, key, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, key) AS rank FROM p) WHERE rank <= 10")
def dense_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings to each whose id 20 divides, exactly."""
    rows = _vectors(spark, sf_dir)
    return dense.exact_top(rows.where("key % 20 = 0"), rows).select("qid", "rank", "key", F.round("cosine", 6).alias("cosine"))


@query()
def inverted_file_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same behind an inverted file of all embeddings, with the number of cells that each query looked into."""
    rows = _vectors(spark, sf_dir)
    index = dense.InvertedFile.build(rows, new_folder(spark, "inverted"))
    found = index.search(rows.where("key % 20 = 0"))
    return found.select("qid", "rank", "key", F.round("cosine", 6).alias("cosine"), F.lit(index.probes).alias("probes"), F.lit(len(index.centroids)).alias("cells"))


@query(neighbours_sql("SELECT conv_id * 1000 + turn AS ord, coalesce(text, '') || '。' AS text FROM conversations"))
def turn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversation turns among each other's ten nearest, over the whole table."""
    nodes = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.coalesce("text", F.lit("")).alias("name"), F.lit("").alias("definition"))
    return integrate.neighbour_pairs(nodes).select("a", "b", F.round("cosine", 6).alias("cosine"))
