"""The corpus pipeline: quality, near duplicates, decontamination, mixing and token output, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, mixing, quality, tokens
from quire.llm.queries import table
from quire.llm.shared import columns, free, new_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, trained on all labels, takes for good; those of score 0.5 are.

    Cases: a null or empty text, or one of blank lines, scores the share of good documents in the sample; repeated rows
    are judged each; a null doc_id, lang or source plays no part; without labels all stay; an empty table gives no rows;
    further columns, whatever their names, are kept.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free(docs, "score")
    return quality.score(docs, model, score).where(F.col(score) >= 0.5).select(columns(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more; the smallest doc_id stays.

    Cases: null and empty texts are in no group and stay, as do rows without doc_id; of rows that share a doc_id the
    first by text stays; a text of fewer than five words is one shingle; an empty table gives no rows; further columns,
    whatever their names, are kept.
    """
    return jaccard.keep_one(docs, 5, 80, 100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Cases: null and empty texts stay; rows that share a doc_id go together if one of them has a passage; a row without
    doc_id is judged by its own text; an empty table gives no rows; further columns, whatever their names, are kept.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a last part being rounded to a whole document or none.

    Cases: a text without words takes no words and goes; a null source is a source of its own; repeated rows are
    documents of their own; an empty table gives no rows; further columns, whatever their names, are kept.
    """
    row = free(docs, "row")
    packed = docs.select("doc_id", "text", "source", F.struct(*columns(docs)).alias(row))
    taken = mixing.mix(packed, F.array("source"), keep=[row])
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    repeated = taken.select(row, times.alias("times")).where("times > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return repeated.select(f"{row}.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC, read back: a row per document.

    Cases: a null or empty text has only the end id; a null doc_id sorts first; repeated rows are written each; an empty
    table gives no rows; further columns are not written.
    """
    import public_tokenizers

    path = new_path(spark, "tokens")
    return tokens.digests(spark, tokens.write_orc(docs, public_tokenizers.path("word_bpe_49k.json"), path))


STAGES = [("quality", good_documents), ("near duplicates", one_of_each_group), ("decontamination", without_benchmark), ("mix", mixed_sources), ("tokens", token_files)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name.split()[0]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
