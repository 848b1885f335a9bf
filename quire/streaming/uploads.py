"""Structured Streaming around the batch operators: uploads as a file stream, commands and chunks by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import feedback, segment
from quire.operators.components import cut
from quire.sources import readers
from quire.sources.store import Store


def upload_stream(spark: SparkSession, path: str, per_batch: int = 50) -> DataFrame:
    """New files of a landing folder, as binaryFile rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def ingest(files: DataFrame, store: Store, checkpoint: str):
    """A query that parses each batch of files and upserts its books and their chapters."""

    def batch(rows: DataFrame, _: int) -> None:
        books, chapters = readers.parse(rows)
        store.upsert("books", books)
        store.upsert("chapters", chapters)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_commands(commands: DataFrame, store: Store, checkpoint: str):
    """A query that applies feedback commands (seq, message), in order, and keeps the replies as chat."""

    def batch(rows: DataFrame, number: int) -> None:
        messages = [(r.seq, r.message) for r in rows.orderBy("seq").toLocalIterator()]
        replies, after = feedback.run_all(store.read("decisions"), store.read("merged"), [m for _, m in messages])
        store.write("decisions", cut(after) if messages else after)
        said = [x for (s, m), r in zip(messages, replies) for x in ((2 * s, "user", m), (2 * s + 1, "assistant", r))]
        if said:
            store.append_chat(rows.sparkSession.createDataFrame(said, "seq long, role string, content string"))

    return commands.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of a stream of documents: the same expressions as in batch, without state."""
    return segment.chunks(docs, [key], text).withColumn("n_chars", F.length("text"))
