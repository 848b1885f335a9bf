"""The store: books, graphs, integration and chat as Parquet tables in buckets of their key.

A table is a manifest that names the folder of each bucket. An upsert or a deletion reads and writes the buckets that
its keys fall into and no others; a new manifest, which is committed by a rename that never overwrites, then names the
new folders beside the untouched ones. A reader sees the old or the new table, never half of one. Of two writers the one
that commits second keeps its work if the first changed other buckets, and does it again on the first's table if not.

Tables without the key column have one bucket. Columns are those of all writes so far; rows that lack one have nulls.
On a store whose rename isn't atomic, writers must take turns.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire import schemas
from quire.operators.components import cut, dropped
from quire.sources.readers import book_order

CHAT_KEPT = 200
BUCKETS, KEY, VERSIONS = 64, "textbook_id", 2  # of a new table; manifests that are kept
SCHEMAS = {"books": schemas.TEXTBOOKS, "chapters": schemas.CHAPTERS, "nodes": schemas.NODES, "edges": schemas.EDGES, "merged": schemas.NODES, "kept_edges": schemas.EDGES, "decisions": schemas.DECISIONS, "chat": schemas.CHAT}


class Conflict(Exception):
    """Another writer was first, in the same buckets."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _versions(self, table: str) -> list[int]:
        path, fs = self._path(f"{table}/manifest"), self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, table: str, version: int | None = None) -> dict:
        """version, key, buckets, schema and files, the folder of each bucket that has rows; of the newest version if none is given."""
        known = self._versions(table)
        if not known:
            return {"version": 0, "key": KEY, "buckets": self.buckets, "schema": None, "files": {}}
        stream = self._fs().open(self._path(f"{table}/manifest/v{version or known[-1]:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, table: str, made: dict) -> bool:
        """Whether made is the table now: not so if another writer made that version first."""
        draft, final = f"{table}/manifest/draft-{uuid.uuid4().hex}", f"{table}/manifest/v{made['version']:09d}.json"
        out = self._fs().create(self._path(draft))
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self._conf).rename(self._path(draft), self._path(final), none)
            return True
        except Py4JJavaError as e:
            self._fs().delete(self._path(draft), False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def _bucket(self, made: dict, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(F.col(made["key"]).cast("string")), F.lit(made["buckets"])).cast("int") if made["key"] in df.columns else F.lit(0)

    def _files(self, table: str, made: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a manifest, or of some of its buckets."""
        schema = StructType.fromJson(json.loads(made["schema"])) if made["schema"] else SCHEMAS[table]
        paths = [f"{self.root}/{table}/{f}" for b, f in made["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, table: str, df: DataFrame, made: dict) -> dict[str, str]:
        """Writes df in buckets; their folders. A large bucket is split into files, small ones aren't."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn("__bucket", self._bucket(made, df))
        rows.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{table}/{folder}")
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path(f"{table}/{folder}"))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith("__bucket=")}

    def read(self, table: str) -> DataFrame:
        """The table as last written; empty if it never was."""
        return self._files(table, self.manifest(table))

    def write(self, table: str, df: DataFrame, keep: int = VERSIONS) -> None:
        """Makes df the table; the versions before the last `keep` go."""
        now = self.manifest(table) | {"schema": df.schema.json()}
        files = self._written(table, df, now)
        while not self._commit(table, now | {"version": now["version"] + 1, "files": files}):
            now["version"] = self.manifest(table)["version"]
        self._vacuum(table, keep)

    def _replaced(self, table: str, touched: list[int], df: DataFrame, now: dict) -> None:
        """Commits df as the rows of the touched buckets, now being the manifest that it was made from."""
        new, keys = self._written(table, df, now), {str(b) for b in touched}
        made = {k: v for k, v in now["files"].items() if k not in keys} | new
        while not self._commit(table, now | {"version": now["version"] + 1, "files": made, "schema": df.schema.json()}):
            other = self.manifest(table)
            if other["schema"] != now["schema"] or any(other["files"].get(k) != now["files"].get(k) for k in keys):
                raise Conflict(table)
            now, made = other, {k: v for k, v in other["files"].items() if k not in keys} | new
        self._vacuum(table, VERSIONS)

    def _change(self, table: str, keys: DataFrame, rows: DataFrame | None, key: str) -> None:
        """Takes the rows with one of keys out and rows in, bucket by bucket; begins anew if another writer changed them meanwhile."""
        while True:
            now = self.manifest(table)
            if now["key"] != key or rows is not None and key not in rows.columns:
                raise ValueError(f"{table} is kept by {now['key']}")
            touched = [r[0] for r in keys.select(self._bucket(now, keys)).distinct().collect()]  # a row a bucket
            old = self._files(table, now, touched).join(keys, key, "left_anti")
            try:
                return self._replaced(table, touched, old if rows is None else old.unionByName(rows, allowMissingColumns=True), now)
            except Conflict:
                continue

    def upsert(self, table: str, rows: DataFrame, key: str = KEY) -> None:
        """rows in place of those with the same key."""
        held = cut(rows)
        self._change(table, held.select(key).distinct(), held, key)
        dropped(held)

    def delete(self, table: str, values: list[str], key: str = KEY) -> None:
        """Takes out the rows whose key is one of values."""
        self._change(table, self.spark.createDataFrame([(v,) for v in values], f"{key} string"), None, key)

    def _vacuum(self, table: str, keep: int) -> None:
        """Deletes the manifests before the last `keep`, and the folders that only they name."""
        versions = self._versions(table)
        if len(versions) <= keep:
            return
        named = {v: set(self.manifest(table, v)["files"].values()) for v in versions}
        live = {f for v in versions[-keep:] for f in named[v]}
        for v in versions[:-keep]:
            for f in named[v] - live:
                self._fs().delete(self._path(f"{table}/{f}"), True)
            self._fs().delete(self._path(f"{table}/manifest/v{v:09d}.json"), False)

    def list_books(self) -> DataFrame:
        return self.read("books").orderBy(book_order(F.col("title")))

    def get(self, table: str, value: str, key: str = KEY) -> DataFrame:
        """The rows whose key is value; by the table's own key from one bucket."""
        now, one = self.manifest(table), self.spark.createDataFrame([(value,)], f"{key} string")
        bucket = [one.select(self._bucket(now, one)).first()[0]] if key == now["key"] else None
        return self._files(table, now, bucket).where(F.col(key) == value)

    def save_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.upsert("nodes", nodes)
        self.upsert("edges", edges)

    def save_integration(self, nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> None:
        """Makes these the integrated graph and its decisions."""
        for table, df in (("merged", nodes), ("kept_edges", edges), ("decisions", decisions)):
            self.write(table, df)

    def integration(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, decisions) as last saved; empty if they never were."""
        return self.read("merged"), self.read("kept_edges"), self.read("decisions")

    def delete_book(self, textbook_id: str, uploads: str | None = None, index: str | None = None) -> bool:
        """Deletes a book with its chapters, graph and upload, resets the integration and clears the index; whether there was such a book."""
        book = self.get("books", textbook_id).select("filename").first()
        if book is None:
            return False
        for table in ("books", "chapters", "nodes", "edges"):
            self.delete(table, [textbook_id])
        self.save_integration(*(self.spark.createDataFrame([], SCHEMAS[t]) for t in ("merged", "kept_edges", "decisions")))
        for path in ([f"{uploads.rstrip('/')}/{book.filename}"] if uploads and book.filename else []) + ([index] if index else []):
            gone = self._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(self._conf).delete(gone, True)
        return True

    def append_chat(self, rows: DataFrame) -> None:
        """Adds (role, content) rows, in their order of seq, and keeps the last CHAT_KEPT."""
        self.write("chat", chat_tail(self.read("chat").unionByName(rows)))

    def without_graph(self) -> DataFrame:
        """Books whose graph isn't built."""
        return self.read("books").join(self.read("nodes").select("textbook_id").distinct(), "textbook_id", "left_anti")


def chat_tail(chat: DataFrame, kept: int = CHAT_KEPT, by: list[str] | None = None) -> DataFrame:
    """The last rows by seq, of each group of by if given: a top-k, so a sort of k rows a task."""
    if not by:
        return chat.orderBy(F.desc("seq")).limit(kept)
    n = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("seq")))
    return chat.withColumn("__n", n).where(F.col("__n") <= kept).drop("__n")


def export(books: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, chapters: DataFrame | None = None, integrated: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Writes books without content, and a JSON folder per book's graph; (file, bytes, sha256) of what is there.

    With chapters and the integration (nodes, edges, decisions) also the summaries and the refined book, and definitions
    cleaned again.
    """
    from quire.functions.terms import clean_definition
    from quire.operators import report

    if chapters is not None and integrated is not None:
        merged, kept, decisions = integrated
        merged = merged.withColumn("definition", clean_definition(F.col("name"), F.col("definition")))
        nodes = nodes.withColumn("definition", clean_definition(F.col("name"), F.col("definition")))
        summaries = {
            "summaries": report.book_summary(books, chapters, nodes, edges).orderBy("textbook_id", "part", "line"), "decision-summary": report.decision_summary(decisions, merged, kept).orderBy("line"),
            "refined": report.refined_book(books, chapters, merged).orderBy("book_ord", "chapter_ord", "line"), "summary": report.export_summary(books, chapters, nodes, edges), "merged": merged, "merged-edges": kept, "decisions": decisions,
        }
        for name, df in summaries.items():
            df.write.mode("overwrite").json(f"{path}/{name}")
    report.export_books(books).write.mode("overwrite").json(f"{path}/books")
    nodes.write.mode("overwrite").partitionBy("textbook_id").json(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("textbook_id").json(f"{path}/edges")
    files = nodes.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    return files.select(F.regexp_replace("path", ".*?" + path.rstrip("/").split("/")[-1] + "/", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
