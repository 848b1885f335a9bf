"""Reading books: files of several formats into textbooks and chapters.

Spark's binaryFile source lists and reads the files, so any store works (it leaves out files of no bytes). Word and Excel files are unzipped by the
standard library inside mapInPandas; a PDF comes as text blocks (PDF_BLOCKS) from an extractor of your own.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.text import clean_text, safe_id, strip
from quire.operators import segment
from quire.operators.components import once, spread

FORMATS = {"md": "markdown", "markdown": "markdown", "txt": "text", "docx": "word", "xlsx": "excel", "xlsm": "excel"}
#: Namespaces of the office formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def word_text(content: bytes) -> str:
    """The non-blank paragraphs of a .docx file, a line each."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in root.iter(f"{WORD}p"))
    return "\n".join(x for x in lines if x)


def excel_text(content: bytes) -> str:
    """A # line with each sheet's name, and each row's values joined by tabs."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
        out.append(f"# {sheet.get('name')}")
        path = targets[sheet.get(RELATION)].lstrip("/")
        for row in ElementTree.fromstring(book.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{SHEET}row"):
            values = []
            for cell in row.iter(f"{SHEET}c"):
                value, kind = cell.find(f"{SHEET}v"), cell.get("t")
                if kind == "inlineStr":
                    values.append("".join(t.text or "" for t in cell.iter(f"{SHEET}t")))
                elif value is not None and value.text is not None:
                    values.append(shared[int(value.text)] if kind == "s" else ("True" if value.text == "1" else "False") if kind == "b" else value.text)
            if values:
                out.append("\t".join(values))
    return "\n".join(out)


def _decoded(files: DataFrame) -> DataFrame:
    """files with text and error in place of content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for kind, content in zip(b["kind"], b["content"]):
                try:
                    texts.append(word_text(content) if kind == "word" else excel_text(content) if kind == "excel" else bytes(content).decode("utf-8", "ignore"))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError) as e:  # a broken file is a failed book, not a failed job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.drop(columns="content").assign(text=texts, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    return files.mapInPandas(run, f"{schema}, text string, error string")


def books_of(files: DataFrame) -> DataFrame:
    """(textbook_id, filename, title, format, file_size, kind, text, error) of binaryFile rows; an unknown format is an error."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    rows = files.select(name.alias("filename"), F.col("length").alias("file_size"), "content")
    rows = rows.withColumn("format", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))).withColumn("kind", F.try_element_at(kind, F.col("format")))
    rows = rows.withColumn("title", F.regexp_replace("filename", r"(?<=.)\.[^.]*$", "")).withColumn("textbook_id", safe_id("book", F.concat_ws(":", "filename", F.col("file_size").cast("string"))))
    bad = F.when(F.col("kind").isNull(), F.concat(F.lit("暂不支持的文件格式："), "format"))
    return _decoded(rows).withColumn("error", F.coalesce(bad, "error"))


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(textbooks, chapters) of binaryFile rows (path, length, content). A file that can't be read is a book with an error."""
    books = books_of(files)
    texts = books.where("error is null").select("textbook_id", "kind", clean_text(F.col("text")).alias("text"))
    marked = segment.heading_segments(texts.where("kind = 'markdown'"), "textbook_id", "text", True)
    plain = segment.heading_segments(texts.where("kind in ('text', 'word')"), "textbook_id", "text", False)
    found = marked.unionByName(plain)
    rest = texts.where("kind <> 'excel'").join(found.select("textbook_id").distinct(), "textbook_id", "left_anti")
    split = segment.fixed_split(rest, "textbook_id", "text").unionByName(segment.fixed_split(texts.where("kind = 'excel'"), "textbook_id", "text", "Excel 数据表"))
    pages = [F.col("chapter_ord").alias(c) for c in ("page_start", "page_end")]
    chapters = segment.make_chapters(found.unionByName(split).select("textbook_id", "chapter_ord", "title", *pages, "content"))
    return textbooks(books, chapters), chapters


def textbooks(books: DataFrame, chapters: DataFrame, total_pages: Column | None = None) -> DataFrame:
    """TEXTBOOKS rows with their chapters nested, in order."""
    one = F.struct("chapter_ord", F.struct("chapter_id", "title", "page_start", "page_end", "content", "char_count").alias("c"))
    nested = chapters.groupBy("textbook_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("chapters"), F.sum("char_count").cast("int").alias("total_chars"))
    rows = books.join(nested, "textbook_id", "left")
    status = F.when(F.col("error").isNull(), F.lit(schemas.STATUSES[1])).otherwise(schemas.STATUSES[2])
    return rows.select(
        "textbook_id", "filename", "title", "format", "file_size", (F.lit(1) if total_pages is None else total_pages).cast("int").alias("total_pages"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"),
        status.alias("status"), "error", F.localtimestamp().alias("uploaded_at"), F.coalesce("chapters", F.array().cast(nested.schema["chapters"].dataType)).alias("chapters"),
    )


def parse_pdf_blocks(blocks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Chapters of PDF text blocks: pages, titles, segments, post-processing; a book of one chapter is split by size."""
    pages = segment.detect_titles(segment.pdf_page_texts(blocks))
    made = segment.postprocess(segment.make_chapters(segment.page_segments(pages, page_counts)))
    few = made.groupBy("textbook_id").agg(F.count("*").alias("n"), F.first("content").alias("content")).where("n <= 1")
    split = segment.fixed_split(few, "textbook_id", "content")
    split = segment.make_chapters(split.select("textbook_id", "chapter_ord", "title", F.col("chapter_ord").alias("page_start"), F.col("chapter_ord").alias("page_end"), "content"))
    return made.join(few.select("textbook_id"), "textbook_id", "left_anti").unionByName(split)


def read_books(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse(spark.read.format("binaryFile").load(path))


def read_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A JSON document table with a declared schema; an empty table where the path has no files."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def as_chapters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(books, chapters): each document as a book of one chapter, for tables of plain texts."""
    ident = F.concat(F.lit("doc_"), F.col(key).cast("string"))
    clean = once(spread(docs.select(key, text)), "__content", clean_text(F.col(text))).select(F.col(key).alias("book_ord"), ident.alias("textbook_id"), F.col("__content").alias("content"))
    # Not from clean: once() can't be left out, so texts would be cleaned for the titles alone.
    books = docs.select(ident.alias("textbook_id"), F.concat(F.lit("Document "), F.col(key).cast("string")).alias("title"), F.col(key).alias("book_ord"), F.length(clean_text(F.col(text))).alias("total_chars"))
    chapters = clean.where("content <> ''").select(
        "textbook_id", F.lit(1).alias("chapter_ord"), F.lit("ch_001").alias("chapter_id"), strip(F.left(F.get(F.split("content", "\n"), F.lit(0)), F.lit(40))).alias("title"),
        F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "content", F.length("content").alias("char_count"),
    )
    return books, chapters


def demo_books(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Two small books for a first try, in our own words."""
    chapters = spark.createDataFrame(
        [
            ("book_demo_a", 1, "ch_001", "第一章 细胞的电活动", 1, 9, "静息电位是指细胞安静时膜两侧的电位差。动作电位是可兴奋细胞受到有效刺激后膜电位的快速波动。"),
            ("book_demo_a", 2, "ch_002", "第二章 稳态与调节", 10, 21, "稳态是指内环境的理化性质保持相对稳定。反射是神经调节的基本方式。"),
            ("book_demo_b", 1, "ch_001", "第一章 炎症", 1, 15, "炎症是机体对损伤的防御反应。白细胞渗出是炎症反应的重要特征。"),
        ],
        "textbook_id string, chapter_ord int, chapter_id string, title string, page_start int, page_end int, content string",
    ).withColumn("char_count", F.length("content"))
    books = spark.createDataFrame([("book_demo_a", "1 生理学示例", 1), ("book_demo_b", "2 病理学示例", 2)], "textbook_id string, title string, book_ord int")
    return books.join(chapters.groupBy("textbook_id").agg(F.sum("char_count").cast("int").alias("total_chars")), "textbook_id"), chapters


def book_order(title: Column) -> Column:
    """struct to sort books by: the title's leading number, else 9999; then the title."""
    number = F.regexp_extract(title, r"^\s*(\d+)", 1)
    return F.struct(F.coalesce(number.try_cast("int"), F.lit(9999)).alias("n"), title.alias("title"))


def upload_name(filename: Column) -> Column:
    """The name under which an upload is kept: a hash of stem and suffix, with the suffix."""
    suffix = F.lower(F.regexp_extract(filename, r"(?<=.)(\.[^.]*)$", 1))
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    return F.concat(safe_id("file", F.concat(stem, suffix)), suffix)


def save_upload(spark: SparkSession, path: str, folder: str) -> str:
    """Copies a file into the landing folder under its hashed name, between any two of Hadoop's file systems; the new path."""
    name = spark.range(1).select(upload_name(F.lit(path.rstrip("/").rsplit("/", 1)[-1])).alias("n")).first().n
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    return f"{folder.rstrip('/')}/{name}"
