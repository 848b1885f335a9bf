"""Segmenting texts: heading segments, page segments, fixed splits, overlapping chunks and chapter post-processing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import titles
from quire.functions.text import LINE_BREAK, clean_line, clean_text, is_noise_line, lines_of, looks_like_toc_page, safe_id, strip, sub
from quire.operators.components import cut, numbered

UNTITLED, UNKNOWN_CHAPTER, AUTOMATIC = "未命名章节", "未识别章节", "自动分段"
SPLIT_SIZE = 16_000
CHUNK_SIZE, CHUNK_OVERLAP, SNAP = 700, 80, 0.65


def chapter_id(ordinal: Column) -> Column:
    return F.format_string("ch_%03d", ordinal)


def heading_segments(docs: DataFrame, key: str, text: str, markdown: bool = True, pattern: str | None = None) -> DataFrame:
    """(key, chapter_ord, title, content): the text between headings, for segments that have any.

    A heading is a line that starts with # (if markdown) or matches pattern (a chapter heading by default). A gaps-and-
    islands query: a running count of headings numbers the segments.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("pos", "line"))
    heading = F.col("line").rlike(pattern) if pattern else titles.is_heading(strip(F.col("line")))
    heading = (F.col("line").startswith("#") | heading) if markdown else heading
    lines = lines.withColumn("heading", heading)
    order = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("segment", F.sum(F.col("heading").cast("int")).over(order))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "line")))), lambda x: x["line"])
    named = strip(sub(F.max(F.when(F.col("heading"), F.col("line"))), "(?U)^#+\\s*") if markdown else F.max(F.when(F.col("heading"), F.col("line"))))
    grouped = lines.groupBy(key, "segment").agg(F.coalesce(named, F.lit(UNTITLED)).alias("title"), body.alias("body")).where(F.size("body") > 0)
    return grouped.select(key, F.row_number().over(W.partitionBy(key).orderBy("segment")).alias("chapter_ord"), "title", F.array_join("body", "\n").alias("content"))


def fixed_split(docs: DataFrame, key: str, text: str, title: str = AUTOMATIC, size: int = SPLIT_SIZE) -> DataFrame:
    """(key, chapter_ord, title, content): pieces of size characters."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    pieces = docs.select(key, F.posexplode(F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))).alias("pos", "content"))
    order = (F.col("pos") + 1).cast("int")
    return pieces.select(key, order.alias("chapter_ord"), F.concat(F.lit(f"{title} "), order.cast("string")).alias("title"), "content")


def spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows that end after a sentence or line where one ends late enough. In time linear in the text."""
    n, least, start, out = len(text), int(size * SNAP), 0, []
    for _ in range(-(-n // max(1, least + 1 - overlap)) + 1 if n else 0):
        end = min(n, start + size)
        if start + size < n:
            late = max(text.rfind(c, start + least + 1, end) for c in "。；\n")
            end = late + 1 if late >= 0 else end
        out.append((start, end))
        if end >= n:
            break
        start = max(0, end - overlap)
    return out


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<struct<start, end>> of spans(); a null text has none."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in spans(t or "", size, overlap)] for t in texts])

    return run(text)


def chunks(docs: DataFrame, key: list[str], text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, clean: bool = True) -> DataFrame:
    """(key..., start, end, text): the windows of each text, of its clean form by default.

    Windows are found and cut out where the text is read, as each begins where the last one ended.
    """
    rows = docs.select(*key, (clean_text(F.col(text)) if clean else F.col(text)).alias("__t"))
    names = [*key, "start", "end", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                texts = [t or "" for t in part.column(len(key)).to_pylist()]
                found = [(j, a, b) for j, t in enumerate(texts) for a, b in spans(t, size, overlap)]
                row = pa.array([j for j, _, _ in found], pa.int64())
                own = [pa.array(x, kind) for x, kind in (([a for _, a, _ in found], pa.int32()), ([b for _, _, b in found], pa.int32()), ([texts[j][a:b] for j, a, b in found], pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(len(key))), *own], names=names)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.mapInArrow(run, f"{kinds}, start int, end int, text string")


def page_of(page_start: Column, page_end: Column, start: Column, chars: Column) -> Column:
    """The page where an offset lies, pages being taken as equally long."""
    span = F.greatest(F.lit(1), page_end - page_start + 1)
    return (page_start + F.floor(start / F.greatest(F.lit(1), chars) * span)).cast("int")


def pdf_page_texts(blocks: DataFrame) -> DataFrame:
    """(textbook_id, page_no, text) of PDF text blocks: without margins, captions, and noise."""
    body = (F.col("y0") >= F.col("page_height") * 0.04) & (F.col("y1") <= F.col("page_height") * 0.965)
    text = strip(F.col("text"))
    caption = (F.length(text) < 60) & text.rlike("(?U)^(?:图|表)\\s*\\d")
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), clean_line), lambda x: ~is_noise_line(x))
    kept = blocks.where(body & (F.length(text) >= 2) & ~caption).select("textbook_id", "page_no", "block_no", F.array_join(lines, "\n").alias("t")).where("t <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "t"))), lambda x: x["t"])
    return kept.groupBy("textbook_id", "page_no").agg(clean_text(F.array_join(ordered, "\n")).alias("text")).where("text <> ''")


def page_segments(pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(textbook_id, chapter_ord, title, page_start, page_end, content): pages grouped into chapters by detected titles.

    pages: textbook_id, page_no, text, title (null where none is found); page_counts: textbook_id, total_pages. A page
    opens a chapter if its title's key differs from that of the last title seen.
    """
    kept = pages.where((F.col("text") != "") & ~looks_like_toc_page(F.col("text")))
    order = W.partitionBy("textbook_id").orderBy("page_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    kept = kept.withColumn("key", F.when(F.col("title").isNotNull(), titles.chapter_key(F.col("title")))).withColumn("rank", F.row_number().over(order))
    last = F.coalesce(F.last("key", ignorenulls=True).over(before), F.lit(UNKNOWN_CHAPTER))
    kept = kept.withColumn("opens", (F.col("rank") > 1) & F.col("key").isNotNull() & (F.col("key") != last))
    kept = kept.withColumn("segment", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    texts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    first = F.min(F.struct("page_no", "title"))
    seg = kept.groupBy("textbook_id", "segment").agg(first.alias("f"), F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("content"))
    untitled = (F.col("segment") == 0) & F.col("f.title").isNull()
    seg = seg.withColumn("page_start", F.when(untitled, F.lit(1)).otherwise(F.col("f.page_no")))
    following = F.lead("page_start").over(W.partitionBy("textbook_id").orderBy("segment"))
    seg = seg.withColumn("next", following).join(page_counts, "textbook_id")
    return seg.select("textbook_id", (F.col("segment") + 1).cast("int").alias("chapter_ord"), F.coalesce("f.title", F.lit(UNKNOWN_CHAPTER)).alias("title"), "page_start", F.coalesce(F.col("next") - 1, "total_pages").alias("page_end"), "content")


def _titled(lines: DataFrame, key: list[str]) -> DataFrame:
    """Adds inferred, the chapter title that a page's first lines spell, by the scan of TitleScan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quire.functions.titlescan import infer

        for b in batches:
            yield b.assign(inferred=[infer(list(x)) for x in b["__lines"]]).drop(columns="__lines")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields if f.name != "__lines")
    return lines.mapInPandas(run, f"{schema}, inferred string")


def infer_titles(docs: DataFrame, text: str) -> DataFrame:
    """docs with inferred: the chapter title in the first 28 clean lines of the first 2,600 characters, or null."""
    head = clean_text(F.substring(F.col(text), 1, 2600))
    out = _titled(docs.withColumn("__head", head).withColumn("__lines", F.slice(F.split("__head", LINE_BREAK), 1, 28)), docs.columns)
    intro = F.when(F.col("__head").rlike("(?U)(?:^|\\s)绪\\s*论\\s*本章数字资源"), F.lit("绪论"))
    return out.withColumn("inferred", F.coalesce("inferred", intro)).drop("__head")


def detect_titles(pages: DataFrame) -> DataFrame:
    """pages with title: from the first 14 lines, inferred, else a line that is a heading (joined with the next if bare)."""
    out = _titled(pages.withColumn("__top", F.slice(lines_of(F.col("text")), 1, 14)).withColumn("__lines", F.col("__top")), pages.columns)
    flat = F.transform("__top", lambda x: strip(sub(x, "(?U)\\s+", " ")))

    def candidate(x: Column, i: Column) -> Column:
        after = F.try_element_at(flat, i + 2)
        joined = F.concat_ws(" ", x, after)
        bare = x.rlike(f"(?U)^{titles.PREFIX}$") & after.isNotNull() & (F.coalesce(after, F.lit("")) != "") & ~is_noise_line(F.coalesce(after, F.lit("")))
        good = lambda c: c.rlike(titles.HEADING) & (F.length(c) >= 3) & (F.length(c) <= 80)
        skip = is_noise_line(x) | x.contains("目录")
        return F.when(skip, None).when(bare & good(joined), joined).when(good(x), x)

    found = F.get(F.filter(F.transform(flat, candidate), lambda c: c.isNotNull()), F.lit(0))
    return out.withColumn("title", F.coalesce("inferred", titles.normalize_title(found))).drop("__top", "inferred")


def make_chapters(rows: DataFrame, key: str = "textbook_id") -> DataFrame:
    """Chapters of (key, chapter_ord, title, page_start, page_end, content): cleaned, trimmed to the body, named."""
    rows = infer_titles(rows.withColumn("content", clean_text(F.col("content"))), "content")
    rows = rows.withColumn("__lines", F.filter(F.split("content", LINE_BREAK), lambda x: strip(x) != ""))
    at = F.coalesce(F.array_position(F.transform("__lines", lambda x: x.contains(titles.RESOURCES)), True), F.lit(0)).cast("int")  # 1-based; 0: none
    rows = rows.withColumn("__at", at)
    first = F.greatest(F.lit(1), F.col("__at") - 3)
    near = F.filter(F.slice("__lines", first, F.greatest(F.lit(0), F.col("__at") - first)), lambda x: ~strip(x).rlike("(?U)^\\d+$") & ~F.exists(F.array(*map(F.lit, ("目录", "推荐阅读", "索引", "附录"))), lambda m: x.contains(m)))
    spelled = clean_line(sub(F.array_join(F.transform(near, strip), ""), "(?U)\\s+", " "))
    title = F.when(F.col("__at") > 0, titles.normalize_title(F.coalesce("inferred", spelled))).otherwise(F.col("inferred"))
    title = F.when((F.col("__at") == 0) | F.length(title).between(2, 40), title)
    before = F.array_join(F.slice("__lines", 1, F.greatest(F.lit(0), F.col("__at") - 1)), "\n")
    trim = (F.col("__at") > 5) | ((F.col("__at") > 0) & F.exists(F.array(*map(F.lit, ("目录", "推荐阅读", "索引", "附录", "AR 模型"))), lambda m: before.contains(m)))
    body = F.when(trim, F.array_join(F.slice("__lines", first, F.size("__lines")), "\n")).otherwise(F.col("content"))
    rows = rows.select(key, "chapter_ord", clean_line(F.col("title")).alias("title"), title.alias("found"), "page_start", "page_end", body.alias("content"))
    loose = F.col("title").contains("未识别") | F.col("title").contains("未命名") | F.col("title").startswith(AUTOMATIC)
    better = (F.coalesce(F.col("found"), F.lit("")) != "") & (loose | titles.has_more_detail(F.col("found"), F.col("title")) | titles.is_suspicious(F.col("title")))
    name = F.when(better, F.col("found")).when(F.col("title") == "", F.format_string("第 %d 部分", "chapter_ord")).otherwise(F.col("title"))
    return rows.select(
        key, F.col("chapter_ord").cast("int").alias("chapter_ord"), chapter_id(F.col("chapter_ord")).alias("chapter_id"), name.alias("title"),
        F.greatest(F.lit(1), F.col("page_start")).cast("int").alias("page_start"), F.greatest("page_start", "page_end").cast("int").alias("page_end"),
        "content", F.length("content").alias("char_count"),
    )


def postprocess(chapters: DataFrame, key: str = "textbook_id") -> DataFrame:
    """Chapters without catalogue and front matter, neighbours of one chapter joined, numbered anew."""
    c = F.col("content")
    kept = chapters.where((F.length(c) >= 40) & ~looks_like_toc_page(c) & ~titles.is_catalog_fragment(c) & ~titles.is_front_matter(F.col("title"), c))
    order = W.partitionBy(key).orderBy("chapter_ord")
    kept = kept.withColumn("k", titles.chapter_key(F.col("title")))
    opens = F.coalesce((F.col("k") != F.lag("k").over(order)) | (F.col("k") == ""), F.lit(True))
    kept = kept.withColumn("g", F.sum(opens.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter_ord", "content"))), lambda x: x["content"])
    joined = kept.groupBy(key, F.col("g").alias("chapter_ord")).agg(F.min_by("title", kept.chapter_ord).alias("title"), F.min("page_start").alias("page_start"), F.max_by("page_end", kept.chapter_ord).alias("page_end"), F.array_join(parts, "\n").alias("content"))
    return make_chapters(joined, key)


def chunk_rows(chapters: DataFrame, books: DataFrame, clean: bool = True) -> DataFrame:
    """CHUNKS of chapters (textbook_id, chapter_ord, chapter_id, title, ...), in order of book_ord, chapter and offset; clean: whether content has yet to be cleaned."""
    rows = chapters.join(books.select("textbook_id", F.col("title").alias("textbook"), "book_ord"), "textbook_id")
    found = chunks(rows, ["textbook_id", "textbook", "book_ord", "chapter_ord", "chapter_id", "title", "page_start", "page_end", "char_count"], "content", clean=clean)
    placed = numbered(cut(found), "place", "book_ord", "textbook_id", "chapter_ord", "start")
    ident = safe_id("chunk", F.concat_ws(":", "textbook_id", "chapter_id", F.col("start").cast("string")))
    return placed.select(ident.alias("chunk_id"), (F.col("place") - 1).alias("ord"), "text", "textbook_id", "textbook", F.col("title").alias("chapter"), page_of(F.col("page_start"), F.col("page_end"), F.col("start"), F.col("char_count")).alias("page"))
