"""Declared schemas of the data model. List order in documents becomes an explicit ordinal column here."""

from __future__ import annotations

CHAPTER = "chapter_id STRING, title STRING, page_start INT, page_end INT, content STRING, char_count INT"
TEXTBOOKS = (
    "textbook_id STRING, filename STRING, title STRING, format STRING, file_size BIGINT, total_pages INT, total_chars INT, "
    f"status STRING, error STRING, uploaded_at TIMESTAMP_NTZ, chapters ARRAY<STRUCT<{CHAPTER.replace(' STRING', ': STRING').replace(' INT', ': INT')}>>"
)
CHAPTERS = f"textbook_id STRING, chapter_ord INT, {CHAPTER}"
NODES = (
    "textbook_id STRING, graph_ord INT, node_ord INT, id STRING, name STRING, definition STRING, category STRING, chapter STRING, "
    "page INT, textbook_title STRING, source STRING, frequency INT, aliases ARRAY<STRING>, importance DOUBLE"
)
EDGES = "textbook_id STRING, graph_ord INT, edge_ord INT, source STRING, target STRING, relation_type STRING, description STRING, weight DOUBLE"
DECISIONS = (
    "decision_ord INT, decision_id STRING, action STRING, affected_nodes ARRAY<STRING>, result_node STRING, reason STRING, "
    "confidence DOUBLE, teacher_locked BOOLEAN"
)
CHUNKS = "chunk_id STRING, ord BIGINT, text STRING, textbook_id STRING, textbook STRING, chapter STRING, page INT"
QUERIES = "qid BIGINT, question STRING, top_k INT"
COMMANDS = "seq BIGINT, message STRING"
CHAT = "seq BIGINT, role STRING, content STRING"
PDF_BLOCKS = "textbook_id STRING, page_no INT, page_height DOUBLE, block_no INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING"

#: The allowed states, relations and actions.
STATUSES = ("解析中", "已完成", "失败")
RELATIONS = ("prerequisite", "parallel", "contains", "applies_to")
ACTIONS = ("merge", "keep", "remove", "split")
