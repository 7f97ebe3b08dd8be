"""Text sources: documents, conversations and pages to content nodes, and back.

A node row is ``(doc_id, node_id, ord, kind, role, parent, page, bbox, text,
attrs)``.  A text is split at blank lines into paragraph nodes p0, p1, ...;
metadata become nodes ``meta:<Key>`` and annotations nodes of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BBOX = "struct<x:double,y:double,width:double,height:double>"
NODES = f"doc_id string, node_id string, ord int, kind string, role string, parent string, page int, bbox {BBOX}, text string, attrs map<string,string>"
COLUMNS = ["doc_id", "node_id", "ord", "kind", "role", "parent", "page", "bbox", "text", "attrs"]
BLANK_LINES = r"\r?\n[ \t]*(?:\r?\n[ \t]*)+"


def _node(kind, role, node_id, ord_, text, attrs=None):
    none = F.lit(None)
    return [
        F.col("doc_id").cast("string").alias("doc_id"), node_id.alias("node_id"), ord_.cast("int").alias("ord"), F.lit(kind).alias("kind"), F.lit(role).alias("role"),
        none.cast("string").alias("parent"), none.cast("int").alias("page"), none.cast(BBOX).alias("bbox"), text.alias("text"),
        (attrs if attrs is not None else none.cast("map<string,string>")).alias("attrs"),
    ]


def paragraphs(docs: DataFrame) -> DataFrame:
    """Nodes of ``docs(doc_id, text)``: one a paragraph; null texts have none."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", BLANK_LINES)).alias("pos", "part")).where("trim(part) <> ''")
    return cut.select(*_node("text", "paragraph", F.concat(F.lit("p"), F.col("pos").cast("string")), F.col("pos"), F.col("part")))


def nodes(docs: DataFrame) -> DataFrame:
    """Nodes of ``docs(doc_id, text[, metadata map][, annotations array<struct<id,text,author>>])``."""
    out = paragraphs(docs.select("doc_id", "text"))
    if "metadata" in docs.columns:
        meta = docs.select("doc_id", F.posexplode("metadata").alias("pos", "key", "value"))
        out = out.union(meta.select(*_node("metadata", None, F.concat(F.lit("meta:"), "key"), F.col("pos") + 100_000, F.col("value"), F.create_map(F.lit("key"), "key"))))
    if "annotations" in docs.columns:
        notes = docs.select("doc_id", F.posexplode("annotations").alias("pos", "a"))
        attrs = F.create_map(F.lit("author"), F.col("a.author"))
        out = out.union(notes.select(*_node("annotation", "comment", F.col("a.id"), F.col("pos") + 200_000, F.col("a.text"), attrs)))
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """One document a conversation, one node a turn."""
    rows = conversations.select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return rows.select(*_node("text", "paragraph", F.concat(F.lit("t"), F.col("turn").cast("string")), F.col("turn"), F.col("text")))


def html_text(html):
    """Tags to spaces and the five XML entities decoded, for detection in pages."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def join_paragraphs(found: DataFrame) -> DataFrame:
    """The sink: ``(doc_id, text)`` with paragraphs joined by one blank line."""
    parts = found.where("kind = 'text'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.col("parts.text"), "\n\n").alias("text"))
