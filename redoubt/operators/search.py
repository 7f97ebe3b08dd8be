"""Many values in many texts of a document, in one pass over each text.

Values and texts meet by document.  A text is read once by an automaton of all
values of its document, so the cost is that of the text and its hits, not of
their product.  A document with more than ``PART`` characters is dealt out by
node: its values go to each part, its texts to one.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

PART = 4_000_000


def automaton(values) -> ahocorasick.Automaton | None:
    """Finds every occurrence of the distinct, non-empty ``values``; None if there are none."""
    found = ahocorasick.Automaton()
    for v in values:
        found.add_word(v, v)
    if not len(found):
        return None
    found.make_automaton()
    return found


def by_parts(texts: DataFrame, values: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part`` beside ``doc_id``: a large document's texts are dealt by node, its values go to every part."""
    large = settle(texts.groupBy("doc_id").agg(F.ceil(F.sum(F.length(text)) / PART).cast("int").alias("parts")).where("parts > 1"))  # few
    parts = F.coalesce("parts", F.lit(1))
    dealt = texts.join(large, "doc_id", "left").withColumn("part", F.pmod(F.xxhash64("node_id"), parts).cast("int")).drop("parts")
    sent = values.join(large, "doc_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt, sent


def _free(text: str, start: int, end: int) -> bool:
    """Whether no ASCII letter or digit touches the span."""
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    return not any(c.isascii() and c.isalnum() for c in around)


def _counts(key, texts, needles):
    wanted = set(zip(needles.column("needle").to_pylist(), needles.column("whole").to_pylist()))
    reader = automaton({n for n, _ in wanted})
    out: list[tuple] = []
    for doc, node, hay in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "node_id", "hay"))) if reader else ():
        seen: dict[tuple[str, bool], list[int]] = {}  # occurrences and the end of the last one: they don't overlap
        for last, needle in reader.iter(hay):
            start = last + 1 - len(needle)
            for whole in (False, True):
                if (needle, whole) in wanted and (not whole or _free(hay, start, last + 1)):
                    entry = seen.setdefault((needle, whole), [0, 0])
                    if start >= entry[1]:
                        entry[0] += 1
                        entry[1] = last + 1
        out += [(doc, node, needle, whole, entry[0]) for (needle, whole), entry in seen.items()]
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "node_id", "needle", "whole", "seen"])


def counts(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``(doc_id, node_id, needle, whole, seen)``: how often each of ``needles(doc_id, needle, whole)`` stands in
    ``texts(doc_id, node_id, hay)`` of its document without overlap; ``whole`` ones touch no letter or digit."""
    dealt, sent = by_parts(texts, needles.distinct(), "hay")
    return dealt.groupBy("doc_id", "part").cogroup(sent.groupBy("doc_id", "part")).applyInArrow(_counts, "doc_id string, node_id string, needle string, whole boolean, seen int")
