"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from its copy by k = m // 12 edits.  It
is split into k + 1 pieces: k edits touch at most k of them, so any such copy
holds one piece unchanged, near its own place.  One Aho-Corasick automaton
finds all pieces in a document; the windows around the hits are verified with
Myers' bit-parallel distance, a whole pattern to one integer.

Texts and items are compared in lower case with runs of white space as one
space; positions count code points of that form.  Test items are read through
the driver, which holds them all: a test set is written by people and has some
megabytes, which this operator takes as its limit of scale.  They travel to the
tasks in groups of at most ``GROUP_CHARS`` characters, so no automaton outgrows
that bound; a group is one narrow pass over the documents.

Definitions: null and blank items and documents match nothing.  An item of
under 12 characters must appear unchanged and not inside a longer word.  Rows
that repeat a ``doc_id`` or ``item_id`` each report their matches.  Of several
places of an item in a document, the one of least distance counts, then the
first.  Empty tables give no rows (``decontaminate``: all of ``docs``).  Further
columns of ``docs`` stay as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHARS_AN_EDIT = 12
GROUP_CHARS = 4_000_000
_OUT = "doc_id long, item_id long, distance int, start int, end int"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of ``pattern`` to a substring of ``text`` and the first end where it is met, if within ``most``."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << m - 1
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = mask, 0, m, None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, at + 1
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, len(t) // CHARS_AN_EDIT) for i, t in items if t]
        held: dict[str, list] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                held.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.empty = not held
        if held:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item, the stretches of ``text`` that may hold it, in order and apart."""
        found: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, at in places:
                _, item, edits = self.items[n]
                begin = last - size + 1 - at
                found.setdefault(n, []).append([max(0, begin - edits), min(len(text), begin + len(item) + edits)])
        for n, spans in found.items():
            spans.sort()
            out = [spans[0]]
            for a, z in spans[1:]:
                if a <= out[-1][1]:
                    out[-1][1] = max(z, out[-1][1])
                else:
                    out.append([a, z])
            found[n] = out
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, start, end)`` of each item that the text holds."""
        if self.empty or not text:
            return []
        out = []
        for n, spans in self.windows(text).items():
            key, item, edits = self.items[n]
            best = None
            for a, z in spans:
                part = text[a:z]
                if not edits:
                    at = part.find(item)
                    while at >= 0 and ((a + at and text[a + at - 1].isalnum() and item[0].isalnum()) or (item[-1].isalnum() and text[a + at + len(item) : a + at + len(item) + 1].isalnum())):
                        at = part.find(item, at + 1)
                    hit = (0, at + len(item)) if at >= 0 else None
                else:
                    hit = myers(item, part, edits if best is None else best[0] - 1)
                if hit and (best is None or hit[0] < best[0]):
                    # The start: the reversed pattern read backwards from the end.
                    back = myers(item[::-1], part[: hit[1]][::-1], hit[0])
                    best = hit[0], a + hit[1] - back[1], a + hit[1]
                    if not best[0]:
                        break
            if best:
                out.append((key, *best))
        return out

    def holds(self, text: str) -> bool:
        """Whether ``matches`` would find any item."""
        if self.empty or not text:
            return False
        for n, spans in self.windows(text).items():
            _, item, edits = self.items[n]
            if any(myers(item, text[a:z], edits) for a, z in spans) if edits else self.stands(item, text, spans):
                return True
        return False

    @staticmethod
    def stands(item: str, text: str, spans) -> bool:
        """Whether a short item is a word or phrase of its own in one of the stretches."""
        for a, z in spans:
            at = text.find(item, a, z)
            while at >= 0:
                if not (at and text[at - 1].isalnum() and item[0].isalnum()) and not (item[-1].isalnum() and text[at + len(item) : at + len(item) + 1].isalnum()):
                    return True
                at = text.find(item, at + 1, z)
        return False


def _scan(items: list[tuple[int, str]]):
    def run(batches):
        matcher = Matcher(items)
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for hit in matcher.matches(normalise(text)):
                    docs.append(doc)
                    found.append(hit)
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def item_groups(benchmark: DataFrame, group_chars: int = GROUP_CHARS) -> list[list[tuple[int, str]]]:
    """The test items in normal form, in groups of at most ``group_chars`` characters (or of one item)."""
    groups, held, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = normalise(r["text"])
        if held and size + len(text) > group_chars:
            groups.append(held)
            held, size = [], 0
        held.append((r["item_id"], text))
        size += len(text)
    return [*groups, held]


def contamination(docs: DataFrame, benchmark: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, start, end)`` for every document and test item it holds within the budget."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return reduce(DataFrame.union, [texts.mapInArrow(_scan(g), _OUT) for g in item_groups(benchmark, group_chars)])


def _without(items: list[tuple[int, str]], at: int):
    def run(batches):
        matcher = Matcher(items)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.holds(normalise(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; rows are judged where they lie, nothing is shuffled."""
    for group in item_groups(benchmark, group_chars):
        docs = docs.mapInArrow(_without(group, docs.columns.index("text")), docs.schema)
    return docs


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
