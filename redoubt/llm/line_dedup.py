"""Line dedup by sorted line hashes.

Every line that can repeat becomes a row ``(hash, document, position)``.  The
rows are range-partitioned on all three and sorted, so a line that a third of
all documents share spreads over as many partitions as it fills.  One streaming
pass then sees the first document of each hash; a hash that begins in an
earlier partition gets its first document from a carry of one entry a
partition.  Positions that lose become a compressed keep bitmap per document;
texts take no part in the sort.

Definitions: a null text is one empty line.  A row without ``doc_id`` keeps all
its lines and counts for no one.  Rows that repeat a ``doc_id`` are one
document.  Hashes have 128 bits, so unlike lines are taken as equal with a
probability below 1e-14 at 10^12 lines.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LINES = "h1 long, h2 long, doc_id long, row_key long, pos int"
_ORDER = ["h1", "h2", "doc_id", "row_key", "pos"]


def _cells(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def line_key(line: bytes) -> bytes:
    return line.strip(common.BLANKS).lower()  # bytes.lower() maps A-Z alone


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least


def _explode(least: int):
    def run(batches):
        for batch in batches:
            docs, digests, rows, at = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), _cells(batch.column(1))):
                key_of_row = xxhash.xxh64_intdigest(text, 42)
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, least):
                        docs.append(doc)
                        rows.append(key_of_row)
                        at.append(pos)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(docs, pa.int64()), pa.array(np.array(rows, dtype=np.uint64).view(np.int64)), pa.array(at, pa.int32())],
                names=_ORDER,
            )

    return run


def _edges_of_partition(batches):
    """The first row and the last run of a sorted partition."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if batch.num_rows:
            a, b, d = (batch.column(i).to_numpy() for i in range(3))
            first = first or (int(a[0]), int(b[0]), int(d[0]))
            same = np.flatnonzero((a != a[-1]) | (b != b[-1]))
            start = int(same[-1]) + 1 if len(same) else 0
            head = (int(a[-1]), int(b[-1]), int(d[start]))
            last = last if start == 0 and last and last[:2] == head[:2] else head
    if first:
        yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), **{k: pa.array([v], pa.int64()) for k, v in zip(("f1", "f2", "fd", "l1", "l2", "ld"), first + last)}})


def _losers(carry: dict):
    """Positions whose hash an earlier document holds."""

    def run(batches):
        from pyspark import TaskContext

        held = carry.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, d = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if held and (int(a[0]), int(b[0])) == held[:2]:
                new[0] = False
            starts = np.flatnonzero(new)
            run_no = np.cumsum(new)
            first = np.concatenate([[held[2] if held else 0], d[starts]])[run_no]
            held = (int(a[-1]), int(b[-1]), int(first[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (2, 3, 4)], names=["doc_id", "row_key", "pos"]).filter(pa.array(d != first))

    return run


def _bitmaps(batches):
    for batch in batches:
        maps = []
        for places in batch.column(2).to_pylist():
            keep = np.ones(max(places) // 8 * 8 + 8, dtype=np.uint8)
            keep[places] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "row_key", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(doc_id, row_key, keep)`` for documents that lose lines.

    ``row_key`` is the XXH64 (seed 42) of the text, to tell rows of one
    ``doc_id`` apart.  ``keep`` is a zlib-compressed bitmap, one bit a line up to
    the byte of the last dropped one, 0 for dropped; later lines stay.
    """
    spark = docs.sparkSession
    lines = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(_explode(least), _LINES)
    lines = common.checkpoint(lines.repartitionByRange(common.partitions(spark), *_ORDER).sortWithinPartitions(*_ORDER))
    carry, held = {}, None
    for r in sorted(lines.mapInArrow(_edges_of_partition, "pid int, f1 long, f2 long, fd long, l1 long, l2 long, ld long").collect()):  # one row a partition
        if held and held[:2] == (r.f1, r.f2):
            carry[r.pid] = held
            held = held if (r.l1, r.l2) == held[:2] else (r.l1, r.l2, r.ld)
        else:
            held = (r.l1, r.l2, r.ld)
    lost = lines.mapInArrow(_losers(carry), "doc_id long, row_key long, pos int")
    return lost.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, "doc_id long, row_key long, keep binary")


def dropped_places(keep: bytes | None) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8)) == 0) if keep else np.empty(0, dtype=int)


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """Number of lines, number dropped, and the lines that stay, joined."""
    lines = (text or b"").split(b"\n")
    places = dropped_places(keep)
    places = set(places.tolist())
    return len(lines), len(places), b"\n".join(x for i, x in enumerate(lines) if i not in places) if places else text or b""


def with_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """``docs`` with ``keep`` of its bitmap, null where all lines stay."""
    own = docs.withColumn("row_key", F.xxhash64("text"))
    return own.join(maps, ["doc_id", "row_key"], "left")


def _digests(batches):
    for batch in batches:
        found = [kept_lines(t, k) for t, k in zip(_cells(batch.column(1)), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def _texts(batches):
    for batch in batches:
        kept = [kept_lines(t, k)[2].decode() for t, k in zip(_cells(batch.column(1)), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(doc_id, text)`` with the repeated lines gone."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return with_bitmaps(docs, keep_bitmaps(docs, least)).select("doc_id", "text", "keep").mapInArrow(_texts, "doc_id long, text string")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "text", "keep").mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE first_doc < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first_doc IS NULL OR first_doc >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (k) GROUP BY doc_id
"""
