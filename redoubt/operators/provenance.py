"""Provenance: a salted, hash-chained manifest of what was withheld and why."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RedactionError
from .redact import digests

ZERO = "0" * 64
LEAST_SALT = 16
ENTRIES = (
    "doc_id string, seq int, previous string, operation_id string, strategy string, location string, reason_code string, authority string, entity_types array<string>, "
    "value_digest string, value_length int, hash string"
)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no absent values."""

    def bare(v):
        if isinstance(v, dict):
            return {k: bare(x) for k, x in v.items() if x is not None}
        return [bare(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(bare(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def entry_hash(body: dict) -> str:
    return _hash({k: v for k, v in body.items() if k not in ("hash", "doc_id")})


def _chain(salt: bytes):
    def run(key, table):
        rows, previous = [], ZERO
        for seq, op in enumerate(sorted(table.to_pylist(), key=lambda r: (r["location"], r["op_id"]))):
            original = op["original"]
            body = {
                "doc_id": op["doc_id"], "seq": seq, "previous": previous, "operation_id": op["op_id"], "strategy": op["strategy"], "location": op["location"], "reason_code": op["reason_code"],
                "authority": op["authority"], "entity_types": sorted(op["entity_types"]), "value_digest": ZERO if original is None else hashlib.sha256(salt + original.encode()).hexdigest(),
                "value_length": len(original or ""),
            }
            previous = body["hash"] = entry_hash(body)
            rows.append(body)
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("doc_id", pa.string()), ("seq", pa.int32()), ("previous", pa.string()), ("operation_id", pa.string()), ("strategy", pa.string()), ("location", pa.string()), ("reason_code", pa.string()),
    ("authority", pa.string()), ("entity_types", pa.list_(pa.string())), ("value_digest", pa.string()), ("value_length", pa.int32()), ("hash", pa.string()),
])


def manifest_entries(ops: DataFrame, found: DataFrame, salt: bytes) -> DataFrame:
    """The chain of each document, in the order of its locations; the salt stays in a closure."""
    if len(salt) < LEAST_SALT:
        raise RedactionError("E_USAGE", f"a manifest salt needs at least {LEAST_SALT} bytes")
    types = found.select(F.col("doc_id").alias("f_doc"), F.col("id").alias("f_id"), "type").distinct()
    named = ops.select("doc_id", "op_id", F.explode("finding_ids").alias("fid")).join(types, (F.col("doc_id") == F.col("f_doc")) & (F.col("fid") == F.col("f_id")), "left")
    kinds = named.groupBy(F.col("doc_id").alias("k_doc"), F.col("op_id").alias("k_op")).agg(F.array_sort(F.collect_set(F.coalesce("type", F.lit("unknown")))).alias("entity_types"))
    met = ops.join(kinds, (F.col("doc_id") == F.col("k_doc")) & (F.col("op_id") == F.col("k_op"))).select("doc_id", "op_id", "strategy", "location", "reason_code", "authority", "original", "entity_types")
    return met.groupBy("doc_id").applyInArrow(_chain(salt), ENTRIES)


def verify_chain(entries: DataFrame) -> DataFrame:
    """``(doc_id, intact, first_break)``: the first entry whose own hash or link doesn't hold."""

    def hashes(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows]), pa.array([r["seq"] for r in rows], pa.int32()), pa.array([r["previous"] for r in rows]), pa.array([r["hash"] for r in rows]), pa.array([entry_hash(r) for r in rows])], names=["doc_id", "seq", "previous", "hash", "again"])

    again = entries.mapInArrow(hashes, "doc_id string, seq int, previous string, hash string, again string")
    by = Window.partitionBy("doc_id").orderBy("seq")
    linked = again.withColumn("due", F.coalesce(F.lag("hash").over(by), F.lit(ZERO))).withColumn("place", F.row_number().over(by) - 1)
    broken = F.when((F.col("hash") != F.col("again")) | (F.col("previous") != F.col("due")) | (F.col("seq") != F.col("place")), F.col("place"))
    return linked.groupBy("doc_id").agg(F.min(broken).alias("first_break")).select("doc_id", F.col("first_break").isNull().alias("intact"), "first_break")


def manifests(entries: DataFrame, documents: DataFrame, report: DataFrame, policy, source: DataFrame, output: DataFrame, engine: str = "redoubt", sign=None, **issued) -> DataFrame:
    """One row a document: the summary as canonical JSON, the root over it and the chain's tail, and a signature if ``sign(bytes)`` is given.

    ``source`` and ``output`` are nodes; their digests are over the texts in order.  A document counts as verified only if its
    report says so and the verification wasn't degraded; one without a report isn't."""
    tail = entries.groupBy("doc_id").agg(F.max_by("hash", "seq").alias("tail"), F.count("*").alias("operations_listed"))
    met = documents.select("doc_id", "banner").join(tail, "doc_id", "left").join(report.select("doc_id", "passed", "degraded", "unverifiable", "defensible"), "doc_id", "left")
    met = met.join(digests(source, "source_digest"), "doc_id", "left").join(digests(output, "output_digest"), "doc_id", "left")
    policy_digest = _hash([policy.id, policy.version, [x.id for x in policy.levels], [[r.id, list(r.types), r.level] for r in policy.rules]])

    def close(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                summary = {
                    "engine": engine, "policy_id": policy.id, "policy_version": policy.version, "policy_digest": policy_digest, "banner": r["banner"], "operation_count": r["operations_listed"] or 0,
                    "verified": r["passed"] is True and r["degraded"] is False, "unverified_count": r["unverifiable"] or 0, "source_digest": r["source_digest"], "output_digest": r["output_digest"], **issued,
                }
                root = _hash({"summary": summary, "tail": r["tail"] or ZERO})
                out.append((r["doc_id"], canonical(summary), r["tail"] or ZERO, root, sign(bytes.fromhex(root)).hex() if sign else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(5)], names=["doc_id", "summary", "tail", "root", "signature"])

    return met.mapInArrow(close, "doc_id string, summary string, tail string, root string, signature string")


def confirm_removed(entries: DataFrame, salt: bytes, value: str) -> DataFrame:
    """Entries that withheld exactly this value."""
    return entries.where(F.col("value_digest") == hashlib.sha256(salt + value.encode()).hexdigest())
