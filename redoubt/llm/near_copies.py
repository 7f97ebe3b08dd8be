"""Near copies by SimHash candidates and an exact check of their similarity.

Two texts are linked if the Jaccard similarity of their sets of word shingles
is at least ``ALIKE``, a ratio of whole numbers.  SimHash only proposes the
pairs: the bits of several independent fingerprints of the set are cut into
keys, a key is a table, and texts that agree on a table's key share a bucket.
Bits of two texts at 0.8 differ with a chance of ``DIFFER`` or less, so the
number of tables follows from ``MISSED``, the chance that such a pair shares
none.  Buckets are compared in vertical bit planes as in ``simhash``; a second
fingerprint sorts out nearly all pairs that only chance brought together.  A
bitmap holds the parity of the shingles that hash to each of its bits; two
texts differ in at least as many shingles as their bitmaps do in bits, so pairs
that can't be alike go without a look at them, among them nearly all of those in
a large group of copies that are all a little too unlike each other.  Every pair
that is left is checked on the two texts.

Texts with the same shingles are one node, so copies never meet.  A first round
checks a spanning forest of each bucket's candidates, which joins large groups
without their pairs; the second one checks every candidate pair that the first
left in different components.

Definitions: null and empty texts have no shingles and are copies of each
other.  ``doc_id`` counts as in ``simhash``.  Rows that repeat a text are copies, an
empty table has no components, and ``dedup`` keeps all columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

ALIKE = (4, 5)
DIFFER = 0.17  # angle of two sets at 0.8 is 0.15 of a half turn; majorities of few shingles differ a little more
MISSED = 0.005
UNLIKE = 512  # unlike texts that share a bucket by chance
NEAR, NEAR_BOTH = 20, 36  # differing bits of the first and of the first two fingerprints, of 64 and 128


def layout(n: int) -> tuple[int, int]:
    """Bits of a key and the number of tables for ``n`` texts."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / UNLIKE)))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** bits)))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of shingle hashes, sorted."""
    return np.unique(simhash.shingle_hashes((text or "").encode(), words, simhash.SEED))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * ALIKE[1] >= (len(a) + len(b) - both) * ALIKE[0]


BITS, MOST_SIZE = 240, 0xFFFF  # of a bitmap; and the number of shingles from which on it says nothing
WORDS = ("b0", "b1", "b2", "b3")  # a bitmap, with the set's size in the last 16 bits


def bitmap(own: np.ndarray) -> list[int]:
    """The parities of a set's shingles, and its size, in words of 64 bits."""
    at = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BITS)
    odd = np.flatnonzero(np.bincount(at.astype(np.int64), minlength=BITS) & 1).tolist()
    bits = sum(1 << b for b in odd) | min(len(own), MOST_SIZE) << BITS
    return [bits >> 64 * i & (1 << 64) - 1 for i in range(4)]


def may_be_alike(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """False where the bitmaps of two sets, word by word, show that they differ too much."""
    a, b = (w[3] >> np.uint64(48) for w in (x, y))
    last = (x[3] ^ y[3]) & np.uint64((1 << 48) - 1)
    differ = sum(np.bitwise_count(w).astype(int) for w in (*(x[i] ^ y[i] for i in range(3)), last))
    both = a.astype(int) + b.astype(int)
    # |A| + |B| is twice what they share and what differs, and shared / (shared + differing) must reach the ratio.
    return ((both - differ) * ALIKE[1] >= (both + differ) * ALIKE[0]) | (a == MOST_SIZE) | (b == MOST_SIZE)


def _marks(words: int, takes: int):
    def run(batches):
        for batch in batches:
            nodes, found = [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, words)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 1))
                found.append([*(simhash.fingerprint(None, take=i, hashes=own) for i in range(takes)), *bitmap(own)])
            fps = np.array(found, dtype=np.uint64).reshape(-1, takes + 4).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(fps.tolist(), pa.list_(pa.int64()))], names=["doc_id", "of_text", "node", "fps"]
            )

    return run


def _met(cols: list[np.ndarray], forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of nodes in whole buckets of (table, key, part, fp, second, four words of a bitmap, node, root) in different components."""
    key = np.stack(cols[:3], axis=1)
    new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
    alone = new & np.concatenate([new[1:], [True]])
    fps, second, *maps, nodes, roots = (c[~alone] for c in cols[3:])
    fps, second, *maps = (c.view(np.uint64) for c in (fps, second, *maps))
    starts = np.flatnonzero(new[~alone])
    left, right = [nodes[:0]], [nodes[:0]]
    for first, rows, blocks, lanes, _ in simhash.near_lanes(fps, starts, NEAR) if len(fps) else ():
        above: dict[int, int] = {}
        for at in range(0, len(rows), 4096):  # a row and a word of 64 lanes each
            bits = np.unpackbits(lanes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, lane = np.nonzero(bits)
            u, v = first + rows[at + which], first + blocks[at + which] * 64 + lane
            far = np.bitwise_count(fps[u] ^ fps[v]).astype(int) + np.bitwise_count(second[u] ^ second[v])
            fit = (u < v) & (far <= NEAR_BOTH) & (roots[u] != roots[v]) & may_be_alike([m[u] for m in maps], [m[v] for m in maps])
            u, v = u[fit], v[fit]
            if forest and len(u):
                u, v = _spanning(u, v, above)
            left.append(nodes[u])
            right.append(nodes[v])
    return np.concatenate(left), np.concatenate(right)


def _spanning(u: np.ndarray, v: np.ndarray, above: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that join two trees of the forest ``above``, which grows by them."""
    kept = []

    def top(x):
        while x in above:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append(i)
    return u[kept], v[kept]


def _candidates(forest: bool):
    def pairs_of(cols):
        u, v = _met(cols, forest)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    def run(batches):
        for cols in simhash.whole_buckets(batches, 11):
            yield pairs_of(cols)

    return run


def candidates(marks: DataFrame, roots: DataFrame | None, bits: int, tables: int, most: int = simhash.BUCKET) -> DataFrame:
    """``(u, v)``: distinct pairs of nodes that a table brought together and the
    fingerprints don't tell apart.  ``roots`` are components known so far; without them, forests."""
    per = 64 // bits
    entry = [F.struct(F.lit(i).alias("tab"), F.shiftrightunsigned(F.col("fps")[i // per], i % per * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("key")) for i in range(tables)]
    own = marks if roots is None else marks.join(roots.withColumnRenamed("root", "known"), "node", "left")
    rows = own.select(F.explode(F.array(*entry)).alias("e"), F.col("fps")[0].alias("fp"), F.col("fps")[1].alias("second"), *[F.element_at("fps", i - 4).alias(w) for i, w in enumerate(WORDS)], "node", (F.col("node") if roots is None else F.coalesce("known", "node")).alias("root"))
    dealt = simhash.deal(rows.select("e.tab", "e.key", "fp", "second", *WORDS, "node", "root"), most, "node", "node")  # in their order forests of many tables share links
    return dealt.mapInArrow(_candidates(roots is None), "u long, v long").distinct()


def _checked(words: int):
    def run(batches):
        for batch in batches:
            last, own, fit = None, None, []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if last != u:
                    last, own = u, shingles(a, words)
                fit.append(alike(own, shingles(b, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(fit, pa.bool_()))

    return run


def checked(pairs: DataFrame, marks: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs whose texts are alike."""
    pairs = common.checkpoint(pairs)
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    named = marks.select("node", "of_text").join(needed, "node", "left_semi")
    texts = docs.select(F.xxhash64("text").alias("of_text"), "text").join(named, "of_text").groupBy("node").agg(F.first("text").alias("text"))
    texts = common.checkpoint(texts)
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return common.checkpoint(both.select("u", "v", "a", "b").mapInArrow(_checked(words), "u long, v long"))


def near_copies(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, component_id)`` for every row; ``component_id`` is the smallest
    ``doc_id`` reachable over links of texts that are alike."""
    bits, tables = layout(docs.count())
    takes = max(2, -(-tables // (64 // bits)))
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text")
    all_marks = common.checkpoint(read.mapInArrow(_marks(words, takes), "doc_id long, of_text long, node long, fps array<long>"))
    marks = common.checkpoint(all_marks.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("of_text").alias("of_text"), F.first("fps").alias("fps")))
    links = checked(candidates(marks, None, bits, tables), marks, docs, words)
    roots = common.checkpoint(common.connected_components(links))
    more = checked(candidates(marks, roots, bits, tables), marks, docs, words)
    roots = common.connected_components(links.union(more))
    rooted = marks.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(common.dealt_anew("root").alias("root"), "component_id")
    return all_marks.select("doc_id", "node").join(rooted.join(of_root, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def dedup(docs: DataFrame, words: int) -> DataFrame:
    """The rows of each component's smallest ``doc_id``, as ``simhash.dedup`` keeps them."""
    return simhash.least_rows(docs, near_copies(docs, words))
