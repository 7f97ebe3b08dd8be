"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to blocks of about ``BLOCK`` rows: by the nearest of a few
pivots, and a pivot's rows evenly where there are too many.  Each block becomes
a cover tree; the queries are dealt and indexed the same way.  A node holds a
centre, its covering radius, and children whose centres are farthest points of
each other, so they cover the node at a smaller radius and stand at least that
radius apart.  Levels aren't tied to powers of a base: in many dimensions a
halved radius needs a child a row, so a node has at most ``FANOUT`` children.

A pair of nodes with centres c, d and radii r, s is pruned when the largest
inner product that these allow,
  c.d + |c| s + |d| r + r s,
is below the worst kth score of the query node's queries.  Those scores start
from ``SAMPLE`` data rows that every task holds.  Whole blocks are pruned first,
by their root nodes alone: the centres of the data blocks, of which there are at
most about twice ``BALLS`` since blocks grow beyond that, go to all tasks, and
only pairs of blocks that are left are brought together.  Blocks of data fall
into slots, blocks of queries into bundles; each (slot, bundle) is a task.  In it
node pairs go best bound first and leaves are compared by one matrix product.
Ties with the kth score are kept to the end, where smaller ids win.

Scores are exact: whole numbers in float32, float64 or Python integers,
whichever holds the largest possible product.  Inner products beyond 64 bits
are cut off there.

Definitions: a component x counts as floor(64 x).  Vectors that are null or hold
a null or non-finite component, and rows without ``vec_id``, take no part; the
shorter of two vectors counts as ending in zeros.  A query's own ``vec_id`` is
never its candidate.  Rows that repeat a ``vec_id`` are each a candidate; if they
repeat a query's vector too, the query is answered once.  Copies of a row are
dealt evenly among a pivot's blocks.  A block is held in memory whole, so very
long vectors need smaller blocks.  Empty tables give no rows; columns but
``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import pickle
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, QUERY_BLOCK, BUNDLE = 8192, 2048, 16
SAMPLE = 2048
BALLS = 16_384
LEAF, FANOUT = 128, 12


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))


def quantised(rows: list, width: int | None = None) -> np.ndarray:
    """A matrix of floor(64 x), short vectors ending in zeros."""
    width = max([width or 0, *map(len, rows)])
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = np.floor(64 * np.asarray(r, dtype=float)) if len(r) else 0
    return out


def whole(m: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The matrices in the narrowest type in which their products are exact."""
    both = (m,) if other is None else (m, other)
    most = max((float(np.abs(x).max(initial=0)) for x in both), default=0.0) ** 2 * m.shape[1]
    if most < 1 << 24:
        return tuple(x.astype(np.float32) for x in both)
    if most < 1 << 53:
        return both
    return tuple(np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape) for x in both)


# ---- the tree


class Tree:
    """A cover tree over the rows of ``m``: nodes in arrays, rows of a node together.

    ``span`` is a node's range in ``order``; ``kids`` its range of nodes, empty for a leaf.
    """

    def __init__(self, m: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.order = np.arange(len(m))
        centres, radii, spans, kids = [m[0]], [float(np.sqrt(((m - m[0]) ** 2).sum(axis=1).max()))], [(0, len(m))], [(0, 0)]
        at = 0
        while at < len(centres):
            a, z = spans[at]
            if z - a > leaf and radii[at] > 0:
                rows = m[self.order[a:z]]
                # Farthest-first centres; each row to its nearest one.
                chosen, far = [centres[at]], ((rows - centres[at]) ** 2).sum(axis=1)
                near = np.zeros(z - a, dtype=int)
                while len(chosen) < fanout and far.max() > 0:
                    new = rows[far.argmax()]
                    d = ((rows - new) ** 2).sum(axis=1)
                    near[d < far] = len(chosen)
                    far = np.minimum(far, d)
                    chosen.append(new)
                by = np.argsort(near, kind="stable")
                self.order[a:z] = self.order[a:z][by]
                ends = a + np.cumsum(np.bincount(near, minlength=len(chosen)))
                begin, first = a, len(centres)
                for i, end in enumerate(ends.tolist()):
                    if end > begin:
                        centres.append(chosen[i])
                        radii.append(float(np.sqrt(far[near == i].max())))
                        spans.append((begin, end))
                        kids.append((0, 0))
                        begin = end
                kids[at] = first, len(centres)
            at += 1
        self.centres, self.spans, self.kids = np.array(centres), spans, kids
        self.radii = np.array(radii) * (1 + 1e-9)
        self.norms = np.sqrt((self.centres**2).sum(axis=1))


def upper(q: Tree, i: int, d: Tree, nodes: np.ndarray) -> np.ndarray:
    """The largest inner product between a row of query node i and one of each data node."""
    plain = d.centres[nodes, : q.centres.shape[1]] @ q.centres[i]
    bound = plain + q.norms[i] * d.radii[nodes] + d.norms[nodes] * q.radii[i] + q.radii[i] * d.radii[nodes]
    return bound + 1e-9 * (np.abs(bound) + 1)


class Best:
    """The k best of each query so far: score high, then id low; ``floor`` may only be lowered by real candidates."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.astype(float)
        self.held: list[list] = [[] for _ in floors]

    def offer(self, q: int, scores, ids) -> None:
        held = self.held[q]
        held += zip((-s for s in scores), ids)
        if len(held) >= 2 * self.k:
            self.trim(q)

    def trim(self, q: int) -> None:
        self.held[q] = sorted(self.held[q])[: self.k]
        if len(self.held[q]) == self.k:
            self.floor[q] = max(self.floor[q], float(-self.held[q][-1][0]))


def search(q: Tree, qm, q_ids, d: Tree, dm, d_ids, best: Best, pairs: list | None = None) -> None:
    """Offer to ``best`` every row of ``d`` that may be among a query's k best."""
    qm, dm = whole(qm, dm)
    qs, ds = qm[q.order], dm[d.order]
    q_of, d_of = np.asarray(q_ids)[q.order], np.asarray(d_ids)[d.order]

    def visit(i: int, nodes: np.ndarray) -> None:
        a, z = q.spans[i]
        bounds = upper(q, i, d, nodes)
        keep = bounds >= best.floor[q.order[a:z]].min()
        nodes, bounds = nodes[keep], bounds[keep]
        first, last = q.kids[i]
        if last > first:
            wider = [np.arange(*d.kids[n]) if d.kids[n][1] > d.kids[n][0] else np.array([n]) for n in nodes.tolist()]
            nodes = np.concatenate(wider) if wider else nodes
            for kid in range(first, last):
                visit(kid, nodes)
            return
        todo = sorted(zip((-bounds).tolist(), nodes.tolist()))
        while todo:
            bound, n = heappop(todo)
            if -bound < best.floor[q.order[a:z]].min():
                break
            lo, hi = d.kids[n]
            if hi > lo:
                below = np.arange(lo, hi)
                for b, x in zip(upper(q, i, d, below).tolist(), below.tolist()):
                    heappush(todo, (-b, x))
                continue
            s, e = d.spans[n]
            if pairs is not None:
                pairs.append((z - a) * (e - s))
            scores = qs[a:z] @ ds[s:e].T
            fine = (scores >= best.floor[q.order[a:z]][:, None]) & (d_of[None, s:e] != q_of[a:z, None])
            for row in np.flatnonzero(fine.any(axis=1)).tolist():
                at = np.flatnonzero(fine[row])
                best.offer(int(q.order[a + row]), scores[row, at].tolist(), d_of[s + at].tolist())
                best.trim(int(q.order[a + row]))

    visit(0, np.array([0]))


# ---- over all rows


def _cells(pivots: np.ndarray):
    norms = (pivots**2).sum(axis=1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                m = quantised(some.column(1).to_pylist(), pivots.shape[1])
                cell = (norms[None, :] - 2 * m[:, : pivots.shape[1]] @ pivots.T).argmin(axis=1) if len(pivots) else np.zeros(len(m), dtype=int)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    return run


def _pack(key, table):
    """One row: ids, matrix and cover tree of a block."""
    m = quantised(table.column("v").to_pylist())
    ids = table.column("vec_id").to_numpy()
    by = np.lexsort((*m.T, ids)) if m.shape[1] else np.argsort(ids, kind="stable")
    m, ids = m[by], ids[by]
    small = m.astype(np.int16) if np.abs(m).max(initial=0) < 1 << 15 else m
    tree = Tree(m)
    return pa.table({"block": pa.array([key[0].as_py()], pa.string()), "centre": pa.array([tree.centres[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(tree.radii[0])]), "pack": pa.array([pickle.dumps((ids, small, tree), 5)], pa.binary())})


def blocks(rows: DataFrame, size: int, mark: str) -> DataFrame:
    """``(block, centre, radius, pack)`` of the settled ``rows(vec_id, v, cell)``, each of about ``size`` rows at most."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("subs"))
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())  # settled rows keep it
    named = rows.withColumn("place", place).join(counts, "cell").withColumn("block", F.concat_ws("-", F.lit(mark), "cell", F.pmod("place", "subs")))
    return named.select("block", "vec_id", "v").groupBy("block").applyInArrow(_pack, "block string, centre array<double>, radius double, pack binary")


def _promising(balls: list, sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """Pairs of a block of queries and a block of data whose root nodes aren't pruned."""

    def run(batches):
        width = max([sample.shape[1], *(len(c) for _, c, _ in balls)])
        centres = padded(np.array([c + [0.0] * (width - len(c)) for _, c, _ in balls]).reshape(len(balls), width), width)
        radii, norms, names = np.array([r for _, _, r in balls]), np.sqrt((centres**2).sum(axis=1)), np.array([b for b, _, _ in balls])
        for batch in batches:
            for block, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q_ids, qm, tree = pickle.loads(pack)
                full = max(width, qm.shape[1])
                floor = floors(padded(qm, full), q_ids, padded(sample, full), sample_ids, k).min()
                c, r = padded(tree.centres[:1], full)[0], tree.radii[0]
                bound = centres @ c[:width] + tree.norms[0] * radii + norms * r + r * radii
                near = names[bound + 1e-9 * (np.abs(bound) + 1) >= floor]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(near), pa.string()), pa.array(near.tolist(), pa.string())], names=["q", "d"])

    return run


def _meet(sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """For the blocks of data of a slot and a bundle of query blocks: each query's k best of them."""

    def run(key, left, right):
        out: list[list] = [[], [], [], []]
        packs = [pickle.loads(x) for x in left.column("pack").to_pylist()]
        for packed in right.column("pack").to_pylist() if packs else ():
            q_ids, qm, q = pickle.loads(packed)
            width = max(sample.shape[1], qm.shape[1], *(p[1].shape[1] for p in packs))
            qm = padded(qm, width)
            q.centres = padded(q.centres, width)
            best = Best(floors(qm, q_ids, padded(sample, width), sample_ids, k), k)
            for d_ids, dm, d in packs:
                d.centres = padded(d.centres, width)
                search(q, qm, q_ids, d, padded(dm, width), d_ids, best)
            for i, held in enumerate(best.held):
                name = hash_row(qm[i])
                for score, vec in sorted(held)[:k]:
                    out[0].append(int(q_ids[i]))
                    out[1].append(name)
                    out[2].append(int(vec))
                    out[3].append(max(-(1 << 63), min((1 << 63) - 1, -int(score))))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query_key", "vec_id", "score"), out)})

    return run


def padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m.astype(float), ((0, 0), (0, width - m.shape[1]))) if len(m) else np.zeros((0, width))


def hash_row(row: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(np.trim_zeros(row, "b").tobytes()) - (1 << 63)


def floors(qm: np.ndarray, q_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth best score among the sample: no more than its kth best among all."""
    if len(sample) <= k:
        return np.full(len(qm), -np.inf)
    a, b = whole(qm, sample)
    scores = np.array(a @ b.T, dtype=float)
    scores[q_ids[:, None] == sample_ids[None, :]] = -np.inf
    return np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of usable rows ``(vec_id, v)``."""
    n = data.count()
    block = max(block, -(-n // BALLS))
    schema = "query_id long, query_key long, vec_id long, score long"
    # A bounded sample by hash: pivots, and the floors of the kth scores.
    picked = sorted((r.vec_id, tuple(r.v)) for r in data.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))).collect())
    sample_ids, seen = np.array([r[0] for r in picked], dtype=np.int64), quantised([r[1] for r in picked])
    pivots = seen[:: max(1, len(seen) // max(1, min(len(seen), -(-n // block))))]
    dealt = common.checkpoint(data.mapInArrow(_cells(pivots), "vec_id long, v array<double>, cell int"))
    asked = common.checkpoint(queries.mapInArrow(_cells(pivots), "vec_id long, v array<double>, cell int").dropDuplicates(["vec_id", "v"]))
    d_blocks, q_blocks = common.checkpoint(blocks(dealt, block, "d")), common.checkpoint(blocks(asked, query_block, "q"))
    bundles, slots = max(1, -(-q_blocks.count() // BUNDLE)), max(1, -(-n // block))
    balls = sorted((r.block, list(r.centre), r.radius) for r in d_blocks.select("block", "centre", "radius").collect())  # some BALLS rows
    pairs = common.checkpoint(q_blocks.select("block", "pack").mapInArrow(_promising(balls, sample_ids, seen, k), "q string, d string"))

    def among(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    left = d_blocks.join(pairs.select(F.col("d").alias("block"), among("q", bundles).alias("bundle")).distinct(), "block").select(among("block", slots).alias("slot"), "bundle", "pack")
    right = q_blocks.join(pairs.select(F.col("q").alias("block"), among("d", slots).alias("slot")).distinct(), "block").select(among("block", bundles).alias("bundle"), "slot", "pack")
    met = left.groupBy("slot", "bundle").cogroup(right.groupBy("slot", "bundle")).applyInArrow(_meet(sample_ids, seen, k), schema)
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = usable(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
