"""SimHash near-dedup with bit-sliced comparison.

A document's fingerprint has a bit set where over half its shingle hashes have
it.  Only distinct fingerprints are compared, so exact copies never meet.
Fingerprints within the radius agree on all but ``radius`` of any k blocks of
bits; every choice of ``k - radius`` blocks is one table, and only fingerprints
that agree on a table's blocks share a bucket.  k grows with the number of
fingerprints so that buckets of unlike ones stay small; the links found are the
same for every k.

Inside a bucket the fingerprints lie in vertical bit planes, 64 to a word.
Carry-save counters add up one plane after another for 64 distances at once; a
block all of whose lanes exceed the radius is abandoned.  A bucket returns a
spanning forest of its links, never its pairs.  A bucket of more than
``BUCKET`` fingerprints is cut into chunks and each pair of chunks is a bucket
of its own, so near copies that share all blocks spread over many tasks.

With ``takes`` above 1 the shingles give that many independent fingerprints and
two documents are linked if any pair of theirs is: copies that differ by more
words than one fingerprint can tell are then found with far better odds.

Definitions: null and empty texts have fingerprint zero, linked like any other.
A row without ``doc_id`` takes part; it never names a component that holds
another row.  Rows that repeat a ``doc_id`` are all returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS, RADIUS, SEED = 4, 4, 42
BUCKET = 4096
BROADCAST_ROWS = 10_000  # large buckets, of 24 bytes each, up to which they are broadcast
_LANES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    parts = text.lower().split()  # for bytes, both know ASCII alone
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate([[0], ends[: len(parts) - words]]).tolist()
    return np.array([digest(joined[a:z], seed) for a, z in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)


def remixed(hashes: np.ndarray, take: int) -> np.ndarray:
    """The shingle hashes of the ``take``-th fingerprint: the hashes themselves, then bijective mixes of them."""
    if not take:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * take & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED, take: int = 0, hashes: np.ndarray | None = None) -> int:
    hashes = shingle_hashes(text or b"", words, seed) if hashes is None else hashes
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        some = remixed(hashes[at : at + 65536], take)
        ones += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int, takes: int):
    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text or b"", words, seed)
                found.append([fingerprint(None, take=i, hashes=hashes) for i in range(takes)])
            fps = np.array(found, dtype=np.uint64).reshape(-1, takes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps[:, 0].copy()), pa.array(fps[:, 1:].tolist(), pa.list_(pa.int64()))], names=["doc_id", "fp", "more"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, takes: int = 1) -> DataFrame:
    """``(doc_id, fp, more)``: the fingerprint, and ``takes - 1`` independent others of the same shingles."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(words, seed, takes), "doc_id long, fp long, more array<long>")


def tables_for(distinct: int, radius: int) -> list[int]:
    """Bit masks of the tables: the fewest blocks that leave at most 1024 unlike
    fingerprints to a bucket, which is cheaper to compare in planes than to deal out in more tables."""
    k = radius + 1
    while k < 2 * radius and distinct / 2 ** (64 * (k - radius) / k) > 1024:
        k += 1
    cuts = [round(64 * i / k) for i in range(k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(blocks, k - radius)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 x blocks words: word [b, j] holds bit b of the 64 fingerprints of block j."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def _alive(planes: np.ndarray, query: np.ndarray, block: np.ndarray, dead: np.ndarray, radius: int) -> tuple:
    """For pairs (query fingerprint, block): the lanes within the radius, of pairs that have any."""
    width = radius.bit_length()
    kept, counters, over = np.arange(len(query)), [np.zeros(len(query), dtype=np.uint64) for _ in range(width)], dead.copy()
    for b in range(64):
        carry = planes[b][block] ^ (np.uint64(0) - (query >> np.uint64(b) & np.uint64(1)))
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b >= radius and b % 6 == 5 or b == 63:
            above = over.copy()
            if radius + 1 < 1 << width:
                more, equal = np.zeros_like(over), np.full_like(over, _LANES)
                for i in reversed(range(width)):
                    if radius >> i & 1:
                        equal &= counters[i]
                    else:
                        more |= equal & counters[i]
                        equal &= ~counters[i]
                above |= more
            live = np.flatnonzero(above != _LANES)
            if len(live) < len(kept) or b == 63:
                kept, query, block, over = kept[live], query[live], block[live], over[live]
                counters = [c[live] for c in counters]
                final = ~above[live]
            if not len(kept):
                return kept, np.empty(0, dtype=np.uint64)
    return kept, final


def _forest(n: int, rows: np.ndarray, blocks: np.ndarray, lanes: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (child, parent) of a bucket's links, given as lane words per (row, block), by breadth first."""
    order = np.argsort(rows, kind="stable")
    rows, blocks, lanes = rows[order], blocks[order], lanes[order]
    begin = np.searchsorted(rows, np.arange(n + 1))
    free = np.full(-(-n // 64), _LANES, dtype=np.uint64)
    out = []
    for root in np.unique(rows).tolist():
        if not free[root >> 6] >> np.uint64(root & 63) & np.uint64(1):
            continue
        free[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        todo = [root]
        while todo:
            u = todo.pop()
            a, z = begin[u], begin[u + 1]
            new = lanes[a:z] & free[blocks[a:z]]
            for j in np.flatnonzero(new).tolist():
                word, at = int(new[j]), int(blocks[a + j])
                free[at] &= ~np.uint64(word)
                while word:
                    low = word & -word
                    v = at * 64 + low.bit_length() - 1
                    out.append((v, root))
                    todo.append(v)
                    word ^= low
    return out


def near_lanes(fps: np.ndarray, starts: np.ndarray, radius: int):
    """For buckets ``fps[starts[i]:starts[i+1]]`` that hold fingerprints within the radius: the bucket's start, its
    links as lane words per (row, block), and its size."""
    sizes = np.diff(np.append(starts, len(fps)))
    n_blocks = -(-sizes // 64)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    padded = np.zeros(int(first_block[-1]) * 64, dtype=np.uint64)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(fps)) - starts[bucket]
    padded[first_block[bucket] * 64 + lane] = fps
    planes = _planes(padded)
    void = np.zeros(len(padded) // 64, dtype=np.uint64)
    part = sizes % 64 != 0
    void[first_block[1:][part] - 1] = _LANES << (sizes[part] % 64).astype(np.uint64)
    pairs = n_blocks[bucket]
    at, todo = 0, np.cumsum(pairs)
    got: dict[int, list] = {}
    while at < len(fps):
        till = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + 400_000, "right")))
        own = np.repeat(np.arange(at, till), pairs[at:till])
        within = np.arange(len(own)) - np.repeat(np.cumsum(pairs[at:till]) - pairs[at:till], pairs[at:till])
        block = first_block[bucket[own]] + within
        dead = void[block].copy()
        mine = within == lane[own] >> 6
        dead[mine] |= np.uint64(1) << (lane[own][mine] & 63).astype(np.uint64)
        kept, lanes = _alive(planes, fps[own], block, dead, radius)
        if len(kept):
            for b in np.unique(bucket[own[kept]]).tolist():
                a, z = np.searchsorted(bucket[own[kept]], [b, b + 1])
                got.setdefault(b, []).append((lane[own[kept[a:z]]], within[kept[a:z]], lanes[a:z]))
        at = till
    for b, found in got.items():
        yield int(starts[b]), *(np.concatenate(x) for x in zip(*found)), int(sizes[b])


def links(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of buckets ``fps[starts[i]:starts[i+1]]``, each without repeats."""
    left, right = [], []
    for start, rows, blocks, lanes, size in near_lanes(fps, starts, radius):
        for child, parent in _forest(size, rows, blocks, lanes):
            left.append(start + child)
            right.append(start + parent)
    return fps[np.array(left, dtype=int)], fps[np.array(right, dtype=int)]


def whole_buckets(batches, width: int):
    """The first ``width`` columns of batches sorted by (table, key, part), in runs of whole buckets."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy().astype(np.int64) for i in range(width)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = len(same) - int(same.sum())
        if cut >= 16384:
            yield [c[:cut] for c in cols]
            cols = [c[cut:] for c in cols]
        held = cols
    if held is not None:
        yield held


def _buckets(radius: int, tables: int):
    """Batches sorted by (table, key, part) to links; a bucket may span batches."""

    def done(cols):
        key = np.stack(cols[:3], axis=1)
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
        alone = new & np.concatenate([new[1:], [True]])
        fps, new = cols[3].view(np.uint64)[~alone], new[~alone]
        return links(fps, np.flatnonzero(new), radius) if len(fps) else (fps, fps)

    def batch_of(take, pair):
        u, v = (x.view(np.int64) for x in pair)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), take, dtype=np.int32)), pa.array(u), pa.array(v)], names=["take", "u", "v"])

    def by_take(cols):
        take = cols[0] // tables
        for t in np.unique(take).tolist():
            yield batch_of(t, done([c[take == t] for c in cols]))

    def run(batches):
        for cols in whole_buckets(batches, 4):
            yield from by_take(cols)

    return run


def deal(rows: DataFrame, most: int, by: str = "fp", *then: str) -> DataFrame:
    """``rows`` with ``tab`` and ``key`` and a ``part`` after them, dealt to tasks and sorted by the three (and ``then``); buckets of more than
    ``most`` are cut into chunks by a hash of ``by``, and each pair of chunks is a part."""
    rest = [c for c in rows.columns if c not in ("tab", "key")]
    # Only large buckets need their size: chunks of one meet two by two; a small bucket is one part.
    large = common.checkpoint(rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > most))
    chunks = F.ceil(F.col("n") / (most // 2)).cast("int")
    own = F.pmod(F.xxhash64(by, F.lit(7)), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(j, own) * chunks + F.greatest(j, own))
    parts = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.array_except(others, F.array(own * chunks + own)))
    many = large.count()
    if many:
        met = rows.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, ["tab", "key"], "left")
        dealt = met.select("tab", "key", F.explode(parts).alias("part"), *rest)
    else:
        dealt = rows.select("tab", "key", F.lit(-1).alias("part"), *rest)
    order = ["tab", "key", "part"]
    return dealt.repartition(common.partitions(rows.sparkSession), *order).sortWithinPartitions(*order, *then)


def near_links(distinct: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """``(take, u, v)``: for each ``take`` of the distinct ``(take, fp)``, links that
    span every component of its fingerprints within ``radius``."""
    per_take = distinct.groupBy("take").count().agg(F.max("count")).first()[0] or 0
    masks = tables_for(per_take, radius)
    entry = F.explode(F.array(*[F.struct((F.col("take") * len(masks) + i).alias("tab"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key")) for i, m in enumerate(masks)]))
    rows = distinct.select("fp", entry.alias("e")).select("e.tab", "e.key", "fp")
    dealt = deal(rows, most)
    return dealt.mapInArrow(_buckets(radius, len(masks)), "take int, u long, v long")


def components(fps: DataFrame, radius: int = RADIUS, takes: int = 1) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``fps``; ``component_id`` is
    the smallest ``doc_id`` reachable over links of any take."""
    distinct = common.checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if takes == 1:
        edges = near_links(distinct.select(F.lit(0).alias("take"), "fp"), radius).select("u", "v")
    else:
        # Every take names a row's first fingerprint; its own value links the rows that share it or come near.
        every = F.explode(F.transform(F.concat(F.array("fp"), "more"), lambda x, i: F.struct(i.cast("int").alias("take"), x.alias("f"))))
        named = common.checkpoint(fps.select("fp", every.alias("e")).select("e.take", F.col("e.f").alias("f"), "fp").distinct())
        first = named.groupBy("take", "f").agg(F.min("fp").alias("name"))
        near = near_links(first.select("take", F.col("f").alias("fp")), radius)
        ends = near.join(first.select("take", F.col("f").alias("u"), F.col("name").alias("a")), ["take", "u"]).join(first.select("take", F.col("f").alias("v"), F.col("name").alias("b")), ["take", "v"])
        edges = ends.select(F.col("a").alias("u"), F.col("b").alias("v")).union(named.join(first, ["take", "f"]).where("fp <> name").select("fp", "name"))
    roots = common.connected_components(edges).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(common.dealt_anew("root").alias("root"), "component_id")
    return fps.select("doc_id", "fp").join(rooted.join(of_root, "root").select("fp", "component_id"), "fp")


def near_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED, takes: int = 1) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    return components(common.checkpoint(fingerprints(docs, words, seed, takes)), radius, takes)


def dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, takes: int = 1) -> DataFrame:
    """The rows of each component's smallest ``doc_id``, without repeats of a
    row's text under one ``doc_id``.  Rows without ``doc_id`` all stay."""
    return least_rows(docs, near_components(docs, words, radius, takes=takes))


def least_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that ``dedup`` keeps, given the ``component_id`` of every row."""
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_stays")).distinct()
    packed = docs.select("doc_id", F.xxhash64("text").alias("of_text"), F.struct("*").alias("row"))
    kept = packed.join(stay, F.col("doc_id") == F.col("_stays"), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "of_text").orderBy(F.xxhash64("row")))
    return kept.withColumn("place", place).where("place = 1").select("row.*").union(docs.where("doc_id is null"))


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
