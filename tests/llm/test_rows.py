"""Line dedup, mixing, SimHash and token shards on small fixtures, against brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from redoubt.llm import common, line_dedup, mixing, simhash, token_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, keep string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, 7, "k", "r") for i, t, s in rows], SCHEMA)


HARD = [
    (1, "Shared line number one\nown\n  SHARED LINE number one\t\nshort", "a"),
    (2, "shared line number one\nÄÖÜ shared umlaut line\nx", "b"),
    (2, "shared line number one\nÄÖÜ shared umlaut line\nx", "b"),
    (3, "ÄÖÜ shared umlaut line\näÖÜ shared umlaut line\n\n\nshort", None),
    (4, "", "a"),
    (5, None, "b"),
    (None, "shared line number one", "a"),
    (6, "word " * 30000 + "\nshared line number one", "c"),
    (7, "ÄÖÜäöüÄÖÜ\nÄÖÜäöüÄÖÜ", "c"),
    (8, "ÄÖÜäöüÄÖÜ\nÄÖÜäöüÄÖÜß", "c"),
    (9, "ÄÖÜäöüÄÖÜß", None),
]


def dedup_by_hand(rows):
    first = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) >= i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    some = random.Random(5)
    pool = [f"a line of some length {n}" for n in range(30)]
    more = [(100 + i, "\n".join(some.choices(pool + ["the very common line"] * 30, k=some.randrange(12))), "a") for i in range(150)]
    for rows in (HARD, HARD + more, []):
        df = docs(spark, rows)
        found = line_dedup.with_bitmaps(df.select("doc_id", "text"), line_dedup.keep_bitmaps(df)).select("doc_id", "text", "keep").mapInArrow(line_dedup._digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
        assert sorted(map(tuple, found.collect()), key=repr) == dedup_by_hand(rows)
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, HARD)).collect()}
    assert texts[1] == HARD[0][1] and texts[6] == "word " * 30000


def test_mixing(spark):
    rows = HARD + [(20 + i, "w " * (i % 7 * 40), f"s{i % 5}") for i in range(400)]
    out = mixing.mix_counts(docs(spark, rows).select("doc_id", "text", "source")).collect()
    assert len(out) == len(rows)
    totals, targets, taken = {}, {}, {}
    for r in out:
        totals[r.source] = totals.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        targets[r.source] = r.target
        assert r.copies <= 2
    order = sorted([s for s in totals if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        level = (1.5 * sum(totals.values()) - sum(2 * totals[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and weight[s] * level > 2 * totals[s]}
        if not above:
            break
        capped |= above
    for s in order:
        assert targets[s] == pytest.approx(2 * totals[s] if s in capped else weight[s] * level)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(totals.values()), rel=0.1)
    full = mixing.mixed(docs(spark, rows))
    assert full.columns == docs(spark, rows).columns and full.count() == sum(r.copies for r in out)
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert mixing.mixed(docs(spark, [(1, None, None), (2, "", "a")])).count() == 0


def fp_by_hand(text, words=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(root)
    for i, a in enumerate(every):
        for b in every[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in every}


def test_rows_without_id_draw_by_text(spark):
    rows = [(None, f"w {i} x", "a") for i in range(1000)] + [(7, f"v {i} y", "b") for i in range(1000)] + [(i, "z z z", "c") for i in range(1000)]
    out = mixing.mix_counts(docs(spark, rows).select("doc_id", "text", "source")).collect()
    for source in "abc":
        own = [r for r in out if r.source == source]
        taken, target = sum(r.size * r.copies for r in own), own[0].target
        assert abs(taken - target) < 0.06 * target + 6
    twice = mixing.mix_counts(docs(spark, [(1, "same", "a")] * 50 + [(2, "o", "b")]).select("doc_id", "text", "source")).where("doc_id = 1").collect()
    assert len({r.copies for r in twice}) == 1


def test_fingerprint():
    for t in ("", None, "a b", "One two  THREE\tfour\x0bfive six seven", "x " * 70000, "a b c d"):
        assert simhash.fingerprint((t or "").encode()) == fp_by_hand(t)


def test_links_span_what_brute_force_links(spark, monkeypatch):
    some = random.Random(3)
    fps = {some.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1}
    for seed in list(fps)[:40]:
        for _ in range(12):
            fps.add(seed ^ sum({1 << some.randrange(64) for _ in range(some.randrange(1, 7))}))
    centre = some.getrandbits(64)
    fps |= {centre ^ (1 << a | 1 << b) for a in range(64) for b in range(a)}  # one large group
    want = components_by_hand(fps, 4)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    for most in (4096, 256):
        roots = common.connected_components(simhash.near_links(df.selectExpr("0 as take", "fp"), 4, most).select("u", "v"))
        got = {r.node & (1 << 64) - 1: r.root for r in roots.collect()}
        groups = {}
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
        theirs = {}
        for f in fps:
            theirs.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))
    assert [len(simhash.tables_for(n, 4)) for n in (10**5, 10**8, 10**10)] == [5, 15, 35]


def test_simhash_components(spark):
    rows = HARD + [(50, "a b c d e", "a"), (49, "A b  c D e", "b"), (60, None, "a"), (None, None, "a"), (None, "zz top", "q")]
    got = simhash.near_components(docs(spark, rows)).collect()
    roots = components_by_hand({fp_by_hand(t) for _, t, _ in rows}, 4)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            r = roots[fp_by_hand(t)]
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, fp_by_hand(t), least.get(roots[fp_by_hand(t)])) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == want
    kept = simhash.dedup(docs(spark, rows))
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([i for i in {w[2] for w in want} if i is not None] + [None] * 3, key=repr)
    assert simhash.near_components(docs(spark, [])).count() == 0 and simhash.dedup(docs(spark, [])).count() == 0


def test_more_takes_link_worse_copies(spark):
    some = random.Random(9)
    rows = []
    for i in range(60):
        words = [f"w{some.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(words), "a"))
        for at in (50, 150, 250):  # three changed words: similarity 0.9 of five-word shingles
            words[at] = "changed"
        rows.append((1000 + i, " ".join(words), "b"))
    one, many = (simhash.near_components(docs(spark, rows), 5, 4, takes=t).where("doc_id <> component_id").collect() for t in (1, 12))
    assert all(r.doc_id == r.component_id + 1000 for r in [*one, *many])
    assert len(one) < len(many) and len(many) >= 45
    assert simhash.near_components(docs(spark, []), takes=3).count() == 0


SPACING = ["a  b", " lead", "trail ", "x\n\ny z", "tab\t tab", "nb sp  x", "<|endoftext|> stop <|endoftext|>", "it's John's  'quoted'", "\x00 nul \x00x", "12 345,67 \n 8", "日本語 テキスト", "a 　 b", "é   x", "\x1c a\x1cb \x85 c"]


def test_the_token_writer_gives_memory_back(monkeypatch, tmp_path):
    import pyarrow as pa
    from pyspark import TaskContext

    given = []
    monkeypatch.setattr(token_shards, "give_back", lambda: given.append(1))
    monkeypatch.setattr(token_shards, "TRIM_SLICES", 2)
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    n = 256 * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"text {i}" for i in range(n)])], names=["doc_id", "text"])
    made = list(token_shards._writer(token_shards.tokenizer_path(), str(tmp_path), 2, 1 << 20, 1 << 20)([batch]))
    assert len(given) == 3 and [b.column("n_docs").to_pylist() for b in made] == [[n]]  # each second slice, and at the end


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_shards.tokenizer_path())
    rows = HARD + [(100 + i, t, "a") for i, t in enumerate(SPACING)]
    folder = str(tmp_path / "shards")
    df = docs(spark, rows)
    manifest = token_shards.write_shards(df, token_shards.tokenizer_path(), folder, shard_ids=50)
    got = sorted(map(tuple, token_shards.read_shards(spark, manifest, folder).collect()), key=lambda r: r[1])
    ids = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]
    want = sorted((i if i is not None else -1, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids)
    assert sorted((r[0] if r[0] is not None else -1, r[2], r[3]) for r in got) == want
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in got if r[0] is not None] == sorted(i for i, _, _ in rows if i is not None)
    parts = manifest.collect()
    assert len(parts) > 4
    assert sorted(os.listdir(folder)) == sorted(r.name + end for r in parts for end in (".ids", ".keys", ".mph"))
    for r in parts:  # keyed access needs the ids and the index alone
        os.remove(f"{folder}/{r.name}.keys")
    lookup = token_shards.Lookup(parts, folder)
    for i, x in ids:
        if i is not None and i != 2:
            (found,) = lookup.find(i)
            assert found.tolist() == x
    assert sorted(x.tolist() for x in lookup.find(2)) == sorted([ids[1][1], ids[2][1]])
    assert lookup.find(12345) == [] and lookup.find(-1) == []
    assert token_shards.encode_table(spark, docs(spark, [])).count() == 0


def test_index_is_minimal_and_perfect():
    keys = list(range(-700, 70000, 7))
    raw = token_shards.build_index([None, None, *keys, keys[-1]], [5, 1, *[3] * len(keys), 4], 2)
    reads = []

    def read(at, size):
        reads.append(size)
        return raw[at : at + size]

    index = token_shards.Index(read)
    reads.clear()
    assert index.n == len(keys) and all(index.find(k) == (6 + 3 * i, [3]) for i, k in enumerate(keys[:-1]))
    assert max(reads) <= 24 and len(reads) == 3 * (len(keys) - 1)  # a seed, a slot and a length each
    assert index.find(keys[-1]) == (6 + 3 * (len(keys) - 1), [3, 4]) and index.lengths(0, 2).tolist() == [5, 1]
    assert sorted(index.find_all(np.array(keys))["first"].tolist()) == list(range(2, 2 + len(keys)))
    assert sum(index.find(k) is not None for k in range(1, 70000, 7)) <= 1
    empty = token_shards.build_index([], [], 2)
    assert token_shards.Index(lambda at, size: empty[at : at + size]).find(1) is None


def test_words_encode_alike_however_they_are_batched():
    from tokenizers import Tokenizer

    some = random.Random(3)
    words = ["".join(some.choice("abcdefghijklmnopqrstuvwxyzäöüßéñÉŁ") for _ in range(some.randrange(1, 14))) for _ in range(3000)]
    texts = [" ".join(some.choices(words, k=200)) for _ in range(40)]
    signs = " \n\t.,'’sdtmlrev0159ab \u3000漢é×÷\u0301!-\"\x1c\x85\r"
    texts += ["".join(some.choice(signs) for _ in range(some.randrange(60))) for _ in range(2000)] + ["x" * 3000 + " " * 700 + "y", "", "\n" * 300]
    coder, plain = token_shards.Encoder(token_shards.tokenizer_path(), most=500), Tokenizer.from_file(token_shards.tokenizer_path())  # generations turn over
    for at in range(0, len(texts), 7):
        got = coder.encode(texts[at : at + 7])
        assert [np.frombuffer(g, "<u2")[:-1].tolist() for g in got] == [e.ids for e in plain.encode_batch(texts[at : at + 7], add_special_tokens=False)]


def test_hashes_of_pieces_do_not_depend_on_their_place():
    hasher = token_shards.Hasher()
    raw = b"ab" * 700_000 + b"z" * 400 + b"ab"
    starts = np.append(np.arange(0, 1_400_000, 2), [1_400_000, 1_400_400])
    found = hasher(np.frombuffer(raw, dtype=np.uint8), starts, np.diff(starts, append=len(raw)))
    assert set(found[:-2].tolist()) == {int(found[-1])} and found[-2] == 0


def test_near_copies_link_at_the_threshold_and_not_below(spark):
    from redoubt.llm import near_copies

    some = random.Random(5)
    rows, alike = [], set()
    for i in range(300):
        n = some.randrange(24, 400)
        words = [f"w{some.randrange(10**6)}" for _ in range(n)]
        k = (n - 4) // 9 + i % 2  # the last k words differ: similarity (n - 4 - k) / (n - 4 + k), at or just under 0.8
        rows += [(i, " ".join(words), "a"), (1000 + i, " ".join(words[: n - k] + [f"x{i}x{j}" for j in range(k)]), "b")]
        if 5 * (n - 4 - k) >= 4 * (n - 4 + k):
            alike.add(1000 + i)
    body = [f"g{j}" for j in range(200)]
    rows += [(3000 + i, " ".join(body[:190] + [f"t{i}"] + body[191:]), "a") for i in range(60)]  # a group
    rows += [(None, "lost", "a"), (4000, None, "a"), (4001, "", "a"), (4002, rows[0][1].upper() + " ", "a")]
    found = near_copies.near_copies(docs(spark, rows), 5).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    linked = {i for i in range(1000, 1300) if got[i] == i - 1000}
    assert 140 < len(alike) < 160 and linked <= alike and len(linked) >= 0.98 * len(alike)
    assert all(got[i] == 3000 for i in range(3000, 3060)) and got[4001] == got[4000] == 4000 and got[4002] == 0
    kept = near_copies.dedup(docs(spark, rows), 5)
    assert kept.columns == docs(spark, rows).columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([i for i, c in got.items() if i == c] + [None], key=repr)
    assert near_copies.dedup(docs(spark, []), 5).count() == 0


def test_bitmaps_never_part_alike_sets():
    from redoubt.llm import near_copies

    some = np.random.default_rng(4)
    parted = total = 0
    for n in (0, 1, 3, 9, 60, 150, 400):
        for _ in range(400):
            a = np.unique(some.integers(0, 1 << 64, n, dtype=np.uint64))
            k = int(some.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate([a[k:], some.integers(0, 1 << 64, int(some.integers(0, k + 1)), dtype=np.uint64)]))
            marks = [[np.array([x], dtype=np.uint64) for x in near_copies.bitmap(s)] for s in (a, b)]
            fits = bool(near_copies.may_be_alike(*marks)[0])
            assert fits or not near_copies.alike(a, b)
            if len(a) == 150 and not near_copies.alike(a, b):
                total, parted = total + 1, parted + (not fits)
    assert total > 50 and parted > total / 2
    assert near_copies.bitmap(np.arange(70_000, dtype=np.uint64))[3] >> 48 == near_copies.MOST_SIZE


def test_candidates_of_cut_buckets(spark):
    from redoubt.llm import near_copies

    some = random.Random(6)
    rows = []
    for g in range(3):
        centre = [some.getrandbits(64) for _ in range(3)]
        for i in range(120):
            near = [f ^ sum({1 << some.randrange(64) for _ in range(3)}) for f in centre]
            rows.append((g * 1000 + i, [f - (1 << 64) if f >> 63 else f for f in near] + [0, 0, 0, -1]))  # too many shingles for a bitmap
    marks = spark.createDataFrame(rows, "node long, fps array<long>")
    none = spark.createDataFrame([], "node long, root long")
    want = {(g * 1000 + i, g * 1000 + j) for g in range(3) for i in range(120) for j in range(i + 1, 120)}
    for most in (4096, 16):
        assert {tuple(r) for r in near_copies.candidates(marks, none, 8, 21, most).collect()} == want
        forest = near_copies.candidates(marks, None, 8, 21, most)
        roots = common.connected_components(forest).collect()
        assert {(r.node, r.root) for r in roots} == {(i, i // 1000 * 1000) for i, _ in rows}
