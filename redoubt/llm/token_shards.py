"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned by ``doc_id`` and sorted, so a partition's
payload is a run of the whole id stream.  Every task encodes its texts and
writes shards into the shared folder, three files each:

  ``<name>.ids``   the ids, raw little-endian, 2 bytes each where the vocabulary
                   fits and 4 otherwise; nothing else
  ``<name>.mph``   the index: header, seeds, one slot per distinct key, and the
                   number of ids of each record, 4 bytes each, in file order
  ``<name>.keys``  the records' keys, raw, 8 bytes each, in file order: to list
                   a shard; keyed access doesn't read it

The index is a two-level minimal perfect hash (hash and displace): a key's
bucket gives a seed, and the seed sends the keys of the bucket to slots of
their own; a bucket of one key names its slot.  A slot holds a 32-bit
fingerprint of its key, the offset of its first id, the number of its first
record and how many it has.  A lookup finds the shard in the manifest by
bisection over the keys' ranges and reads header, one seed, one slot and the
ids by their offsets, whatever the shard's size; a key that isn't there is told
apart by its fingerprint (a stranger passes with a probability of 2^-32).

A task's row in the manifest commits its files: names hold a fresh id per
attempt and only files named in the manifest are read, so a lost executor's
half-written files never count.  Texts are shuffled rather than ids: ids barely
compress, and the range partition reads its input twice, which must not encode.

Definitions: a null text is empty; every document ends with the end id, so an
empty one has one id.  Rows that repeat a ``doc_id`` are neighbours, ordered by
text; the index returns all of them.  Rows without ``doc_id`` come first, are
read by scanning and are not in the index.  An empty table has an empty
manifest and no rows.  Columns but ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import ctypes
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END_ID = 2
SHARD_IDS = 8 << 20  # a shard is closed at the first document that reaches this many ids
SHARD_DOCS = 1 << 18  # or this many documents
CACHED_PIECES = 1_000_000  # in each of the two generations of a worker's table, of some 40 bytes each
TRIM_SLICES = 16  # of 256 texts, after which a worker returns freed memory
_MAGIC = b"RDMPH2\x00\x00"
_HEAD = struct.Struct("<8sIIIIIIQ")  # magic, id bytes, buckets, slots, records, records without key, unused, ids
_SLOT = np.dtype([("print", "<u4"), ("records", "<u4"), ("first", "<u4"), ("unused", "<u4"), ("offset", "<u8")])
_MANIFEST = "part int, shard int, name string, width int, n_docs long, n_ids long, least long, greatest long"


# ---- encoding


# Classes of UTF-8 bytes.  Letters beyond ASCII are known for the two-byte forms of U+00C0 to U+024F; UNKNOWN is the rest.
LETTER, DIGIT, SIGN, SPACE, OTHER_SPACE, UNKNOWN = range(6)
_CLASS = np.full(256, UNKNOWN, dtype=np.uint8)
for _b in range(128):
    _CLASS[_b] = LETTER if chr(_b).isalpha() else DIGIT if chr(_b).isdigit() else SPACE if _b == 32 else OTHER_SPACE if 9 <= _b <= 13 else SIGN if 33 <= _b < 127 else UNKNOWN
_LEADS = np.zeros(256, dtype=bool)
_LEADS[0xC3:0xCA] = True


def byte_classes(b: np.ndarray) -> np.ndarray:
    classes = _CLASS[b]
    at = np.flatnonzero(_LEADS[b[:-1]])
    at = at[~((b[at] == 0xC3) & ((b[at + 1] == 0x97) | (b[at + 1] == 0xB7)))]  # the signs of multiplication and division
    classes[at] = classes[at + 1] = LETTER
    return classes


def piece_starts(b: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the splitter of a byte-level model always begins a new piece, and the classes of the bytes.

    The splitter takes contractions, an optional space and a run of letters, of
    digits or of signs, and white space but for the last one before a word.
    """
    c = byte_classes(b)
    known, space, word = c != UNKNOWN, (c == SPACE) | (c == OTHER_SPACE), c <= SIGN
    cut = np.zeros(len(b), dtype=bool)
    if len(b) > 1:
        was, now = c[:-1], c[1:]
        # White space after a word; another kind of sign, where an apostrophe may belong to the letters that follow.
        cut[1:] = word[:-1] & (space[1:] | word[1:] & (was != now) & ~((b[:-1] == 39) & (now == LETTER)))
        last = space[1:] & np.append(word[2:], False)  # the last white space before a word
        cut[1:] |= space[:-1] & last
        # A word after white space that can't be its own: two known bytes before it leave no doubt where that began.
        cut[1:] |= (was == OTHER_SPACE) & word[1:] & np.append(True, known[:-2])
    # Contexts end with the document.
    inner = doc_starts[(doc_starts > 0) & (doc_starts < len(b))]
    cut[inner] = True
    ends_in_space = inner[space[inner - 1]]
    before = ends_in_space[ends_in_space > 1]
    cut[before - 1] &= ~(space[before - 1] & space[before - 2]) | np.isin(before - 1, doc_starts)
    if len(b):
        cut[0] = True
    return np.flatnonzero(cut), c


class Pieces:
    """A bounded table from 64-bit hashes of pieces to their ids, in arrays alone."""

    def __init__(self, most: int, dtype):
        self.bits, self.named = (2 * most).bit_length(), 0
        self.keys, self.entry = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
        self.begin, self.n = np.zeros(1024, dtype=np.int64), 0  # entry i holds ids[begin[i]:begin[i + 1]]
        self.ids = np.zeros(1024, dtype=dtype)

    def put(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries with ``counts`` ids each."""
        at = int(self.begin[self.n])
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.begin) <= self.n + len(counts):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.ids[at : at + len(ids)] = ids
        self.begin[self.n + 1 : self.n + len(counts) + 1] = at + np.cumsum(counts)
        self.n += len(counts)
        return np.arange(self.n - len(counts), self.n)

    def add(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Name entries by distinct hashes that aren't in the table, which doubles when half full."""
        self.named += len(hashes)
        if 2 * self.named > len(self.keys):
            held = self.keys != 0
            hashes, entries = np.concatenate([self.keys[held], hashes]), np.concatenate([self.entry[held], entries])
            self.bits = (2 * self.named).bit_length()
            self.keys, self.entry = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            won = self.keys[slot] == hashes
            self.entry[slot[won]] = entries[won]
            hashes, entries, slot = hashes[~won], entries[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their entries, -1 for those that aren't there."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        live, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(live):
            key = self.keys[slot]
            hit = key == hashes[live]
            out[live[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            live, slot = live[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``entries`` one after another, and how many each has."""
        begin = self.begin[entries]
        counts = self.begin[entries + 1] - begin
        ends = np.cumsum(counts)
        return self.ids[np.repeat(begin - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)], counts


_SEGMENT, _LONG = 1 << 15, 255  # of bytes: hashed at once, within a core's cache; and hashed at all


class Hasher:
    """Hashes of many pieces of a byte string by one pass: sums of random numbers of the bytes times powers, from prefix sums."""

    def __init__(self, seed: int = 2026):
        some = np.random.default_rng(seed)
        self.letters = some.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = _SEGMENT + _LONG + 1
        self.powers = np.full(n, int(some.integers(1 << 62)) << 3 | 5, dtype=np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)

    def __call__(self, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of the pieces of up to ``_LONG`` bytes; others get 0."""
        out, top = np.zeros(len(starts), dtype=np.uint64), len(self.powers) - 1
        for seg in range(0, len(b), _SEGMENT):
            i, j = np.searchsorted(starts, [seg, seg + _SEGMENT])
            some = b[seg : seg + top]
            sums = np.zeros(len(some) + 1, dtype=np.uint64)
            np.cumsum(self.letters[some] * self.powers[: len(some)], out=sums[1:])
            short = np.flatnonzero(sizes[i:j] <= _LONG)
            at = starts[i:j][short] - seg
            found = (sums[at + sizes[i:j][short]] - sums[at]) * self.powers[top - at]
            found[found == 0] = 1
            out[i + short] = found
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The splitter of a byte-level BPE begins a new piece at places that the
    classes of neighbouring bytes tell, so a batch of texts is cut there by
    array operations, each piece is named by a 64-bit hash and each distinct
    one is encoded once while it stays in a bounded table (unlike pieces are
    taken as equal with a chance below 1e-13 a new piece).  The table has two
    generations: pieces that are met again move to the young one, and the old
    one goes when the young one is full.

    A piece of one kind of sign is one word to the splitter, so many go to the
    library at once, spelled in the model's byte alphabet, by a copy of the
    tokenizer that splits at line feeds, of which that alphabet has none; a
    token's length in bytes tells where the next piece begins.  Pieces with
    other bytes are encoded as they are, and so are whole texts that hold a
    special token and those of tokenizers of another make.
    """

    def __init__(self, path: str, end_id: int = END_ID, most: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path) as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        pre = made.get("pre_tokenizer") or {}
        self.by_piece = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and made["model"]["type"] == "BPE"
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        if self.by_piece:
            self.words = Tokenizer.from_str(json.dumps(made | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}))
            self.token_bytes = np.zeros(max(made["model"]["vocab"].values()) + 1, dtype=np.int32)
            for token, i in made["model"]["vocab"].items():
                self.token_bytes[i] = len(token)  # a letter of the alphabet is a byte
            self.most, self.hasher = most, Hasher()
            self.young = self.old = Pieces(most, self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``pieces`` one after another, and how many each has; ``plain`` ones are single words to the splitter."""
        ids, counts = [], []
        words = [p for p, one in zip(pieces, plain.tolist()) if one]
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            spelled = "\n".join([p.decode("latin-1").translate(_BYTE_LETTERS) for p in some])
            found = np.array(self.words.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.searchsorted(np.cumsum(self.token_bytes[found]), np.cumsum([len(p) for p in some])) + 1
            ids.append(found)
            counts.append(np.diff(ends, prepend=0))
        rest = self._whole([p.decode() for p, one in zip(pieces, plain.tolist()) if not one])
        ids, counts = np.concatenate([*ids, *rest, self.young.ids[:0]]), np.concatenate([*counts, [len(x) for x in rest]]).astype(np.int64)
        # From words first to the order of the pieces.
        back = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")
        begin = (np.cumsum(counts) - counts)[back]
        counts = counts[back]
        ends = np.cumsum(counts)
        return ids[np.repeat(begin - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)], counts

    def _entries(self, raw: bytes, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The young table's entries of all pieces."""
        sizes = np.diff(starts, append=len(raw))
        hashes = self.hasher(np.frombuffer(raw, dtype=np.uint8), starts, sizes)
        out = self.young.find(hashes)
        short = sizes <= _LONG
        lost = np.flatnonzero((out < 0) & short)
        new, first = np.unique(hashes[lost], return_index=True)
        kept = self.old.find(new)
        again = kept >= 0
        if again.any():
            self.young.add(new[again], self.young.put(*self.old.take(kept[again])))
        where = np.concatenate([lost[first[~again]], np.flatnonzero(~short)])
        if len(where):
            a, z = starts[where], starts[where] + sizes[where]
            # One kind of byte after the first: a word, a space and a word, or white space.
            change = np.concatenate([[0], np.cumsum((classes[1:] != classes[:-1]) | (classes[1:] == UNKNOWN))])
            after = a + (classes[a] == SPACE) * (z - a > 1)
            space = (classes[a] == SPACE) | (classes[a] == OTHER_SPACE)
            blank = np.concatenate([[0], np.cumsum((classes != SPACE) & (classes != OTHER_SPACE))])
            plain = (change[z - 1] == change[after]) & (classes[after] <= SIGN) | space & (blank[z] == blank[a])
            entries = self.young.put(*self._learn([raw[x:y] for x, y in zip(a.tolist(), z.tolist())], plain))
            n = len(where) - int((~short).sum())
            self.young.add(new[~again], entries[:n])
            out[where[n:]] = entries[n:]
        out[lost] = self.young.find(hashes[lost])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as raw bytes."""
        whole = [not self.by_piece or any(s in t for s in self.special) for t in texts]
        slow = iter(self._whole([t for t, w in zip(texts, whole) if w]))
        raws = [b"" if w else t.encode() for t, w in zip(texts, whole)]
        if not self.by_piece:
            return [next(slow).tobytes() + self.end for _ in texts]
        if self.young.n > self.most:
            self.young, self.old = Pieces(self.most, self.dtype), self.young
        raw = b"".join(raws)
        doc_ends = np.cumsum([len(r) for r in raws])
        starts, classes = piece_starts(np.frombuffer(raw, dtype=np.uint8), doc_ends)
        ids, counts = self.young.take(self._entries(raw, starts, classes))
        at = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, doc_ends)] * self.dtype.itemsize
        stream, begin, out = ids.tobytes(), 0, []
        for end, w in zip(at.tolist(), whole):
            out.append((next(slow).tobytes() if w else stream[begin:end]) + self.end)
            begin = end
        return out


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level models: printable bytes as themselves, others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """This process's encoder, so that tasks that share a worker share its cache."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


# ---- index


def mixed(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A hash of 64-bit keys under a seed: the finisher of a counter generator."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + (np.asarray(seed, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def build_index(keys, lengths, id_bytes: int) -> bytes:
    """The ``.mph`` file of records in file order: those without key (None) first, equal keys together."""
    lengths = np.asarray(lengths, dtype=np.int64)
    loose = sum(k is None for k in keys)
    named = np.array(keys[loose:], dtype=np.int64)
    distinct, first, records = np.unique(named, return_index=True, return_counts=True)
    n, starts = len(distinct), np.cumsum(lengths) - lengths
    n_buckets = max(1, -(-n // 4))
    seeds, slots = np.zeros(n_buckets, dtype="<i4"), np.zeros(n, dtype=_SLOT)
    hashed = mixed(distinct, 0)
    of_bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(of_bucket, kind="stable")
    sizes = np.bincount(of_bucket, minlength=n_buckets)
    begins = np.cumsum(sizes) - sizes
    place, free = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        mine = by[begins[b] : begins[b] + sizes[b]]
        if len(mine) < 2:
            break
        tried, many = 1, 8
        while True:  # seeds by the block, larger ones as free slots get rare
            at = (mixed(distinct[mine], np.arange(tried, tried + many)[:, None]) % np.uint64(n)).astype(np.int64)
            fits = np.flatnonzero(free[at].all(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1))
            if len(fits):
                break
            tried, many = tried + many, min(4096, many * 4)
        seed, at = tried + int(fits[0]), at[fits[0]]
        seeds[b], place[mine] = seed, at
        free[at] = False
    alone = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    seeds[alone], place[by[begins[alone]]] = -1 - left, left
    rows = np.zeros(n, dtype=_SLOT)
    rows["print"], rows["records"], rows["first"], rows["offset"] = hashed >> np.uint64(32), records, loose + first, starts[loose + first]
    slots[place] = rows
    return _HEAD.pack(_MAGIC, id_bytes, n_buckets, n, len(lengths), loose, 0, int(lengths.sum())) + seeds.tobytes() + slots.tobytes() + lengths.astype("<u4").tobytes()


class Index:
    """Keyed access to a shard; ``read(at, size)`` gives the bytes of its index file."""

    def __init__(self, read):
        self.read = read
        magic, self.id_bytes, self.n_buckets, self.n, self.n_records, self.n_loose, _, self.n_ids = _HEAD.unpack(read(0, _HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not an index file")
        self._slots = _HEAD.size + 4 * self.n_buckets
        self._lengths = self._slots + _SLOT.itemsize * self.n

    def lengths(self, first: int, records: int) -> np.ndarray:
        return np.frombuffer(self.read(self._lengths + 4 * first, 4 * records), dtype="<u4").astype(np.int64)

    def find(self, key: int) -> tuple[int, list[int]] | None:
        """``(offset, lengths of its records)`` in ids, or None: one seed and one slot are read."""
        if not self.n:
            return None
        own = np.array([key], dtype=np.int64)
        first = int(mixed(own, 0)[0])
        seed = int(np.frombuffer(self.read(_HEAD.size + 4 * (first % self.n_buckets), 4), dtype="<i4")[0])
        at = -1 - seed if seed < 0 else int(mixed(own, seed)[0]) % self.n
        slot = np.frombuffer(self.read(self._slots + _SLOT.itemsize * at, _SLOT.itemsize), dtype=_SLOT)[0]
        if int(slot["print"]) != first >> 32:
            return None
        return int(slot["offset"]), self.lengths(int(slot["first"]), int(slot["records"])).tolist()

    def find_all(self, keys: np.ndarray) -> np.ndarray:
        """The slots of many keys; raises if one isn't there."""
        hashed = mixed(keys, 0)
        seeds = np.frombuffer(self.read(_HEAD.size, 4 * self.n_buckets), dtype="<i4")[(hashed % np.uint64(self.n_buckets)).astype(np.int64)].astype(np.int64)
        at = np.where(seeds < 0, -1 - seeds, (mixed(keys, np.maximum(seeds, 0)) % np.uint64(max(1, self.n))).astype(np.int64))
        slots = np.frombuffer(self.read(self._slots, _SLOT.itemsize * self.n), dtype=_SLOT)[at]
        if (slots["print"] != hashed >> np.uint64(32)).any():
            raise ValueError("a key isn't in the index")
        return slots


# ---- files


def _fs(folder: str):
    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])


def _put(folder: str, name: str, raw: bytes) -> None:
    fs, base = _fs(folder)
    with fs.open_output_stream(f"{base}/{name}") as f:
        f.write(raw)


def _reads(folder: str, name: str):
    """``read(at, size)`` of a file; a size of None reads to its end."""
    fs, base = _fs(folder)
    path = f"{base}/{name}"

    def read(at: int, size: int | None) -> bytes:
        with fs.open_input_file(path) as f:
            return f.read_at(f.size() - at if size is None else size, at)

    return read


def read_ids(folder: str, name: str, width: int, offset: int = 0, length: int | None = None) -> np.ndarray:
    return np.frombuffer(_reads(folder, name + ".ids")(offset * width, None if length is None else length * width), dtype=f"<u{width}")


def read_index(folder: str, name: str, whole: bool = False) -> Index:
    read = _reads(folder, name + ".mph")
    if not whole:
        return Index(read)
    raw = read(0, None)
    return Index(lambda at, size: raw[at : at + size])


def give_back() -> None:
    """Return the freed memory of this process to the system; the allocators keep that of short-lived arrays and Arrow batches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def _writer(path: str, folder: str, end_id: int, shard_ids: int, shard_docs: int):
    def run(batches):
        from pyspark import TaskContext

        coder = encoder(path, end_id)
        width = coder.dtype.itemsize
        keys, lengths, chunks, size, shard, slices = [], [], [], 0, 0, 0

        def close():
            part = TaskContext.get().partitionId()
            name = f"{part:06d}-{shard:05d}-{uuid.uuid4().hex}"
            named = [k for k in keys if k is not None]
            _put(folder, name + ".ids", b"".join(chunks))
            _put(folder, name + ".keys", np.array(named, dtype="<i8").tobytes())
            _put(folder, name + ".mph", build_index(keys, lengths, width))
            row = (part, shard, name, width, len(keys), size, named[0] if named else None, named[-1] if named else None)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _MANIFEST.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                slices += 1
                if slices % TRIM_SLICES == 0:
                    give_back()
                for key, raw in zip(some.column(0).to_pylist(), coder.encode([t or "" for t in some.column(1).to_pylist()])):
                    keys.append(key)
                    lengths.append(len(raw) // width)
                    chunks.append(raw)
                    size += lengths[-1]
                    if size >= shard_ids or len(keys) >= shard_docs:
                        yield close()
                        keys, lengths, chunks, size, shard = [], [], [], 0, shard + 1
        if keys:
            yield close()
        keys, lengths, chunks = [], [], []
        give_back()

    return run


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Write ``docs(doc_id, text)`` below ``folder``, which must be seen by all
    executors; returns the manifest, in which (part, shard) is the order of
    ascending ``doc_id`` and ``least`` and ``greatest`` are a shard's keys."""
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    n = common.partitions(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id"), F.xxhash64("text"))
    return common.checkpoint(dealt.sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), "text").mapInArrow(_writer(path, folder, end_id, shard_ids, shard_docs), _MANIFEST))


def _reader(folder: str):
    def run(batches):
        for batch in batches:
            for name, width, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                index = read_index(folder, name, whole=True)
                keys = np.frombuffer(_reads(folder, name + ".keys")(0, None), dtype="<i8")
                slots = index.find_all(keys)
                lengths = index.lengths(0, index.n_records)
                starts = np.cumsum(lengths) - lengths
                # Every keyed record lies where its key's slot says, as far behind the first one as those between are long.
                numbers = index.n_loose + np.arange(len(keys))
                starts[index.n_loose :] = slots["offset"].astype(np.int64) + starts[numbers] - starts[slots["first"]]
                ids = read_ids(folder, name, width)
                if len(ids) != index.n_ids or (numbers >= slots["first"] + slots["records"]).any() or (numbers < slots["first"]).any():
                    raise ValueError(f"{name}: files and index disagree")
                crcs = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())]
                doc_ids = pa.array([None] * index.n_loose + keys.tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + base), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    at, rows = 0, []
    for r in sorted(manifest.select("part", "shard", "name", "width", "n_ids").collect()):  # one row a shard
        rows.append((r.name, r.width, at))
        at += r.n_ids
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    shards = spark.createDataFrame(rows, "name string, width int, base long").repartition(min(len(rows), max(common.partitions(spark), len(rows) // 64)), "name")
    return shards.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


class Lookup:
    """Keyed access to all shards of a collected manifest."""

    def __init__(self, manifest_rows, folder: str):
        self.folder = folder
        self.shards = sorted((r for r in manifest_rows if r.least is not None), key=lambda r: (r.part, r.shard))
        self.greatest = [r.greatest for r in self.shards]

    def find(self, key: int) -> list[np.ndarray]:
        """The ids of each document ``key``: a bisection, then one probe and one read in its shard (more only where
        rows that repeat a key run over shards)."""
        out = []
        for r in self.shards[bisect_left(self.greatest, key) :]:
            if r.least > key:
                break
            found = read_index(self.folder, r.name).find(key)
            if found:
                ids, at = read_ids(self.folder, r.name, r.width, found[0], sum(found[1])), 0
                for n in found[1]:
                    out.append(ids[at : at + n])
                    at += n
        return out


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_table(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back."""
    folder = f"{common.shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    return read_shards(spark, write_shards(docs, path or tokenizer_path(), folder), folder)


def op8_token_shards(spark, sf_dir: str) -> DataFrame:
    return encode_table(spark, common.table(spark, sf_dir, "documents").select("doc_id", "text"))
