"""Secret scans: base patterns and a battery of randomness tests.

Base spans come from three patterns.  The method adds spans of kind ``random``:
runs of at least ``LEAST`` characters of [A-Za-z0-9+/_-], with up to two ``=``
behind them, that behave like the output of a random generator under the
encoding inferred for them (hex, base32, base36, base62 or base64):

  chi-squared  symbols are uniform over the encoding's alphabet, binned so that
               a bin expects some symbols even in a short run
  runs         upper and lower halves of the alphabet alternate as chance has it
  serial       neighbouring symbols are uncorrelated

Fisher's method combines the three into one chance F that a random run looks no
more random; below ``ALPHA`` the run isn't one.  A fitting run isn't rare enough
on its own among all runs of a corpus, so false discoveries are controlled: the
chance that ordinary text yields a run that speaks as strongly for the uniform
model is bounded by the inverse likelihood ratio of that model against a bigram
model counted over all texts, and p is that bound divided by F, so that a run
counts for less the worse the battery speaks of it.  Benjamini-Hochberg at
``RATE`` over the whole corpus, with weights that favour long runs, where the
tests have power, and average 1, says which p count.

Texts are read once; what the second pass needs are the candidates and the
bigram counts.  The driver sees the counts' sums (a table of fixed size) and a
histogram of p.

Definitions: null texts are empty.  Positions are code points, ends exclusive.
A random span that overlaps a base span isn't added.  Rows that repeat a
``doc_id`` are scanned each by itself.  An empty table gives no rows; columns
but ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 20
ALPHA = 0.001  # of the combined battery
RATE = 0.01  # false discoveries among the spans added
KINDS = ("assign", "access", "hex", "random")
BINS = 400  # of -log10 p, a tenth each

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)

# Alphabets of the encodings, in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def infer_encoding(run: str) -> tuple[str, str] | None:
    """The narrowest encoding with digits that holds the run, and the run in its alphabet; None for plain words and numbers."""
    bare = run.rstrip("=")
    if not any(c.isdigit() for c in bare) or not any(c.isalpha() for c in bare):
        return None
    folded = bare.lower() if bare.upper() == bare or bare.lower() == bare else bare
    for name, form in (("hex", folded), ("base32", bare), ("base36", folded), ("base62", bare), ("base64", bare.replace("-", "+").replace("_", "/"))):
        if set(form) <= set(ALPHABETS[name]):
            return name, form
    return None


def _upper_chi2(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees, by Wilson and Hilferty."""
    z = ((max(x, 0.0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(form: str, alphabet: str) -> tuple[float, float, float]:
    """p-values under randomness: uniformity, runs, serial correlation."""
    n, k = len(form), len(alphabet)
    values = [alphabet.index(c) for c in form]
    bins = max(2, min(k, n // 5))
    counts = Counter(v * bins // k for v in values)
    share = [0] * bins
    for v in range(k):
        share[v * bins // k] += 1
    chi = sum((counts.get(i, 0) - n * s / k) ** 2 / (n * s / k) for i, s in enumerate(share))
    high = [2 * v >= k for v in values]
    a = sum(high)
    b = n - a
    if not a or not b:
        return _upper_chi2(chi, bins - 1), 0.0, 0.0
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 1 + 2 * a * b / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs_p = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    centre = sum(values) / n
    power = sum((v - centre) ** 2 for v in values)
    serial = sum((x - centre) * (y - centre) for x, y in zip(values, values[1:])) / power if power else 1.0
    return _upper_chi2(chi, bins - 1), runs_p, _two_sided((serial + 1 / n) * math.sqrt(n))


def fisher(chances: tuple[float, ...]) -> float:
    """Fisher's combined chance of independent tests."""
    x = -sum(math.log(max(p, 1e-300)) for p in chances)
    term = total = 1.0
    for i in range(1, len(chances)):
        term *= x / i
        total += term
    return min(1.0, math.exp(-x) * total)


# ---- the model of ordinary text: bigrams of 30 classes

_CLASSES = 30  # a-z, any capital, any digit, other signs of a run, all else
_CLASS = np.full(256, 29, dtype=np.uint8)
for _c in range(256):
    if 97 <= _c <= 122:
        _CLASS[_c] = _c - 97
    elif 65 <= _c <= 90:
        _CLASS[_c] = 26
    elif 48 <= _c <= 57:
        _CLASS[_c] = 27
    elif chr(_c) in "+/_=-":
        _CLASS[_c] = 28
_WITHIN = {26: 26, 27: 10, 28: 5}  # signs that share a class are alike to the model


def bigrams(text: bytes) -> np.ndarray:
    classes = _CLASS[np.frombuffer(text, dtype=np.uint8)].astype(np.int32)
    return np.bincount(classes[:-1] * _CLASSES + classes[1:], minlength=_CLASSES**2)


def text_bits(counts: np.ndarray) -> np.ndarray:
    """Log chance of each class after each class, smoothed."""
    table = counts.reshape(_CLASSES, _CLASSES) + 0.5
    return np.log(table / table.sum(axis=1, keepdims=True))


def log_p(run: str, encoding: str, fit: float, table: np.ndarray) -> float:
    """Log of p: the log likelihood of ordinary text less that of uniform symbols and less log ``fit``, at most 0."""
    classes = _CLASS[np.frombuffer(run.encode(), dtype=np.uint8)].astype(int)
    plain = table[np.concatenate([[29], classes[:-1]]), classes].sum() - sum(math.log(_WITHIN.get(c, 1)) for c in classes.tolist())
    return min(0.0, float(plain) + len(run) * math.log(len(ALPHABETS[encoding])) - math.log(fit))


def length_weight(length: int) -> float:
    """More for long runs, in steps; scaled to average 1 over the candidates."""
    return min(4.0, length / 32)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,run:string,encoding:string,fit:double>>, tally array<long>"


def _scan(batches):
    """A row per document, and one per batch of texts that carries its bigram counts."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tally = np.zeros(_CLASSES**2, dtype=np.int64)
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), texts):
            raw = text.encode()
            for at in range(0, len(raw), 1 << 20):
                tally += bigrams(raw[at : at + (1 << 20) + 1])
            base = base_spans(text)
            kinds = Counter(k for _, k, _ in base)
            runs = []
            for m in RUN.finditer(text):
                if any(s < m.end() and m.start() < e for s, _, e in base):
                    continue
                found = infer_encoding(m[0])
                fit = fisher(battery(found[1], ALPHABETS[found[0]])) if found else 0.0
                if fit >= ALPHA:
                    runs.append({"start": m.start(), "end": m.end(), "run": m[0], "encoding": found[0], "fit": fit})
            rows.append((doc, kinds[0], kinds[1], kinds[2], [{"start": s, "kind": k, "end": e} for s, k, e in base], runs, None))
        rows.append((None, None, None, None, None, None, tally.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "runs", "tally"])


_ARROW = [
    pa.int64(),
    pa.int64(),
    pa.int64(),
    pa.int64(),
    pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("run", pa.string()), ("encoding", pa.string()), ("fit", pa.float64())])),
    pa.list_(pa.int64()),
]


def step(run: str, encoding: str, fit: float, table: np.ndarray) -> int:
    """The bin of a run's p."""
    return int(min(BINS - 1, -10 * log_p(run, encoding, fit, table) / math.log(10)))


def _bins(table: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = [(step(r, e, f, table), len(r)) for r, e, f in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([min(n, 256) for _, n in rows], pa.int32())], names=["bin", "length"])

    return run


def threshold(histogram: list[tuple[int, int, int]], rate: float = RATE) -> tuple[float, float]:
    """Weighted Benjamini-Hochberg over ``(bin of -10 log10 p, length, count)``: the
    largest t with weighted p <= t counting, as its log, and the mean weight."""
    total = sum(c for _, _, c in histogram)
    if not total:
        return -math.inf, 1.0
    mean = sum(length_weight(n) * c for _, n, c in histogram) / total
    # p of a bin is taken at its upper edge, so the rate is kept.
    scored = sorted((-b / 10 * math.log(10) - math.log(length_weight(n) / mean), c) for b, n, c in histogram)
    seen, best = 0, -math.inf
    for q, c in scored:
        seen += c
        if q <= math.log(rate * seen / total):
            best = q
    return best, mean


def _report(table: np.ndarray, cut: float, mean: float):
    def run(batches):
        for batch in batches:
            out = []
            for doc, a, b, c, base, runs in zip(*(batch.column(i).to_pylist() for i in range(6))):
                spans = [(s["start"], s["kind"], s["end"]) for s in base]
                text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                for r in runs:
                    at = step(r["run"], r["encoding"], r["fit"], table)
                    if -at / 10 * math.log(10) - math.log(length_weight(min(len(r["run"]), 256)) / mean) <= cut:
                        spans.append((r["start"], 3, r["end"]))
                out.append((doc, a, b, c, hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), *(pa.array(x, pa.string()) for x in columns[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row."""
    found = common.checkpoint(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _FOUND))
    sums = found.where("tally is not null").select(F.posexplode("tally").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_CLASSES**2)
    for r in sums:
        counts[r.cell] = r.n
    table = text_bits(counts)
    rows = found.where("tally is null")
    runs = rows.select(F.explode("runs").alias("r")).select("r.run", "r.encoding", "r.fit").mapInArrow(_bins(table), "bin int, length int")
    cut, mean = threshold([tuple(r) for r in runs.groupBy("bin", "length").count().collect()], rate)
    return rows.drop("tally").mapInArrow(_report(table, cut, mean), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
