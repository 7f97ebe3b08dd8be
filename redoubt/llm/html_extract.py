"""HTML extraction by nearest-URL page differencing.

A page becomes its text lines, one a block element.  Pages are sorted by host
and path, so a page's neighbours are those of the nearest URL path on its host.
The lines of neighbours are aligned by their longest common subsequence
(bit-parallel; long ones by divide and conquer), and shared lines are page
furniture: they are deleted.

Sharing alone is no proof either way, so an exact check of the markup follows.
Lines inside elements that are never main text (menus, footers, scripts,
adverts and so on, by element, role or class) go even if no neighbour shares
them, and lines inside an <article> or <main> stay even if one does, such as
the body of a mirrored article; inside those only elements that are furniture
by what they are go, and containers whose whole class or id names an advert,
comments or the like.  Every other line lives or dies by the difference.

Pages of a host with the same lines (rows that repeat, one body under many
URLs) are one page in the sort, at the least of their paths, so neighbours
always differ; the result holds for all of them.  A page that would lose every
line to the difference is a copy of its neighbour and loses none.

The sort ships hashes of lines only.  It is a range partition with the hash of
the lines as last key, so a host with a third of all pages spreads over tasks; a
task gets the last page before and the first after its range.

Definitions: a null or empty page has empty text.  Every row is returned, also
rows that repeat and rows without ``page_id`` or ``url`` (host and path empty).
Broken markup reads as browsers do: an unclosed comment, script or quotation
mark runs to the end of the page.  Reading takes time in proportion to a page's
length.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Elements by their part in a page.
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea svg head title dialog menu object canvas option input label fieldset datalist audio video map".split())
RAW = "script|style|noscript|textarea|title|iframe"  # whose content isn't markup
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img input wbr".split()) - {"wbr"}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status form".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail widget footer "
    "header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments respond reply replies disqus discussion pagination pager skip hidden tags toolbar paywall teaser outbrain taboola".split()
)

# Classes and ids that, as a whole, name furniture inside an article too, and the elements they count on.
INSIDE = frozenset("ad ads advert advertisement advertising sponsored promo comments comment-list disqus newsletter share-buttons sharing social related-articles recommended outbrain taboola hidden".split())
CONTAINERS = frozenset("div section ul ol aside table figure".split())

_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)")
_ATTRS = re.compile(r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]|=(?!\s*+["']))*+""")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW.split("|")}
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")

KEEP, LOOSE, DROP = 1, 0, -1


def _marked(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element's attributes say that it isn't main text."""
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            if inside and tag in CONTAINERS and value.strip() in INSIDE:
                return True
            for one in () if inside else value.split():
                parts = _NAME.findall(one)
                if parts and {parts[0], parts[-1]} & MARKS:  # the last or first part names the thing: post-comments, ad-slot
                    return True
    return False


def tokens(page: str):
    """Text as ``(text, None, None)`` and tags as ``(tag, attributes, whether it ends)``."""
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        begin = size if begin < 0 else begin
        m = _TAG.match(page, begin)
        if not m and page[begin + 1 : begin + 2] not in ("!", "?", "/") and begin < size:
            begin = page.find("<", begin + 1)  # a sign of its own
            yield page[at : size if begin < 0 else begin], None, None
            at = size if begin < 0 else begin
            continue
        if begin > at:
            yield page[at:begin], None, None
        if begin >= size:
            return
        if not m:
            mark = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(mark, begin + 2)
            at = size if end < 0 else end + len(mark)
            continue
        found = _ATTRS.match(page, m.end())
        if found.end() >= size or page[found.end()] != ">":
            return
        at, tag = found.end() + 1, m["tag"].lower()
        if tag in _CLOSE and not m["end"]:
            close = _CLOSE[tag].search(page, at)
            at = close.end() if close else size
            continue
        yield tag, found[0], bool(m["end"])


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The text lines of a page with KEEP (in an article), DROP (furniture by markup) or LOOSE."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements with the zone inside them
    parts: list[str] = []
    zone, open_tags = LOOSE, Counter()

    def flush():
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                out.append((line, zone))

    for tag, attrs, ends_tag in tokens(page or ""):
        if attrs is None:
            parts.append(tag)
            continue
        if tag in BLOCKS:
            flush()
        elif tag in SPACED:
            parts.append(" ")
        if ends_tag:
            if open_tags[tag]:
                was = stack[-1][1]
                while True:
                    name, _ = stack.pop()
                    open_tags[name] -= 1
                    if name == tag:
                        break
                now = stack[-1][1] if stack else LOOSE
                if now != was:
                    flush()
            zone = stack[-1][1] if stack else LOOSE
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":  # an open p ends where a block begins
            open_tags[stack.pop()[0]] -= 1
        if tag in ("li", "tr", "td", "th", "dd", "dt", "option"):  # as does the element before it of its kind
            ends = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}[tag]
            while stack and stack[-1][0] in ends:
                open_tags[stack.pop()[0]] -= 1
        outer = stack[-1][1] if stack else LOOSE
        inside = outer == KEEP
        if outer == DROP or tag in DROPPED or tag == "header" and not inside or tag not in ("html", "body", "article", "main") and _marked(tag, attrs, inside):
            inner = DROP
        elif tag in ("article", "main"):
            inner = KEEP
        else:
            inner = outer
        if inner != zone:
            flush()
        stack.append((tag, inner))
        open_tags[tag] += 1
        zone = inner
    flush()
    return out


DIRECT = 1 << 26  # bits of an alignment's rows that are held at once


def _rows(x: list[int], y: list[int], keep: bool) -> list[int]:
    """Bit j of row i is 0 where the LCS of x[:i] and y[:j+1] is one longer than that of y[:j]; the last row unless ``keep``."""
    where: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    for v in set(x) & places.keys():
        bits = bytearray(len(y) // 8 + 1)
        for j in places[v]:
            bits[j >> 3] |= 1 << (j & 7)
        where[v] = int.from_bytes(bits, "little")
    full = (1 << len(y)) - 1
    rows, row = [full], full
    for v in x:
        hit = where.get(v, 0)
        u = row & hit
        row = ((row + u) | (row - u)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """LCS lengths of ``x`` and y[:j] for j from 0."""
    row = _rows(x, y, False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(x: list[int], y: list[int], a: int, b: int, out: list[tuple[int, int]]) -> None:
    """Adds the places ``(a + i, b + j)`` of a longest common subsequence of x and y."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        out.append((a + head, b + head))
        head += 1
    x, y, a, b = x[head:], y[head:], a + head, b + head
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
        out.append((a + len(x), b + len(y)))
    if not x or not y:
        return
    if len(x) > 1 and len(x) * len(y) > DIRECT:
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        _align(x[:half], y[:cut], a, b, out)
        _align(x[half:], y[cut:], a + half, b + cut, out)
        return
    rows, i, j = _rows(x, y, True), len(x), len(y)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a + i, b + j))


def shared_lines(a: list[int], b: list[int]) -> tuple[set[int], set[int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence."""
    common_a, common_b = set(a), set(b)
    own, theirs = [i for i, v in enumerate(a) if v in common_b], [j for j, v in enumerate(b) if v in common_a]
    pairs: list[tuple[int, int]] = []
    _align([a[i] for i in own], [b[j] for j in theirs], 0, 0, pairs)
    return {own[i] for i, _ in pairs}, {theirs[j] for _, j in pairs}


# ---- over all pages

_LINES = "page_key long, host string, path string, lines array<long>, loose array<int>, kept int"


def _urls(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower().rpartition("@")[2], m[2]) if m else ("", re.split(r"[?#]", url or "")[0])


def _lines(batches):
    for batch in batches:
        hosts, paths, lines, loose, kept = [], [], [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = blocks(page)
            host, path = _urls(url)
            hosts.append(host)
            paths.append(path)
            lines.append([xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t, _ in found])
            loose.append([i for i, (_, z) in enumerate(found) if z == LOOSE])
            kept.append(sum(z == KEEP for _, z in found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(lines, pa.list_(pa.int64())), pa.array(loose, pa.list_(pa.int32())), pa.array(kept, pa.int32())],
            names=["page_key", "host", "path", "lines", "loose", "kept"],
        )


_ROW = ("same", "host", "lines", "loose", "kept")


def _pages(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in _ROW))


def _ends(batches):
    """The first and the last page of a partition."""
    from pyspark import TaskContext

    first = last = None
    for row in _pages(batches):
        first, last = first or row, row
    if first:
        rows = [(TaskContext.get().partitionId(), e, *r) for e, r in enumerate((first, last))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pid", "e", *_ROW])


def _difference(near: dict):
    """``(same, shared, gone)``: how many lines a neighbour shares, and the loose ones among them, for pages that share any."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        before, after = near.get((pid, "before")), near.get((pid, "after"))
        keys, counts, gone = [], [], []

        def emit(row, shared):
            if shared:
                keys.append(row[0])
                counts.append(len(shared))
                lost = sorted(shared & set(row[3]))
                gone.append(lost if row[4] or len(lost) < len(row[3]) else [])  # all its lines: a copy of the neighbour

        held, with_before = None, set()
        for row in (r for rows in (_pages(batches), [after] if after else []) for r in rows):
            previous = held if held is not None else before
            mine, theirs = shared_lines(row[2], previous[2]) if previous and previous[1] == row[1] else (set(), set())
            if held is not None:
                emit(held, with_before | theirs)
            held, with_before = row, mine
            if len(keys) >= 4096:
                yield _gone(keys, counts, gone)
                keys, counts, gone = [], [], []
        if held is not None and held is not after:
            emit(held, with_before)
        yield _gone(keys, counts, gone)

    return run


def _gone(keys, counts, gone):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int32()), pa.array(gone, pa.list_(pa.int32()))], names=["same", "shared", "gone"])


def furniture(pages: DataFrame) -> DataFrame:
    """``(page_key, shared, gone)``: the number of lines shared with the nearest pages, and places of those that differencing deletes; ``page_key`` is a hash of id, URL and html."""
    spark = pages.sparkSession
    keyed = pages.select(_key().alias("page_key"), "url", "html")
    # Read once: the range partition looks at its input twice.
    every = common.checkpoint(keyed.mapInArrow(_lines, _LINES).where("size(lines) > 0").withColumn("same", F.xxhash64("host", "lines", "loose")))
    order = ["host", "path", "same"]
    distinct = every.groupBy("same", "host").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("loose").alias("loose"), F.first("kept").alias("kept"))
    distinct = common.checkpoint(distinct.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order))
    ends = distinct.mapInArrow(_ends, "pid int, e int, same long, host string, lines array<long>, loose array<int>, kept int").collect()  # two pages a partition
    near, pids = {}, sorted({r.pid for r in ends})
    by = {(r.pid, r.e): (r.same, r.host, list(r.lines), list(r.loose), r.kept) for r in ends}
    for a, b in zip(pids, pids[1:]):
        near[b, "before"], near[a, "after"] = by[a, 1], by[b, 0]
    found = distinct.mapInArrow(_difference(near), "same long, shared int, gone array<int>")
    return every.select("page_key", "same").distinct().join(found, "same").select("page_key", "shared", "gone")


def _key():
    return F.xxhash64("page_id", "url", "html")


def _texts(batches):
    for batch in batches:
        texts = []
        for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            lost = set(gone or ())
            texts.append("\n".join(t for i, (t, z) in enumerate(blocks(page)) if z != DROP and i not in lost))
        shared = pa.array([n or 0 for n in batch.column(4).to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), shared], names=["page_id", "url", "text", "n_chars", "n_shared"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_shared)`` for every row of ``pages``;
    ``n_shared`` counts the lines that a nearest page shares, kept ones too."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    met = pages.withColumn("page_key", _key()).join(furniture(pages), "page_key", "left")
    return met.select("page_id", "url", "html", "gone", "shared").mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_shared int")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
