"""Validators, normalisers, hashes and span functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import IBAN_LENGTHS, ISSUERS, PLACEHOLDER, SEPARATORS, VOID_NINO, VOID_SSN

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, SEPARATORS, "")


def _digit_sum(digits: Column, weights) -> Column:
    return reduce(lambda a, b: a + b, (F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)))


def luhn(c: Column) -> Column:
    d = strip_separators(c)
    return d.rlike("^[0-9]{2,}$") & F.call_function("luhn_check", d)


def card_brand(digits: Column) -> Column:
    out = F.lit(None).cast("string")
    for brand, pattern in reversed(ISSUERS):
        out = F.when(digits.rlike(pattern), brand).otherwise(out)
    return out


def iban(c: Column) -> Column:
    v = F.upper(strip_separators(c))
    length = F.try_element_at(F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv]), F.substring(v, 1, 2))
    moved = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))
    value = lambda ch: F.conv(ch, 36, 10).cast("int")
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), lambda a, ch: (F.when(value(ch) > 9, a * 100).otherwise(a * 10) + value(ch)) % 97)
    return v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & F.coalesce(length == F.length(v), F.lit(True)) & (rest == 1)


def us_ssn(c: Column) -> Column:
    d = strip_separators(c)
    return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$") & ~d.isin(*VOID_SSN)


def aba_routing(c: Column) -> Column:
    d = strip_separators(c)
    return d.rlike("^[0-9]{9}$") & (_digit_sum(d, (3, 7, 1) * 3) % 10 == 0)


def nhs_number(c: Column) -> Column:
    d = strip_separators(c)
    check = (F.lit(11) - _digit_sum(d, range(10, 1, -1)) % 11) % 11
    return d.rlike("^[0-9]{10}$") & (check == F.substring(d, 10, 1).cast("int"))


def weighted_mod11(c: Column, weights) -> Column:
    return c.rlike("^[0-9]{%d}$" % len(weights)) & (_digit_sum(c, weights) % 11 == 0)


def uk_nino(c: Column) -> Column:
    v = F.upper(strip_separators(c))
    return v.rlike("^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$") & ~F.substring(v, 1, 2).isin(*VOID_NINO)


def mrz_check_digit(field: Column, digit: Column) -> Column:
    value = lambda ch: F.when(ch == "<", 0).otherwise(F.conv(ch, 36, 10).cast("int"))
    weight = lambda i: F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int"))
    products = F.transform(F.filter(F.split(field, ""), lambda x: x != ""), lambda ch, i: value(ch) * weight(i))
    return field.rlike("^[A-Z0-9<]+$") & (F.aggregate(products, F.lit(0), lambda a, x: a + x) % 10 == digit.cast("int"))


def ipv4(c: Column) -> Column:
    return c.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")


def reserved_ipv4(c: Column) -> Column:
    return c.rlike(r"^(?:0|127|255)\.|^192\.0\.|^198\.(?:51|18|19)\.|^203\.0\.")


def lat_lon(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def is_placeholder(c: Column) -> Column:
    v = strip_separators(c)
    return v.rlike("(?i)" + PLACEHOLDER) | v.rlike(r"(?i)^(.)\1{3,}$")


def entropy(c: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


# ---- hashes


def base32(hex_digest: Column, length: int) -> Column:
    """The first ``length`` characters (a multiple of 4) of the base32 form of a hex digest."""
    out = []
    for k in range(-(-length // 4)):
        bits = F.lpad(F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 2), 20, "0")
        out += [F.substring(F.lit(BASE32), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(4)]
    return F.concat(*out[:length])


def content_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """``prefix`` and the lower-case base32 of the SHA-256 of the parts joined by spaces."""
    joined = F.concat_ws(" ", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.lower(base32(F.sha2(joined, 256), length)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC.  The key stands in the plan as two literals; for a secret one use ``redact.pseudonyms``, which keeps it in a closure."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


# ---- spans


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start,end,value>>`` of all matches of a Java expression.

    Each match is set between marks, the text is cut at the marks, and a fold
    over the pieces adds up their lengths; it copies the matches so far at each
    one, which is meant for texts of some thousand.  The marks are noncharacters
    of Unicode, which interchanged text doesn't hold; where one does, a space
    stands in its place, which keeps all offsets.
    """
    a, b, c = "\ufdd0", "\ufdd1", "\ufdd2"
    clean = F.translate(text, a + b + c, "   ")
    marked = F.regexp_replace(clean, pattern, f"{a}$0{c}${group}{b}")
    pieces = F.split(marked, f"[{a}{b}]", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, piece):
        parts = F.split(piece, c, -1)
        is_match = F.size(parts) == 2
        whole, value = parts[0], F.when(is_match, parts[1])
        start = (acc["at"] + F.when(F.lit(group == 0), 0).otherwise(F.instr(whole, value) - 1)).cast("int")
        found = F.array(F.struct(start.alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("value")))
        return F.struct(
            (acc["at"] + F.length(whole)).cast("int").alias("at"),
            F.when(is_match & (F.length(value) > 0), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def text_at(text: Column, start: Column, end: Column) -> Column:
    """The characters of a span."""
    return F.substring(text, start + 1, end - start)


def rect_for(glyphs: Column, bbox: Column, start: Column, end: Column) -> Column:
    """The box of a span: the union of its glyphs' boxes, one a character, or the node's box where it has none."""
    own = F.slice(glyphs, start + 1, F.greatest(end - start, F.lit(0)))
    # Folded as edges, since a union of boxes is least and greatest of each edge.
    first = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in (("x0", float("inf")), ("y0", float("inf")), ("x1", float("-inf")), ("y1", float("-inf")))])
    edges = F.aggregate(own, first, lambda e, g: F.struct(F.least(e["x0"], g["x"]).alias("x0"), F.least(e["y0"], g["y"]).alias("y0"), F.greatest(e["x1"], rect_right(g)).alias("x1"), F.greatest(e["y1"], rect_bottom(g)).alias("y1")))
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, rect(edges["x0"], edges["y0"], edges["x1"] - edges["x0"], edges["y1"] - edges["y0"])).otherwise(bbox)


def utf16_offset(text: Column, offset: Column) -> Column:
    """An offset in code points as one in UTF-16 units, for systems that count those."""
    return offset + F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("[\\x{10000}-\\x{10FFFF}]"))


def window_around(text: Column, start: Column, end: Column, size: int = 48) -> Column:
    before = F.substring(text, F.greatest(start - size, F.lit(0)) + 1, F.least(start, F.lit(size)))
    return F.regexp_replace(F.lower(F.concat(before, F.lit(" "), F.substring(text, end + 1, F.lit(size)))), "[_-]+", " ")


def has_term(term: str, hay: Column) -> Column:
    """As ``scan.has_term``: only the first occurrence of a single word is tested for its edges."""
    if not (term.isascii() and term.isalnum()):
        return F.contains(hay, F.lit(term))
    at = F.instr(hay, term)
    free = lambda c: ~c.rlike("[a-z0-9]")
    return (at > 0) & free(F.when(at > 1, F.substring(hay, at - 1, F.lit(1))).otherwise("")) & free(F.substring(hay, at + len(term), F.lit(1)))


def context_delta(hay: Column, supports=(), suppresses=(), weight: float = 0.12, loss: float = 0.35, cap: float = 0.30) -> Column:
    count = lambda terms: reduce(lambda a, b: a + b, (has_term(t, hay).cast("int") for t in terms), F.lit(0))
    return F.least(F.lit(cap), count(supports) * weight) - count(suppresses) * loss


# ---- folds of values


DASHES, BLANKS, MARKS = "[\\u2010-\\u2015\\u2212]", "\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000", "\\u200b-\\u200f\\u202a-\\u202e\\ufeff"


def _folded(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(v, "[-_]", " "), r"\s+", " "))


def retain_key(c: Column) -> Column:
    """The form in which kept copies are counted; a zero-width space counts as a space."""
    return _folded(F.regexp_replace(F.regexp_replace(F.lower(c), DASHES, "-"), f"[{BLANKS}\\u200b]", " "))


def search_key(c: Column) -> Column:
    """The form in which removed values are searched: zero-width and direction marks vanish."""
    v = F.regexp_replace(F.regexp_replace(F.lower(c), DASHES, "-"), f"[{MARKS}]", "")
    return _folded(F.regexp_replace(v, f"[{BLANKS}]", " "))


def occurrences(hay: Column, needle: Column, whole_word: Column) -> Column:
    plain = F.when(F.length(needle) > 0, ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)
    quoted = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), needle, F.lit("\\E(?![A-Za-z0-9])"))
    return F.when(whole_word, F.regexp_count(hay, quoted)).otherwise(plain)


def preview(c: Column) -> Column:
    t = F.trim(c)
    stars = F.least(F.lit(8), F.greatest(F.lit(1), F.length(t) - 2))
    return F.when(F.length(t) == 0, "").when(F.length(t) == 1, "*").otherwise(F.concat(F.substring(t, 1, 1), F.repeat(F.lit("*"), stars), F.substring(t, -1, 1)))


def mask_value(c: Column, keep: int = 4, side: str = "end") -> Column:
    """Letters and digits become * but for ``keep`` of them at one side; separators stay."""
    hidden = lambda v: F.regexp_replace(v, r"[A-Za-z0-9](?=(?:[^A-Za-z0-9]*[A-Za-z0-9]){%d})" % keep, "*")
    return hidden(c) if side == "end" else F.reverse(hidden(F.reverse(c)))


# ---- intervals and rectangles


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def contains_span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b0) & (a1 >= b1)


def intersection_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def rect(x, y, width, height) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def rect_intersects(a: Column, b: Column) -> Column:
    return overlaps(a["x"], a["x"] + a["width"], b["x"], b["x"] + b["width"]) & overlaps(a["y"], a["y"] + a["height"], b["y"], b["y"] + b["height"])


def rect_intersection(a: Column, b: Column) -> Column:
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w, h = F.least(a["x"] + a["width"], b["x"] + b["width"]) - x, F.least(a["y"] + a["height"], b["y"] + b["height"]) - y
    return F.when((w > 0) & (h > 0), rect(x, y, w, h))


def rect_union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - x, F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - y)


def rect_inflate(a: Column, by: float) -> Column:
    return rect(a["x"] - by, a["y"] - by, a["width"] + 2 * by, a["height"] + 2 * by)


def rect_clamp(a: Column, width: Column, height: Column) -> Column:
    x, y = F.least(F.greatest(a["x"], F.lit(0.0)), width), F.least(F.greatest(a["y"], F.lit(0.0)), height)
    return rect(x, y, F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], width) - x), F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], height) - y))


def rect_snap(a: Column) -> Column:
    x, y = F.floor(a["x"]).cast("double"), F.floor(a["y"]).cast("double")
    return rect(x, y, F.ceil(a["x"] + a["width"]) - x, F.ceil(a["y"] + a["height"]) - y)


def rect_right(a: Column) -> Column:
    return a["x"] + a["width"]


def rect_bottom(a: Column) -> Column:
    return a["y"] + a["height"]


def rect_from_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The rectangle with these opposite corners, in any order."""
    x, y = F.least(x0, x1), F.least(y0, y1)
    return rect(x, y, F.greatest(x0, x1) - x, F.greatest(y0, y1) - y)


def rect_area(a: Column) -> Column:
    return a["width"] * a["height"]


def location_key(kind: Column, node: Column, start: Column, end: Column, box: Column | None = None) -> Column:
    region = F.concat_ws(",", *[box[k].cast("string") for k in ("x", "y", "width", "height")]) if box is not None else F.lit("")
    return F.when(kind == "text", F.concat(node, F.lit(":t:"), start.cast("string"), F.lit("-"), end.cast("string"))).when(kind == "region", F.concat(node, F.lit(":r:"), region)).otherwise(F.concat(node, F.lit(":n")))


def gps_to_decimal(dms: Column, hemisphere: Column) -> Column:
    """``[degrees, minutes, seconds]`` and N, S, E or W."""
    return (dms[0] + dms[1] / 60 + dms[2] / 3600) * F.when(F.upper(hemisphere).isin("S", "W"), -1).otherwise(1)
