"""Validators: both forms agree with the vectors and with each other."""

import random

import pytest
from pyspark.sql import functions as F

from redoubt.functions import checks, columns
from redoubt.functions import scan as S

VECTORS = [
    ("luhn", "4111 1111 1111 1111", True), ("luhn", "4111 1111 1111 1112", False), ("luhn", "0", False), ("luhn", "", False),
    ("iban", "GB29 NWBK 6016 1331 9268 19", True), ("iban", "DE89370400440532013000", True), ("iban", "GB29 NWBK 6016 1331 9268 18", False), ("iban", "ZZ8937040044053201300", False),
    ("us_ssn", "123-45-6789", True), ("us_ssn", "000-12-3456", False), ("us_ssn", "666-12-3456", False), ("us_ssn", "923-12-3456", False), ("us_ssn", "078-05-1120", False), ("us_ssn", "123-00-6789", False),
    ("aba_routing", "021000021", True), ("aba_routing", "021000022", False), ("nhs_number", "943 476 5919", True), ("nhs_number", "943 476 5918", False),
    ("uk_nino", "AB 12 34 56 C", True), ("uk_nino", "GB123456A", False), ("uk_nino", "DA123456A", False), ("uk_nino", "AO123456A", False),
    ("ipv4", "93.184.216.34", True), ("ipv4", "256.1.1.1", False), ("ipv4", "1.2.3.04", False), ("ipv4", "1.2.3", False), ("ipv4", "0.0.0.0", True),
    ("is_placeholder", "xxxx", True), ("is_placeholder", "changeme", True), ("is_placeholder", "8888", True), ("is_placeholder", "hunter2", False),
]


def test_vectors(spark):
    for name, value, want in VECTORS:
        assert bool(getattr(checks, name)(value)) is want, (name, value)
    df = spark.createDataFrame([(v,) for _, v, _ in VECTORS], "v string")
    for name in {n for n, _, _ in VECTORS}:
        got = {r.v: r.ok for r in df.select("v", getattr(columns, name)(F.col("v")).alias("ok")).collect()}
        for n, value, want in VECTORS:
            assert n != name or bool(got[value]) is want, (name, value)


def test_both_forms_agree_on_random_digits(spark):
    some = random.Random(1)
    rows = [("".join(some.choices("0123456789", k=some.choice((9, 10, 16)))),) for _ in range(2000)]
    cols = ("luhn", "us_ssn", "aba_routing", "nhs_number")
    df = spark.createDataFrame(rows, "v string").select("v", *[getattr(columns, c)(F.col("v")).alias(c) for c in cols], columns.entropy(F.col("v")).alias("bits"))
    for r in df.collect():
        for c in cols:
            assert r[c] == getattr(checks, c)(r.v), (c, r.v)
        assert r.bits == pytest.approx(checks.entropy(r.v))


def test_other_checks():
    assert checks.mrz_check_digit("L898902C3", "6") and not checks.mrz_check_digit("L898902C3", "5")
    assert checks.transcribe("four one twenty-three oh nine and ten") == "41230910"
    assert checks.decode_base64("cGFzc3dvcmQ9aHVudGVyMg==") == "password=hunter2" and checks.decode_base64("////") is None
    assert checks.card_brand("4111111111111111") == "visa" and checks.card_brand("9111111111111111") is None
    assert not checks.looks_like_name("New Street") and checks.looks_like_name("Ada Lovelace")
    assert checks.weighted_mod11("19", (2, 1)) is True and checks.precision_metres(5) == pytest.approx(1.1132)


def test_hashes_and_text_columns(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(
        columns.content_id("f_", F.lit("a"), F.lit(3)).alias("id"), columns.hmac_sha256(b"k" * 70, F.lit("message")).alias("mac"), columns.mask_value(F.lit("4111-1111-1111-1234")).alias("mask"),
        columns.mask_value(F.lit("ab-cdef"), 2, "start").alias("front"), columns.preview(F.lit(" secret value ")).alias("preview"), columns.retain_key(F.lit("A‑B  c_d")).alias("retain"),
        columns.search_key(F.lit("A​B C")).alias("search"), columns.occurrences(F.lit("ab cab ab"), F.lit("ab"), F.lit(True)).alias("words"), columns.occurrences(F.lit("ab cab ab"), F.lit("ab"), F.lit(False)).alias("all"),
    ).first()
    assert row.id == S.finding_id("a", 3)
    assert row.mac == hmac.new(b"k" * 70, b"message", hashlib.sha256).hexdigest()
    assert (row["mask"], row.front, row.preview) == ("****-****-****-1234", "ab-****", "s********e")
    assert (row.retain, row.search, row.words, row.all) == ("a b c d", "ab c", 2, 3)


def test_utf16_offsets(spark):
    row = spark.createDataFrame([("a😀b😀",)], "t string").select(*[columns.utf16_offset(F.col("t"), F.lit(i)).alias(f"o{i}") for i in range(5)]).first()
    assert tuple(row) == (0, 1, 3, 4, 6)


def test_rectangles(spark):
    box = lambda *v: columns.rect(*[F.lit(float(x)) for x in v])
    a, b = box(0, 0, 4, 4), box(2, 3, 4, 4)
    row = spark.range(1).select(
        columns.rect_intersects(a, b).alias("hit"), columns.rect_intersects(a, box(4, 0, 1, 1)).alias("edge"), columns.rect_intersection(a, b).alias("both"), columns.rect_union(a, b).alias("either"),
        columns.rect_snap(box(0.5, 0.5, 1, 1)).alias("snap"), columns.rect_area(columns.rect_inflate(a, 1)).alias("area"), columns.rect_clamp(box(-1, -1, 9, 3), F.lit(4.0), F.lit(4.0)).alias("clamp"),
        columns.gps_to_decimal(F.array(F.lit(51.0), F.lit(30.0), F.lit(30.0)), F.lit("S")).alias("gps"),
    ).first()
    assert (row.hit, row.edge, tuple(row.both), tuple(row.either)) == (True, False, (2, 3, 2, 1), (0, 0, 6, 7))
    assert (tuple(row.snap), row.area, tuple(row.clamp)) == ((0, 0, 2, 2), 36, (0, 0, 4, 2)) and row.gps == pytest.approx(-51.508333, abs=1e-6)


def test_unlisted_countries_and_unicode_spaces(spark):
    def iban(country, body):
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{98 - rest:02d}{body}"

    values = [iban("DZ", "1234567890"), iban("DZ", "123456789"), iban("DZ", "A" * 30), iban("DZ", "A" * 31), iban("DE", "1234567890"), iban("DE", "1" * 18), iban("DE", "1" * 18).replace("1", "2", 1)]
    values += [" ".join(iban("DE", "1" * 18)[i : i + 4] for i in range(0, 22, 4)).replace(" ", gap) for gap in "\u00a0\u2009\u3000\u2028\ufeff\u2011-."]
    want = [True, False, True, False, False, True, False] + [True] * 8
    assert [checks.iban(v) for v in values] == want
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r.ok for r in rows.select("i", columns.iban(F.col("v")).alias("ok")).orderBy("i").collect()] == want
    cards = [f"4111{gap}1111{gap}1111{gap}1111" for gap in "\u00a0\u202f\u1680\x1c\x85"]
    both = spark.createDataFrame([(v,) for v in cards], "v string").select("v", columns.luhn(F.col("v")).alias("ok")).collect()
    assert [r.ok for r in both] == [checks.luhn(r.v) for r in both] == [True, True, True, False, False]


def test_boxes_of_spans(spark):
    glyph = "struct<x:double,y:double,width:double,height:double>"
    rows = [(1, [(0.0, 0.0, 5.0, 9.0), (5.0, 1.0, 4.0, 7.0), (9.0, 0.0, 2.0, 9.0)], (0.0, 0.0, 50.0, 9.0), 1, 3), (2, None, (1.0, 2.0, 3.0, 4.0), 0, 2), (3, [], (1.0, 2.0, 3.0, 4.0), 0, 1)]
    df = spark.createDataFrame(rows, f"i int, glyphs array<{glyph}>, bbox {glyph}, s int, e int")
    got = {r.i: tuple(r.b) for r in df.select("i", columns.rect_for(F.col("glyphs"), F.col("bbox"), F.col("s"), F.col("e")).alias("b")).collect()}
    assert got == {1: (5.0, 0.0, 6.0, 9.0), 2: (1.0, 2.0, 3.0, 4.0), 3: (1.0, 2.0, 3.0, 4.0)}
    one = df.limit(1).select(columns.rect_from_points(F.lit(5.0), F.lit(1.0), F.lit(2.0), F.lit(4.0)).alias("r"), columns.text_at(F.lit("abcdef"), F.lit(2), F.lit(4)).alias("t")).select("r.*", columns.rect_right(F.col("r")).alias("right"), columns.rect_bottom(F.col("r")).alias("bottom"), "t").first()
    assert tuple(one) == (2.0, 1.0, 3.0, 3.0, 5.0, 4.0, "cd")
