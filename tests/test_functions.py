import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import models, numbers, text


def values(spark, cases, f):
    """f of each text, in order."""
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_normalize_and_ngrams(spark):
    assert values(spark, ["  The  Größe, of 3.5!", "", None, "ÜÖ"], text.normalize_text) == ["the gr e of 3 5", "", None, ""]
    words = [" ".join(f"w{i}" for i in range(n)) for n in (12, 13, 14)]
    assert values(spark, [*words, ""], lambda c: F.size(text.word_ngrams(c))) == [0, 1, 2, 0]
    assert values(spark, ["a b c a b c"], lambda c: F.size(text.ngram_digests(c, 3))) == [3]
    assert values(spark, ["A b, c d", None], lambda c: text.word_ngrams(c, 3)) == [["a b c", "b c d"], []]


def test_ngrams_take_linear_time(spark):
    """Texts of four times the words take about four times as long, not sixteen times."""
    import time

    def seconds(n):
        rows = spark.range(200).select(F.concat(F.lit(" ".join(f"w{i}" for i in range(n))), F.col("id").cast("string")).alias("t"))
        began = time.time()
        rows.agg(F.sum(F.size(text.ngram_digests(F.col("t"))))).collect()
        return time.time() - began

    seconds(100)
    assert seconds(4000) < 8 * max(0.3, seconds(1000))


def test_extract_sql(spark):
    cases = ["x ```sql\nSELECT 1;\n``` y ```sql\nSELECT 2 ; ;\n```", "<think>```sql\nSELECT 9\n```</think>```\nSELECT 3\n```", "so SELECT a FROM (SELECT b FROM c);", "nothing", "", None, "``` ```sql\n\n```"]
    assert values(spark, cases, text.extract_sql) == ["SELECT 2", "SELECT 3", "SELECT a FROM (SELECT b FROM c)", None, None, None, None]
    assert values(spark, ["SELECT  A\n FROM b ; ;", "select a from b"], text.normalize_sql) == ["select a from b"] * 2


def test_response_and_parts(spark):
    assert values(spark, ["<think>\n</think>\n\nhi", "  </think> hi", "<think>a</think>hi", "\n hi"], text.normalize_response) == ["hi", "hi", "<think>a</think>hi", "hi"]
    assert values(spark, ["p\nQuestion: a b?\nHint: none", "Q: c\n\nQuestion: d\n", "none", "Q: a\nb c\n \nd", "Question: x\nSchema: y"], text.question_of) == ["a b?", "d", "", "a\nb c", "x"]
    assert values(spark, ["p\nHint: a b\n\nQuestion: q", "Hint: none\nQ: x", "External knowledge: two\nlines\n\nQuestion: q", "q"], text.evidence_of) == ["a b", "", "two\nlines", ""]
    assert values(spark, ["```json\n{}\n```"], text.json_object) == [{}]
    assert values(spark, ["Not yet ready", "scale-up", "bad", None], lambda c: text.retryable(F.lit(400), c)) == [True, True, False, False]
    assert values(spark, ["train-1#s12", "train-1", "a#sx"], text.strip_sample) == ["train-1", "train-1", "a#sx"]
    assert values(spark, ["timeout: 3", "plain", ""], text.failure_kind) == ["timeout", "plain", ""]
    assert values(spark, ["AB/2009/page_4.pdf", "AB/09/page_4.pdf"], text.valid_report) == [True, False]
    assert values(spark, ["a\nb", None, "x" * 41], text.cell_text) == ["a b", "NULL", "x" * 40 + "..."]
    assert values(spark, ["x"], lambda c: text.fingerprint(c, F.lit("y"))) == [hashlib.sha256(b"x\0y").hexdigest()]
    assert values(spark, ['```json\n{"a": 1}\n```', 'so {"a": "b"} end', "none", "[1]"], text.json_object) == [{"a": "1"}, {"a": "b"}, None, None]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Answer: 12.5", "12.5"), ("answer: about $1,234.50 in all", "1234.50"), ("Answer: (3.2)", "-3.2"), ("Answer: - 4", "-4"), ("**Answer:**\n**Yes**", "yes"), ("Answer: NO", "no"),
        ("1 then 2\nAnswer: 7.\nmore", "7"), ("Answer: 1\nAnswer: 2", "2"), ("Answer: −12%", "-12"), ("so 3 and +4", "4"), ("no number", None), ("", None), (None, None), ("<think>Answer: 1</think>Answer: 2", "2"),
        ("Answer: 1,23", "1"), ("Answer: 5-3", "5"), ("Answer:", None), ("Answer: 1e-3", "1e-3"),
    ],
)
def test_extract_answer(spark, given, wanted):
    assert values(spark, [given], numbers.extract_answer) == [wanted]


def test_answer_key(spark):
    keys = values(spark, ["12.50", "12.5", "1.25e1", "YES", None, "nan", "1d", "0", "-0.0"], numbers.answer_key)
    assert len(set(keys[:3])) == 1 and keys[3:7] == ["yes", "", "nan", "1d"] and keys[7] == keys[8]


SCORES = [
    ("101", 100.0, None, True, ""), ("101.1", 100.0, None, False, ""), ("1.0", 100.0, None, True, ""), ("10000", 100.0, None, True, ""), ("0", 0.001, None, False, ""), ("0.004", 0.001, None, True, ""),
    ("0", 0.0, None, True, ""), ("x", 1.0, None, False, "not_a_number"), ("inf", 1.0, None, False, "not_a_number"), ("", 1.0, None, False, "no_answer"), (None, 1.0, None, False, "no_answer"),
    ("Yes", None, "yes", True, ""), ("no", None, "yes", False, ""), ("5", None, "yes", False, "not_yes_no"), ("1e400", 1.0, None, False, "not_a_number"),
]


def test_score(spark):
    rows = spark.createDataFrame([(i, p, g, t) for i, (p, g, t, _, _) in enumerate(SCORES)], "i int, p string, g double, t string")
    got = [(r.s.correct, r.s.error) for r in rows.select("i", numbers.score(F.col("p"), F.col("g"), F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [(c, e) for *_, c, e in SCORES]


def test_plain_decimal(spark):
    from decimal import Decimal

    cases = [1e-6, -0.0, 0.0, 1234567.5, 1e21, -1e21, 0.5, -12.0, 100.0, 1e-320, 1.7976931348623157e308, 123456789.125, 0.1 + 0.2, 9.999999e22, 3e7, 12345678.9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*cases, None, float("nan"), float("inf")])], "i int, v double").select("i", numbers.format_gold(F.col("v")).alias("t")).orderBy("i").collect()

    def plain(v):
        t = f"{Decimal(repr(v)):,f}"
        t = t.rstrip("0").rstrip(".") if "." in t else t
        return "0" if t in ("-0", "") else t

    assert [r.t for r in rows] == [plain(v) for v in cases] + [None, None, None]


def test_lengths_and_models(spark):
    assert [r[0] for r in spark.createDataFrame([(1,), (256,), (257,), (1025,)], "n int").select(numbers.padded_length(F.col("n"))).collect()] == [256, 256, 512, 2048]
    row = spark.range(1)
    d = models.dimensions(*[F.lit(v) for v in (4, 1, 8, 10, 2, 2, 1, 2)])
    # q and o 4x4, k and v 4x2, three of 4x8
    got = row.select(d["decoder"], d["head"], d["adapter"], d["width"]).first()
    assert tuple(got) == (16 * 2 + 8 * 2 + 32 * 3, 40, 2 * (8 * 2 + 6 * 2 + 12 * 3), 4)
    merged = spark.createDataFrame([("a", "r", "stop"), (None, "r", "length"), (None, None, "stop")], "c string, r string, f string").select(text.merge_reasoning(F.col("c"), F.col("r"), F.col("f"))).collect()
    assert [r[0] for r in merged] == ["r</think>a", "r", "</think>"]


def test_digest_parts_do_not_collide_together(spark):
    """Two made inputs of 16 bytes with the same xxhash64 (seed 42)."""
    mask, p1, p2, p4, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda x, n: (x << n | x >> 64 - n) & mask
    block = lambda x: turn(x * p2 & mask, 31) * p1 & mask
    state = lambda x: (turn((42 + p5 + 16 & mask) ^ block(x), 27) * p1 + p4) & mask
    want = state(1) ^ state(2) ^ block(7)
    other = turn(want * pow(p1, -1, 1 << 64) & mask, 33) * pow(p2, -1, 1 << 64) & mask
    pairs = [(1).to_bytes(8, "little") + (7).to_bytes(8, "little"), (2).to_bytes(8, "little") + other.to_bytes(8, "little")]
    rows = spark.createDataFrame([(bytearray(b),) for b in pairs], "x binary").select(*[h.alias(n) for h, n in zip(text.digest128(F.col("x")), "ab", strict=True)], F.xxhash64("x", F.lit("second")).alias("folded")).collect()
    assert len({r.a for r in rows}) == 1 and len({r.folded for r in rows}) == 1 and len({r.b for r in rows}) == 2
