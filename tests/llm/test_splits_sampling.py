import random

from pyspark.sql import functions as F

from corpusmill.llm import names, sampling, splits


def test_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("retail_ledger", " Retail Ledger\t", "RETAIL-LEDGER", "train_databases/retail_ledger/retail_ledger.sqlite", "retail_ledger.DB", "retailLedger", "a\\retail_ledger.sqlite")], "x string")
    assert {r[0] for r in rows.select(names.database_name(F.col("x"))).collect()} == {"retail_ledger"}
    apart = spark.createDataFrame([("ops_10",), ("ops",), ("ops_1",), ("",), (" ",), (None,)], "x string").select(names.database_name(F.col("x"))).collect()
    assert [r[0] for r in apart] == ["ops_10", "ops", "ops_1", None, None, None]
    reports = spark.createDataFrame([(x,) for x in ("XAB/2009/page_1.pdf", "./xab/2009/page_1", "reports/Xab/2009/page-1.pdf", "XAB%2F2009%2Fpage_1.pdf", "XAB\\2009\\page_1.pdf", "XAB /2009/page_1.pdf", " XAB//2009/page_1.PDF")], "x string")
    assert {r[0] for r in reports.select(names.company_code(F.col("x"))).collect()} == {"XAB"}
    assert [r[0] for r in spark.createDataFrame([("Report-Notes ",), (None,), ("",)], "x string").select(names.source_name(F.col("x"))).collect()] == ["report_notes", None, None]


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [(None, "x"), ("hub", "a1"), ("hub", "a2"), ("hub", "hub")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    got = {r.node: r.component for r in splits.components(spark.createDataFrame(edges, "left_source string, right_source string")).collect()}
    members = {}
    for x in parent:
        members.setdefault(root(x), []).append(x)
    assert got == {x: min(m) for m in members.values() for x in m}
    assert splits.components(spark.createDataFrame([], "left_source string, right_source string")).count() == 0


SQL = "id string, db_id string, split string, component string"
QA = "id string, report string, size int"
LINKS = "link_id bigint, kind string, left_source string, right_source string"


def test_groups_and_splits(spark):
    sql = [(f"t-{i}", f"db_{i % 40}", "x", "c") for i in range(400)] + [(f"h-{i}", "Big DB", "x", "c") for i in range(300)] + [("n-1", None, "x", "c"), ("t-1", "DB_1", "y", "c")]
    qa = [(f"q-{i}", f"X{i % 50:02}/2001/page_1.pdf", 1) for i in range(300)] + [("q-x", None, 1)]
    links = [(1, "copy_of", "db_1", "db_2"), (2, "built_from", "db_2", "X03"), (2, "built_from", "X03", "db_2"), (3, "mentions", "db_5", "db_6"), (4, "renamed", None, "db_7")]
    a, b, c = spark.createDataFrame(sql, SQL), spark.createDataFrame(qa, QA), spark.createDataFrame(links, LINKS)
    groups = {r.id: r.group_key for r in splits.item_groups(a, b, c).collect()}
    assert groups["t-1"] == groups["t-2"] == groups["q-3"] == "X03" and groups["t-5"] == "db_5" and groups["t-6"] == "db_6" and groups["h-1"] == "big_db" and groups["n-1"] is None and len(groups) == 1002
    got = splits.split_items(a, b, c).collect()
    assert len(got) == len({r.id for r in got}) == 1002
    where = {}
    for r in got:
        if r.group_key:
            assert where.setdefault(r.group_key, r.split) == r.split
    share = {s: sum(r.split == s for r in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02
    again = splits.split_items(a.repartition(7), b.repartition(3), c)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert splits.split_items(a.limit(0), b.limit(0), c.limit(0)).count() == 0


def test_flow():
    flow = splits.solve_flow([(0, 100), (1, 50)], 2, [0.8, 0.1, 0.1])
    assert [round(x) for x in flow[0]] == [80, 10, 10] and [round(x) for x in flow[1]] == [40, 5, 5]
    counts = splits.allocate([(0, 140, 1, 140), (0, 1, 860, 860)], [0.8, 0.1, 0.1])
    assert counts == [[1, 0, 0], [660, 100, 100]]
    # one source larger than a small split's quota must not become that split
    bundles = [(0, 1500, 1, 1500), (0, 10, 650, 6500), (1, 1, 2000, 2000)]
    for row in (counts := splits.allocate(bundles, [0.8, 0.1, 0.1]))[1:]:
        assert min(row) > 0
    assert counts[0] == [1, 0, 0] and [sum(c[j] * b[1] for c, b in zip(counts, bundles, strict=True)) for j in range(3)] == [8000, 1000, 1000]
    assert splits.allocate([], [0.8, 0.1, 0.1]) == []


def test_sample(spark):
    rows = [(f"train-{i}#s{i % 4}", i % 10) for i in range(4000)] + [("train-1#s1", 9), (None, 3)] + [(f"late {c}{d}", None) for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst"]
    df = spark.createDataFrame(rows, "id string, batch int").withColumn("seq", F.lit(1))
    chosen = {r.id: r.seq for r in sampling.golden_sample(df).collect()}
    assert abs(sum(v is not None for v in chosen.values()) - 200) <= 12 and 5 <= sum(v is None for v in chosen.values()) <= 40
    assert {r.id: r.seq for r in sampling.golden_sample(df.repartition(9).orderBy(F.rand(3))).collect()} == chosen
    for gone in ("batch <= 4 or batch is null", "batch <> 2", "hash(id) % 3 = 0"):  # deliveries missing, and rows of any delivery
        kept = df.filter(gone)
        assert {r.id for r in sampling.golden_sample(kept).collect()} == set(chosen) & {r.id for r in kept.collect()}
    assert sampling.golden_sample(df.limit(0)).count() == 0
    from fractions import Fraction

    shift = sampling.shift_of("corpusmill")
    for n, seq in list(chosen.items())[:50]:
        if seq is not None:
            assert Fraction((seq * sampling.GOLDEN + shift) % sampling.UNIT, sampling.UNIT) < Fraction(1, 20), n


def test_own_numbers(spark):
    keys = ["train-17#s2", "train-17", "dev-17", "017", "17#s300", "a#b1", "x", "", "1" * 13, "a" * 9000 + "5", None]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(sampling.own_number(F.col("k"))).collect()]
    assert got[0] - got[1] == 2 * sampling.LANE and got[1] % sampling.LANE == got[2] % sampling.LANE == 17 and got[1] != got[2]
    assert got[3] % sampling.LANE == 17 and (got[4] - got[3]) == 300 % 256 * sampling.LANE and got[5:8] == [None] * 3 and got[8] % sampling.LANE == 10**12 // 9 and got[9] % sampling.LANE == 5 and got[10] is None


def test_ledger(spark, tmp_path):
    """Late rows of earlier deliveries, deletions and repeats change no number; a generation that broke off is written anew."""
    rows = [(f"k{c}", b) for c in range(900) for b in (c % 3,)]
    df = spark.createDataFrame(rows + [(None, 1), ("k1", 2)], "id string, batch int")
    ledger = str(tmp_path / "ledger")
    first = {r.id: r.seq for r in sampling.ledger_numbers(df.filter("batch <> 1 or hash(id) % 2 = 0"), ledger).collect()}
    (tmp_path / "ledger" / "generation_000001").mkdir()
    (tmp_path / "ledger" / "generation_000001" / "part-0.parquet").write_bytes(b"broken off")
    chosen = {r.id for r in sampling.golden_sample(df.filter("batch <> 1 or hash(id) % 2 = 0"), 0.1, ledger=ledger).collect()}
    later = {r.id: r.seq for r in sampling.ledger_numbers(df.repartition(7), ledger).collect()}
    assert len(later) == 900 and sorted(later.values()) == list(range(900)) and all(later[k] == v for k, v in first.items()) and len(first) < 900
    grown = {r.id for r in sampling.golden_sample(df, 0.1, ledger=ledger).collect()}
    assert chosen <= grown and abs(len(grown) - 90) <= 2
    assert {r.id for r in sampling.golden_sample(df.filter("batch = 0"), 0.1, ledger=ledger).collect()} == {k for k in grown if int(k[1:]) % 3 == 0}
    assert sampling.golden_sample(df.limit(0), 0.1, ledger=str(tmp_path / "none")).count() == 0
