from corpusmill.llm import overlap

ITEMS = "id string, split string, db_id string, question string, gold_sql string, n int"
RECORDS = "id string, messages array<struct<role: string, content: string>>, response string, db_id string, side string"

GOLD = "SELECT AVG(height) FROM rooms WHERE owner_name = 'Kunela Yomridge' AND page_count >= 12500.5"
BASE = "What is the average height of the rooms located in Kunela Yomridge and with a page count of 12500.5 or more since 2004?"


def pairs(spark, items, records=()):
    i = spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    r = spark.createDataFrame([(*x, "d", "s") for x in records], RECORDS)
    return {(p.eval_id, p.train_id) for p in overlap.cross_split_pairs(i, r).collect()}


def test_cases_and_traps(spark):
    same = {
        "train-1": BASE,
        "train-2": BASE.upper().replace("?", "!!"),
        "train-3": "Next question: what is the average height rooms located in kunela yomridge and with page count of 12,500.50 or more since 2004",
        "train-4": "What is the average height of the rooms with a page count of 12500.5 or more and located in Kunela Yomridge since 2004?",
        "train-5": BASE.replace("Kunela", "Kunea").replace("average", "avergae"),
        "train-6": BASE.replace(" ", " \n ").replace("rooms", "ro​oms") + " Thank you.",
    }
    other = {
        "train-20": BASE.replace("12500.5", "12500.6"),
        "train-21": BASE.replace("Kunela Yomridge", "Torvik Garholm"),
        "train-22": BASE.replace("height", "weight"),
        "train-23": BASE.replace("rooms", "routes"),
        "train-24": BASE.replace("page count", "seat count"),
        "train-25": BASE.replace("2004", "2005"),
        "train-26": "12500.5 2004 Kunela Yomridge height rooms page count",
        "train-27": "",
        "train-28": None,
    }
    gold = {"train-21": GOLD.replace("Kunela Yomridge", "Torvik Garholm"), "train-22": GOLD.replace("height", "weight"), "train-23": GOLD.replace("rooms", "routes"), "train-24": GOLD.replace("page_count", "seat_count")}
    rows = [("dev-1", "dev", "a", BASE, GOLD), ("dev-1", "dev", "A", BASE, GOLD), ("dev-2", "dev", "a", None, None), ("test-3", "test", "a", "", "")]
    rows += [(i, "train", None, q, gold.get(i, GOLD)) for i, q in (same | other).items()]
    found = pairs(spark, rows)
    assert {t for _, t in found} >= set(same) and not {t for _, t in found} & (set(other) - {"train-26"})
    assert {e for e, _ in found} == {"dev-1"}


def test_records(spark):
    schema = "Tables:\nCREATE TABLE rooms (id INTEGER, owner_name TEXT, height REAL, weight REAL, page_count REAL)\n\nHint: share = 100 * a\n\n"
    reply = "```sql\n" + GOLD + "\n```"
    records = [
        ("train-1#s0", [("system", "s"), ("user", f"{schema}Question: {BASE}\n\nWork in short steps.")], reply),
        ("train-1#s1", [("user", f"Q: {BASE.lower()}\nHint: none")], "broken"),
        ("train-2#s0", [("user", f"{schema}Question: what else?"), ("assistant", "x"), ("user", f"Please help. {BASE} Thanks.")], reply),
        ("train-3#s0", [("user", f"{schema}Question: {BASE.replace('height', 'weight')}")], reply.replace("height", "weight")),
        ("train-4#s0", [("assistant", BASE)], reply),
        ("train-5#s0", None, None),
        ("train-6#s0", [("user", None)], None),
    ]
    assert pairs(spark, [("test-1", "test", "a", BASE, GOLD)], records) == {("test-1", "train-1#s0"), ("test-1", "train-1#s1"), ("test-1", "train-2#s0")}


def test_report_and_empty(spark):
    i = spark.createDataFrame([("dev-1", "dev", "My Db", BASE, GOLD, 1), ("dev-2", "dev", "my_db", "else 5", None, 1), ("train-1", "train", None, BASE, GOLD, 1)], ITEMS)
    r = spark.createDataFrame([], RECORDS)
    got = overlap.overlap_report(i, r).collect()
    assert [(x.split, x.source, x["items"], x.leaked, x.in_items, x.in_records) for x in got] == [("dev", "my_db", 2, 1, 1, 0)]
    assert overlap.cross_split_pairs(i.limit(0), r).count() == 0


def test_parts():
    assert overlap.number("77,887") == overlap.number("77887.0") == "77887" and overlap.number("1.234.567") == "1234567" and overlap.number("0.50") == "0.5"
    words = [f"w{i}" for i in range(200)]
    cut = overlap.chunks(words)
    assert [w for c in cut for w in c] == words and max(map(len, cut)) <= 6
    moved = overlap.chunks(["new", *words])
    assert sum(c in cut for c in moved) >= len(moved) - 3
    assert overlap._close("yomune", "yomun") and overlap._close("stock", "stcok") and not overlap._close("torvik", "torwik2")


def test_brute_force(spark, sf):
    """On the smallest tables every pair of items that the exact comparison accepts is found."""
    from corpusmill.session import table

    items = table(spark, sf, "sql_items")
    rows = items.filter("question is not null").select("id", "split", "question", "gold_sql").distinct().collect()
    ready = [(r.id, r.split, *overlap.tokens(r.question), r.gold_sql) for r in rows]
    ready = [(i, s, w, set(n), overlap.keywords(w, *overlap.sql_names(g))) for i, s, w, n, g in ready]
    wanted = {(a[0], b[0]) for a in ready if a[1] != "train" for b in ready if b[1] == "train" and a[3] == b[3] and overlap.same_question(a[2], a[4], b[2], b[4])}
    found = {(p.eval_id, p.train_id) for p in overlap.cross_split_pairs(items, table(spark, sf, "records")).collect()}
    assert wanted and wanted == {(a, b) for a, b in found if "#" not in b}
    # every digest taken for a crowded one: the same pairs
    narrow = {(p.eval_id, p.train_id) for p in overlap.cross_split_pairs(items, table(spark, sf, "records"), digest_pairs=0).collect()}
    assert narrow == found


def test_fraction_counts_repeated_chunks(spark):
    """An identical text that repeats a phrase has a fraction of 1, and the least fraction decides."""
    again = "list the rooms of 2004 and list the rooms of 2004 and list the rooms of 2004 and list the rooms of 2004"
    far = "list the rooms of 2004 with all of the owners who never paid a fee for any of the other halls"
    i = spark.createDataFrame([("dev-1", "dev", "a", again, "SELECT 1", 1), ("train-1", "train", "a", again.upper(), "SELECT 1", 1), ("train-2", "train", "a", far, "SELECT 1", 1)], ITEMS)
    got = {r.train_id: r.fraction for r in overlap.cross_split_pairs(i, spark.createDataFrame([], RECORDS), least=1e-6).collect()}
    assert got["train-1"] == 1.0
    assert {r.train_id for r in overlap.cross_split_pairs(i, spark.createDataFrame([], RECORDS), least=1.0).collect()} == {"train-1"}


def test_rolling_hash():
    """A cut depends on the last words only, so texts that end alike are cut alike from there on."""
    words = [f"w{i}" for i in range(300)]
    ends = lambda cut: {c[-1] for c in cut}
    assert ends(overlap.chunks(words, longest=10**9)) & set(words[152:]) == ends(overlap.chunks(words[150:], longest=10**9)) & set(words[152:])


def test_slips_meet_where_a_digest_is_crowded(spark):
    """A question of one name with a slip is found when each digest is met together with words."""
    q = "how many songs do we have in all of the lists of this house"
    rows = [("dev-1", "dev", "a", q, "SELECT COUNT(*) FROM songs"), ("train-1", "train", "a", q.replace("songs", "sogns"), None), ("train-2", "train", "a", q.replace("songs", "rooms"), "SELECT COUNT(*) FROM rooms")]
    i = spark.createDataFrame([(*x, 1) for x in rows], ITEMS)
    r = spark.createDataFrame([], RECORDS)
    for limit in (0, 10**6):
        assert {p.train_id for p in overlap.cross_split_pairs(i, r, digest_pairs=limit).collect()} == {"train-1"}


def test_long_blocks_and_runs_of_sentences(spark):
    long = "It was noted in the minutes that the house has a rule. " * 60
    records = [("train-1#s0", [("user", f"Question: {long}{BASE}")], None), ("train-2#s0", [("user", f"Hello there. Please read on. {BASE} Work slowly. Thanks.")], None), ("train-3#s0", [("system", f"Example: {BASE} -> none"), ("user", "Q: other")], None)]
    assert {t for _, t in pairs(spark, [("test-1", "test", "a", BASE, GOLD), ("test-2", "test", "a", long + BASE, GOLD)], records)} >= {"train-1#s0", "train-2#s0", "train-3#s0"}
