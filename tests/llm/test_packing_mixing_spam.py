import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, spam, tokens

DOCS = "doc_id bigint, text string, lang string, source string, rank int"


def test_tokens(spark):
    rows = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|> é " * 10,), ("a" * 50_000,)], "t string")
    got = [r[0] for r in rows.select(tokens.count_tokens(F.col("t"))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 10 and got[4] > 1000
    assert len(tokens.encoding(tokens.TOKENIZER).encode_ordinary("hello world")) == 2


@pytest.mark.parametrize("seed", range(3))
def test_plan_covers_the_histogram(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.sample(range(1, 513), 40))
    histogram = [(s, rng.choice([1, 3, 1000, 50_000])) for s in sizes]
    used = {}
    containers = 0
    for s, config, times in packing.plan(histogram, 512, rounds=60):
        assert int(s @ config) <= 512 and times > 0
        containers += times
        for a, b in zip(s.tolist(), config.tolist(), strict=True):
            used[a] = used.get(a, 0) + b * times
    assert used == dict(histogram)
    assert containers <= 1.02 * math.ceil(sum(s * n for s, n in histogram) / 512) + 1 or any(s > 256 for s, _ in histogram)
    assert packing.plan([], 512) == []


def test_best_configuration():
    sizes, values = np.array([3, 5, 7]), np.array([3.0, 5.1, 7.0])
    assert list(packing.best_configuration(sizes, values, np.array([9, 9, 9]), 10)) == [0, 2, 0]


def test_best_configuration_is_bounded_and_prices_all_sizes():
    sizes = np.arange(1, 401)
    config = packing.best_configuration(sizes, sizes / 2048, np.ones(400, dtype=np.int64), 2048)
    assert config.max() == 1 and config @ sizes == 2048
    values = sizes / 2048
    values[300:] *= 0.999  # the densest sizes come first, but only one of the others closes the container
    assert packing.best_configuration(sizes, values, (sizes >= 205) * 1, 900) @ sizes == 900
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 40), 8, replace=False))
        values, limits = rng.random(8), rng.integers(0, 3, 8)
        best = max(float(values @ c) for c in np.ndindex(*(limits + 1)) if np.array(c) @ sizes <= 60)
        config = packing.best_configuration(sizes, values, limits, 60, core=2)
        assert (config <= limits).all() and config @ sizes <= 60 and abs(values @ config - best) < 1e-9


def test_program_covers_more_lengths_than_the_core():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.integers(300, 1000, 3000), return_counts=True)
    plan, report = packing.planned(list(zip(sizes.tolist(), counts.tolist(), strict=True)))
    used = {}
    for s, config, times in plan:
        assert int(s @ config) <= packing.CAPACITY
        for a, b in zip(s.tolist(), config.tolist(), strict=True):
            used[a] = used.get(a, 0) + b * times
    assert used == dict(zip(sizes.tolist(), counts.tolist(), strict=True)) and len(sizes) > 192
    total = sum(times for *_, times in plan)
    assert total == report["program"] + report["filled"] and report["bound"] <= total <= 1.005 * report["bound"] and report["program"] > 0.9 * total


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("word" for _ in range(rng.choice([1, 5, 40, 90, 130, 300]))), "en", "a", 1) for i in range(200)] + [(900, None, None, None, 1), (901, "", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack(docs, capacity=100).collect()
    totals, parts = {}, {}
    for r in got:
        totals[r.container] = totals.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
    assert max(totals.values()) <= 100 and sorted(totals) == list(range(len(totals)))
    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    for i, text, *_ in rows[:200]:
        n = len(encode(text))
        assert sum(p[2] for p in parts[i]) == n and (n > 100 or len(parts[i]) == 1) and sorted(p[1] for p in parts[i]) == [100 * k for k in range(len(parts[i]))]
    assert set(parts) == set(range(200))
    lower = math.ceil(sum(totals.values()) / 100)
    assert len(totals) <= lower * 1.25
    again = {(r.doc_id, r.piece): r.container for r in packing.pack(docs.repartition(9), capacity=100).collect()}
    assert again == {(r.doc_id, r.piece): r.container for r in got}
    assert packing.packing_report(packing.pack(docs, capacity=100), 100).first().tokens == sum(totals.values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        source = rng.choices(["big", "Mid Size", "small", "other", None], [60, 30, 3, 5, 2])[0]
        rows.append((i, "revenue of the table " * rng.randrange(1, 40), rng.choice(["en", "EN ", "de", None, "xx"]), source, 1))
    docs = spark.createDataFrame(rows + [(5000, None, "en", "big", 1), (5001, "", "en", "small", 1)], DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.4, 2), ("small", 0.1, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeat int")
    mixed = mixing.mix(docs, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert {"big", "mid_size", "small", "absent"} == set(got)
    for name, share, cap in (("big", 0.5, 1), ("mid_size", 0.4, 2), ("small", 0.1, 3)):
        assert abs(got[name].actual_share - share) < 0.01 and got[name].most_copies <= cap
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(5), targets).collect()))
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_rake_keeps_margins():
    tokens_, sources, langs = np.array([100.0, 50, 100, 10]), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    f = mixing.rake(tokens_, sources, [langs], np.array([0.5, 0.5]), np.array([2.0, 2.0]))
    used = f * tokens_
    assert abs(used[:2].sum() - used[2:].sum()) < 1e-6 and f.max() <= 2 + 1e-9
    assert not mixing.rake(np.array([0.0]), np.array([0]), [], np.array([1.0]), np.array([1.0])).any()


PROSE = "The committee approved a lease for 2004 after the third meeting. Nobody on the team expected that the index would change so much. "
SPAM = [
    "sql training , cheap accounting , sql training online , buy cheap accounting , " * 12,
    "\n".join(f"https://a{i}.example/x" for i in range(30)),
    "\n".join(f"- [cheap loan calculator](http://b{i}.test)" for i in range(30)),
    "Home | Shop | Loan Calculator | Terms | " * 15,
    "\n".join(f"#loancalculator{w}" for w in ("best", "top", "buy", "free") * 8),
    "Looking for tax calculator? Our tax calculator is the best tax calculator for tax calculator users. Every tax calculator buyer wants cheap tax calculator. " * 8,
    "\n".join(f"Cash Register F{i} | used 12.{i} in stock" for i in range(10, 40)),
    "".join(f'<a href="http://c{i}.test">cheap tax calculator</a>' for i in range(30)),
    "Kredit Kredite Kredit günstig KREDIT Kredit kaufen Kredit beste Kredit " * 10,
]
FINE = [
    PROSE * 6,
    PROSE * 4 + "\nhttps://x.example/a\n#join #table\nHome | Terms | Contact",
    "Further reading\n" + "\n".join(f"- Because the fee may be zero, the ratio of column {i} needs a guard. https://y{i}.test" for i in range(9)),
    "Columns of the table\n" + "\n".join(f"{w}: This is the {w} of the room and it may be null." for w in ("height", "weight", "score", "price")),
    PROSE + "\nnet revenue | 12 | 33\nfuel cost | 55 | 7\nservice fee | 8 | 9\n" + PROSE,
    PROSE + "\nSELECT height, weight\n  FROM rooms\n  WHERE height >= 5;\n" * 6 + PROSE,
    "How long should a lease wait for its record?",
    "Laut Bericht stieg der Umsatz auf 12 Tausend, während die Kosten gleich blieben. " * 6,
]


def test_spam_share():
    assert all(spam.spam_share(t) > 0.5 for t in SPAM) and all(spam.spam_share(t) <= 0.4 for t in FINE)
    assert spam.spam_share(None) == spam.spam_share("") == spam.spam_share(" \n") == 0 and spam.page_features("1 2 .")[5] == 0


def test_spam_pages(spark):
    rng = random.Random(7)
    fine = [(i, " ".join(rng.sample(FINE[:1] + FINE[6:], 2)) + PROSE * rng.randrange(1, 5), rng.choice(["en", "de", None]), "s", 1) for i in range(300)]
    fine += [(400 + k, t, "en", "s", 1) for k, t in enumerate(FINE)] + [(450, None, "en", "s", 1), (451, "", "en", "s", 1)]
    bad = [(500 + k, t, ["en", "de", None][k % 3], "s", 1) for k, t in enumerate(SPAM)]
    docs = spark.createDataFrame(fine + bad, DOCS)
    assert {r.doc_id for r in spam.spam_pages(docs).collect()} == {r[0] for r in bad}
    assert spam.spam_pages(docs.limit(0)).count() == 0
    assert spam.spam_pages(docs.filter("text is null")).count() == 0


CITIES = "Rome Milan Turin Naples Genoa Bari Pisa Siena Parma Como Lecce Trento".split()
STUFFED = [
    "the ledger for the software and the ledger of the software with an invoice or the ledger in our software that is a ledger for all the software " * 4 + ".",
    " ".join(f"Buy ledger software in {c}." for c in CITIES),
    " ".join(f"You can get the best ledger software here in {c}." for c in CITIES),
    " ".join(f"Buy ledger software in {c}." for c in CITIES * 2) + "\n" + PROSE * 3,
]
COLUMNS = ["width", "height", "depth", "length", "radius", "girth", "reach", "drop"]
REPEATING = [
    "\n".join(f"{w}: The {w} of the room in metres." for w in COLUMNS),
    "\n".join(f"{w}: room {w} in metres." for w in COLUMNS),
    "\n".join(f"- The {w} of a record may be null before the import, so check it." for w in COLUMNS),
    "The ledger holds each entry of the month and the clerk checks it. When an entry is missing, the ledger is opened again and the auditor signs it. A second copy of the ledger stays in the archive. Nobody may change the ledger without a note. The office prints a report about the ledger. ",
    "We saw that " + "the court held that the contract was void and that the defendant who signed it knew of the defect when the goods were sold to a third person in another town, so that the claim for damages could not stand although the appeal was late, " * 3 + "as we said.",
]


def test_keywords_in_long_and_short_sentences(spark):
    assert all(spam.spam_share(t) > 0.5 for t in STUFFED) and all(spam.spam_share(t) <= 0.4 for t in REPEATING)
    fine = [(i, PROSE * (2 + i % 5) + FINE[6 + i % 2], "en", "s", 1) for i in range(100)] + [(200 + k, t, "en", "s", 1) for k, t in enumerate(REPEATING)]
    docs = spark.createDataFrame(fine + [(500 + k, t, "en", "s", 1) for k, t in enumerate(STUFFED)], DOCS)
    assert {r.doc_id for r in spam.spam_pages(docs).collect()} == {500 + k for k in range(len(STUFFED))}


SWEDISH = "Kommittén godkände avtalet efter det tredje mötet och ingen väntade sig att priset skulle ändras så mycket. Rapporten skrevs av {} och den visar att kostnaden steg medan intäkten låg kvar på samma nivå som året innan. "


def test_languages_that_are_mostly_spam(spark):
    """German, and other tags, have more spam of one form than prose; of all pages it is a third."""
    fine = [(i, PROSE * (2 + i % 5), "en", "s", 1) for i in range(400)] + [(400 + i, FINE[7] * (1 + i % 3), "de", "s", 1) for i in range(40)]
    bad = [(1000 + i, SPAM[8] * (1 + i % 3), "de", "s", 1) for i in range(120)] + [(2000 + i, SPAM[0] * (1 + i % 3), "sv", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(fine + bad, DOCS)
    assert {r.doc_id for r in spam.spam_pages(docs).collect()} == {r[0] for r in bad}
    assert {r.doc_id for r in spam.spam_pages(docs.filter("doc_id between 1000 and 1999")).collect()} == set(range(1000, 1120))


def test_prose_of_unknown_languages(spark):
    swedish = [(i, "".join(SWEDISH.format(n) for n in ("Anna", "Erik", "Karin")[: 1 + i % 3]), "sv", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(swedish + [(500 + i, PROSE * (2 + i % 5), "en", "s", 1) for i in range(200)], DOCS)
    assert spam.spam_pages(docs).count() == 0


def test_calibrate():
    """Each class meets its tokens to half a bin, and smaller documents make up for what larger ones miss."""
    histogram = [("a", 5, 10, 900.0), ("a", 5, 20, 900.0), ("a", 1, 3, 5.0), ("a", 1, 7, 5.0), ("a", 1, 9, 5.0), ("b", 2, 0, 30.0)]
    got = mixing.calibrate(histogram, {("a", 5): 895.0, ("a", 1): 14.0, ("b", 2): 10.0})
    assert got["a", 5] == 11 / mixing.BINS and got["a", 1] == 8 / mixing.BINS and got["b", 2] == 0.0
    assert mixing.calibrate([], {}) == {}


def test_topics(spark):
    from corpusmill.llm import topics

    rng = random.Random(2)
    words = {"money": "revenue asset margin dividend ledger audit", "query": "select join column table index schema", "dish": "soup onion butter garlic pepper oven"}
    texts = [(" ".join(rng.choices(w.split(), k=40)), lang, name) for name, w in words.items() for lang in ("en", "de") for _ in range(30)]
    model = topics.fit([t for t, *_ in texts], [g for _, g, _ in texts], topics=3)
    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    found = {}
    for t, lang, name in texts:
        found.setdefault((name, model.topic(encode(t), lang)), []).append(1)
    assert len(found) == 3 and len({k for _, k in found}) == 3  # the same topic for a subject in both languages
    assert model.topic([], "en") == "none" and topics.fit([], []).topic([1], "en") == "none"
    assert topics.fit(["one text", ""], ["en", "xx"]).topic(encode("one text"), "zz") in ("t0", "none")


def test_topics_are_fitted_to_all_documents(spark):
    """A subject that only the documents with the largest hashes have is a topic, and the model doesn't depend on partitions."""
    from pyspark.sql import functions as F

    from corpusmill.llm import topics

    rng = random.Random(4)
    words = [w.split() for w in ("revenue asset margin dividend ledger audit", "select join column table index schema", "soup onion butter garlic pepper oven")]
    ids = [r.id for r in spark.range(2600).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, " ".join(rng.choices(words[2 if at >= 2400 else at % 2], k=40)), "en", "a") for at, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    got = {r.doc_id: r.topic for r in mixing.cells(docs, targets).collect()}
    dish = {got[i] for i in ids[2400:]}
    assert "none" not in set(got.values()) and not dish & {got[i] for i in ids[:2400]}
    assert got == {r.doc_id: r.topic for r in mixing.cells(docs.repartition(9), targets).collect()}
    table = topics.tokenized(docs.repartition(3)).cache()
    a, b = (topics.fit_to(topics.Spread(t, topics.Batch.read))[0] for t in (table, table.repartition(70)))
    assert (a.centres == b.centres).all() and (a.means == b.means).all()
