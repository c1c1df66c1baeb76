import numpy as np
import pytest

from corpusmill.llm import defects, formatting

SAME = [
    ["12,345.5", " 12345.5 ", "**12,345.5**", '"$12345.5."', "$ 12,345.5 %", "12345.5%\n"],
    ["-5", "− 5", "- 5.", "-$5", "**- $5**"],
    ["Yes", "yes.", "`YES`", " yes!"],
    ['{"answer": 1785.5, "unit": "count"}', '{"UNIT":"count","Answer":"1785.5"}', "unit=count; answer = 1,785.5;", "answer: 1785.5 | unit: count.", "ANSWER: 1785.5, UNIT: count", "unit:count\nanswer:1785.5"],
    ["SELECT a, b FROM t WHERE x = 'K v' LIMIT 5", 'select "a" ,"b"\r\n\tfrom `t` where [x]=\'k V\' limit 5 ;\n', "\xa0SELECT\xa0a,b FROM t WHERE x  = 'K V' LIMIT 5;"],
    ['{"sql": "SELECT COUNT(*) FROM t WHERE a <= 3", "rows": 4}', '{"ROWS": 4, "SQL": "select count( * ) from T where [a]<=3;"}'],
    ["", "  ", " .;"],
]
APART = ["5", "-5", "50", "5.0", "0.5", '{"a": 1, "b": 2}', '{"a": 2, "b": 1}', "select a,b from t", "select b,a from t", "select a from t where x<1", "select a from t where x<=1", "select t1.a from t", "yes", "no"]


@pytest.mark.parametrize("group", SAME)
def test_same(group):
    assert len({formatting.canonical(x) for x in group}) == 1


def test_apart():
    assert len({formatting.canonical(x) for x in APART}) == len(APART)
    assert formatting.canonical("{" * 5000) and formatting.canonical("x" * 200_000)


def test_copies(spark):
    rows, row_id = [], 0
    for q, group in enumerate(SAME):
        for x in group * 2:
            rows.append((row_id, f"q{q}", x if q > 3 else None, None if q > 3 else x, "v"))
            row_id += 1
    rows += [(900, "q0", None, None, "v"), (901, "q0", None, None, "v"), (902, "z", None, "5", "v"), (903, None, None, "5", "v"), (904, None, None, "5.", "v"), (None, "z", None, "5", "v")]
    graded = spark.createDataFrame(rows, "row_id bigint, id string, pred_sql string, pred_answer string, canon string")
    got = {(r.kept_row_id, r.copy_row_id) for r in formatting.copies(graded).collect()}
    wanted, at = {(903, 904)}, 0
    for group in SAME:
        wanted |= {(at, at + k) for k in range(1, 2 * len(group))}
        at += 2 * len(group)
    assert got == wanted
    counts = {r.kept_row_id: r.copies for r in formatting.copy_counts(graded).collect()}
    assert counts[0] == 2 * len(SAME[0]) and counts[902] == 1 and sum(counts.values()) == at + 3
    assert formatting.copies(graded.limit(0)).count() == 0 and formatting.copy_counts(graded.limit(0)).count() == 0


SQL_Q = "What is the average height of the rooms located in Kunela Yomridge and with a score of 125 or more?"
QA_Q = "in 2005, what is the total of service fee and research outlay for XJOQR, given 51062 as the base?"
LABELLED = [
    (None, "stop", SQL_Q, "empty"), ("", "length", SQL_Q, "empty"), ("```sql\n```", "stop", SQL_Q, "empty"), ("<think>\n\n</think>\n\n", "stop", SQL_Q, "empty"), (" ** ...&nbsp;<br/>", None, SQL_Q, "empty"),
    ("```sql\nSELECT AVG(height) FROM rooms WHERE score >= 125\n```", "length", SQL_Q, "truncated"), ("```sql\nSELECT AVG(height) FROM rooms WHERE", "stop", SQL_Q, "truncated"), ("First keep the rows of rooms that ma", "stop", SQL_Q, "truncated"),
    ("<think>\nI divide the change", None, QA_Q, "truncated"), ("The table lists both. and dividing", "stop", QA_Q, "truncated"), ("SELECT AVG(height) FROM rooms WHERE owner_name = 'Kun", "stop", SQL_Q, "truncated"), ("So\n```json\n{\"sql\": \"SELECT 1", "stop", SQL_Q, "truncated"), ("I am not able to see an index on score, which does not matter. First ke", "stop", SQL_Q, "truncated"),
    ("I'm sorry, but I can't help with this question.", "stop", SQL_Q, "refusal"), ("Hmm, my rules do not let me continue with it. Try rephrasing.", "stop", QA_Q, "refusal"), ("<think>\nNot sure.\n</think>\nUnfortunately, no query will be provided.", None, SQL_Q, "refusal"), ("Dabei kann ich leider nicht helfen.", "stop", SQL_Q, "refusal"), ("Lo siento, no puedo ayudar con esta consulta.", "stop", SQL_Q, "refusal"), ("Je ne peux pas répondre à cela.", "stop", SQL_Q, "refusal"),
    (SQL_Q, "stop", SQL_Q, "copy"), ("The task is: " + SQL_Q.lower(), "stop", SQL_Q, "copy"), (f"{SQL_Q}\n{SQL_Q}", "stop", SQL_Q, "copy"), (f"Tables of the database:\nCREATE TABLE rooms (id INTEGER, height REAL)\n\nQuestion: {SQL_Q}\n\nFinish with one SQLite query.", "stop", SQL_Q, "copy"), ("```\n" + QA_Q.replace(" ", "  ") + "\n```", "stop", QA_Q, "copy"),
    ("Die Frage braucht die Tabelle rooms, gefiltert nach score.\n```sql\nSELECT AVG(height) FROM rooms\n```", "stop", SQL_Q, "language"), ("差を前年の値で割ります。\nAnswer: 5", "stop", QA_Q, "language"), ("Dzielę zmianę przez wcześniejszą wartość.\nAnswer: 5", "stop", QA_Q, "language"), ("Rounding is left to the last step.\nAnswer: 5", "stop", "Wie hoch war der Wert von XJOQR im Jahr 2005, wenn 5 als Basis gilt?", "language"),
    ("```sql\nSELECT AVG(height) FROM rooms WHERE score >= 125;\n```", "stop", SQL_Q, None), ("Apologies, the earlier draft was longer. I am not able to see an index, which does not matter.\nSELECT AVG([height]) FROM [rooms] ;", None, SQL_Q, None), (f"You ask: {QA_Q}\nThat is it.\n**Answer:** $ 5.2", "stop", QA_Q, None), ("Answer:\nunit=usd | answer=-5;", "stop", QA_Q, None), ("Sorry for the short style, here is it.\n```json\n{\"rows\": 2, \"sql\": \"SELECT AVG(height) FROM rooms\"}\n```", "stop", SQL_Q, None),
    ("4,525.9", "stop", QA_Q, None), ("WITH x AS (SELECT height FROM rooms) SELECT AVG(height) FROM x", "stop", SQL_Q, None), ("Answer: yes", "stop", None, None),
]


MORE = [
    ("Regretfully this cannot be taken on here; a professional should see such a sensitive request.", "stop", SQL_Q, "refusal"),
    ("My apologies, something else may be easier. Consider rephrasing the whole request.", "stop", QA_Q, "refusal"),
    ("The service fee and the outlay are listed side by side.", "stop", QA_Q, "truncated"),
    ("Unfortunately the fee is split over two rows and the second", "length", QA_Q, "truncated"),
    (SQL_Q + " " + "so the rows are kept that match the name and the score, and then the heights " * 5, "stop", SQL_Q, "truncated"),
    ("Сначала складываю оба значения.\nAnswer: 5", "stop", "Revenue 2019?", "language"),
    ("Answer: 5", "stop", "Revenue 2019?", None),
    ("Lasken molempien vuosien erotuksen taulukosta.\nAnswer: 5", "stop", QA_Q, "language"),
    ("I divide the change by the earlier value.\nAnswer: 5", "stop", QA_Q, None),
    ("Rounding last.\nAnswer: 5", "stop", QA_Q, None),
]


@pytest.fixture(scope="module")
def models(spark):
    """The label models of all answers of the test tables."""
    from corpusmill.session import table

    d = "/root/testdata/sf0.01"
    voted = defects.generation_votes(table(spark, d, "generations"), table(spark, d, "sql_items"), table(spark, d, "qa_items")).unionByName(defects.record_votes(table(spark, d, "records")))
    return defects.label_models(voted)


def _first(models, text, finish, question, prompt=""):
    masks = defects.votes(text, finish, question, prompt)
    return next((d for d, m in zip(defects.DEFECTS, masks, strict=True) if models[d][0].posterior(np.array([m]))[0] > models[d][1]), None)


def test_held_out_answers(models):
    """No cutoff has seen these answers: every defect is found with precision and recall of 0.9 at least."""
    got = [(_first(models, t, f, q), w) for t, f, q, w in LABELLED + MORE]
    for d in defects.DEFECTS:
        tp = sum(g == w == d for g, w in got)
        assert tp >= 0.9 * sum(w == d for _, w in got) and tp >= 0.9 * sum(g == d for g, _ in got), (d, [x for x in zip(LABELLED + MORE, got) if x[1][0] != x[1][1]])
    assert sum(g is None for g, w in got if w is None) >= 0.9 * sum(w is None for _, w in got)


def test_model_decides_and_no_single_function(models):
    """Each defect has labelled answers that its first function misses or has wrong and the model has right."""
    rows = [(t, f, q, "", w) for t, f, q, w in LABELLED + MORE] + [(t, f, q, p, next((d for d in defects.DEFECTS if d in found), None)) for t, f, q, p, found in defects.ANSWERS]
    for i, d in enumerate(defects.DEFECTS):
        mended = 0
        for t, f, q, p, w in rows:
            mask = defects.votes(t, f, q, p)[i]
            kept = models[d][0].posterior(np.array([mask]))[0] > models[d][1]
            mended += kept == (w == d) != bool(mask & 1)
        assert mended > 0 or d in ("empty", "copy", "language"), d


GEN = "id string, choices array<struct<content: string, reasoning_content: string, finish_reason: string>>, defect string"
REC = "id string, messages array<struct<role: string, content: string>>, response string, sample int, votes int"


def test_found(spark):
    usable = [x for x in LABELLED if x[2] is not None]
    good = usable[-6]
    generations = [(f"i{k}", [(t, None, f), (good[0], None, "stop")], "x") for k, (t, f, _, _) in enumerate(usable)] + [("none", None, "x"), ("empty", [], "x"), (None, [("", None, None)], "x"), ("unknown", [("", None, "stop")], "x")]
    generations += [generations[0]]
    items = spark.createDataFrame([(f"i{k}", q) for k, (_, _, q, _) in enumerate(usable)] + [("i0", None)], "id string, question string")
    records = [(f"r{k}", [("user", f"Schema\n\nQuestion: {q}\n\nShort.")], t, 3, 1) for k, (t, f, q, _) in enumerate(usable) if f != "length"] + [("bare", None, "", 0, 1), (None, None, "", 0, 1)]
    labels = defects.defect_labels(spark.createDataFrame(generations, GEN), spark.createDataFrame(records, REC), items, items.limit(0))
    got = {(r.origin, r.id, r.sample): r.defect for r in defects.first_defects(labels).collect()}
    wanted = {("generations", f"i{k}", 0): w for k, (_, _, _, w) in enumerate(usable) if w} | {("records", f"r{k}", 3): w for k, (_, f, _, w) in enumerate(usable) if w and f != "length"}
    wanted |= {("generations", "unknown", 0): "empty", ("records", "bare", 0): "empty"}
    # the sound second choice is in English
    wanted |= {("generations", f"i{k}", 1): "language" for k, (_, _, q, _) in enumerate(usable) if q.startswith("Wie")}
    assert got == wanted
    none = defects.defect_labels(spark.createDataFrame([], GEN), spark.createDataFrame([], REC), items, items)
    assert defects.first_defects(none).count() == 0


def test_model_recovers_rates():
    rng = np.random.default_rng(1)
    n, share = 20_000, 0.05
    truth = rng.random(n) < share
    rates = [(0.97, 1e-4), (0.7, 0.05), (0.6, 0.1), (0.5, 0.02)]
    bits = np.column_stack([np.where(truth, rng.random(n) < h, rng.random(n) < f) for h, f in rates])
    masks, counts = np.unique((bits << np.arange(4)).sum(1), return_counts=True)
    model = defects.LabelModel(4).fit(masks, counts.astype(float))
    kept = model.posterior((bits << np.arange(4)).sum(1)) > 0.5
    precision, recall = (kept & truth).sum() / kept.sum(), (kept & truth).sum() / truth.sum()
    assert precision > 0.95 and recall > 0.95 and abs(model.share - share) < 0.01
    assert defects.LabelModel(4).fit(np.zeros(0, dtype=int), np.zeros(0)).posterior(np.zeros(0, dtype=int)).size == 0
    assert 0.2 < defects.cutoff(np.array([0.1, 0.9, 0.95, 0.05]), np.array([False, True, True, False])) < 0.8 and defects.cutoff(np.zeros(0), np.zeros(0, dtype=bool)) == 0.5
