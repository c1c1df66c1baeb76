"""Broken prompt and response pairs.

For each defect several noisy labelling functions vote on an answer; the votes are bits of a small mask. None of them is the
definition: each looks at one sign. A label model of each defect (a naive Bayes mixture with a hidden true label) is fitted by
expectation-maximization to the counts of the masks over all answers. Of each defect the cutoff of the posterior is the one
that is best on answers labelled by hand; an answer keeps every defect whose posterior exceeds its cutoff.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .labelled import ANSWERS
from .language import foreign_script, hits, language

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Labelling functions of each defect; bit i of a mask is function i.
FUNCTIONS = {
    "empty": ("nothing but marks", "very short", "nothing behind the reasoning"),
    "truncated": ("finish reason length", "no whole answer, and none is withheld", "open block", "ends inside a sentence", "query breaks off"),
    "refusal": ("phrase that declines", "no answer and no copy", "apology or advice", "short closed text without an answer"),
    "copy": ("question with little else", "no answer", "words of the question", "text of the prompt"),
    "language": ("function words of another language", "none of the question's function words", "another script or clear lead", "hardly any of the question's function words"),
}
BITS = 5
#: Letters and digits that may stand beside a repeated question as its lead-in; characters of a short text.
LEAD_IN, SHORT = 40, 300

_TAG = re.compile(r"<[^<>]{0,80}>")
_FENCE = re.compile(r"```[\w+-]*")
_THINK = re.compile(r"<think>.*?</think>", re.S)
_BLOCK = re.compile(r"```[\w+-]*[ \t]*\n?(.*?)```", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_NORM = re.compile(r"[\W_]+")
_ALNUM = re.compile(r"[^\W_]")
_SELECT = re.compile(r"\bselect\b", re.I)
_DANGLING = re.compile(r"(?:\b(?:select|distinct|from|where|and|or|by|join|inner|left|outer|on|as|in|having|limit|group|order|between|like|not|with|is|union|case|when|then|else)|[=<>+\-/(,.]|(?<!\()\*)$", re.I)
_FROM = re.compile(r"[\s)\]\"`*]from\s*[\w(\"`\[]", re.I)
_WITH = re.compile(r"\bwith\s+\w+\s+as\s*\($", re.I)
_CODE = re.compile(r"```|\{|\b(?:select|with\s+\w+\s+as)\s", re.I)
_VALUE = re.compile(r"answer[\"'*`\s]*[:=]\s*[\"'*`\s(]*[-−–+]?\s*[$€£]?\s*(?:\d|yes\b|no\b|true\b|false\b|\{)", re.I)
_BARE = re.compile(r"^[\s\"'*`(]*[-−–+]?\s*[$€£]?\s*(?:\d[\d.,]*\s*%?|yes|no)[\s\"'*`).]*$", re.I)
#: Phrases that decline, by language; phrases that only mention a limit ("can't be null") are not among them.
DECLINES = re.compile(
    r"\b(?:can(?:no|')t|cannot|can not|won't|will not|unable to|not able to|not possible for me to|refuse to|decline to|not going to)\s+(?:\w+\s+){0,2}?(?:help|assist|answer|respond|provide|produce|continue|comply|complete|fulfil|fulfill|share|write|generate|discuss|support|do (?:this|that))\b"
    r"|\b(?:must|have to|need to|will) decline\b|\brather not\b|\bagainst my\b|\bmy (?:rules|guidelines|policy|policies|instructions)\b|\bfalls? outside\b|\b(?:not|am|be) (?:allowed|permitted) to\b|\boutside (?:of )?what i\b"
    r"|\bno (?:\w+ )?(?:answer|query|request|question|response|data|result|figure|sql)s? (?:will|can) be (?:provided|given)\b|\bunanswered\b|\btalk about something else\b|\bonly a (?:\w+ )?(?:specialist|expert|professional|lawyer|adviser|advisor) should\b|\binappropriate to\b|\bno way for me\b|\bfeel comfortable\b|\bunable to (?:assist|help)\b"
    r"|\baußerhalb meiner\b|\bkeine auskunft\b|\bdarf (?:ich|das) (?:\w+ )?nicht\b|\bdarf ich nicht\b|\bkann ich (?:\w+ ){0,3}nicht\b|\bich kann (?:\w+ ){0,4}nicht (?:\w+ )?(?:helfen|beantworten|antworten|weiterhelfen)\b|\bnicht (?:helfen|beantworten|weiterhelfen)\b|\babzulehnen\b|\bablehnen\b|\blehne ich\b|\bmöchte (?:ich )?(?:\w+ ){0,3}(?:nicht|keine)\b|\bnicht erlaubt\b"
    r"|\bno (?:puedo|podemos|me es posible|es posible) (?:\w+ )?(?:ayudar|responder|contestar|atender|dar|seguir|continuar|escribir)\w*|\bno tengo (?:permitido|permiso)\b|\bprefiero no\b|\bfuera de (?:mis|lo que)\b|\bdebo (?:rechazar|declinar)\b|\bno (?:voy|vamos) a (?:responder|contestar)\b|\bno (?:está|estoy) (?:permitido|autorizado)\b|\bme niego\b"
    r"|\bne (?:peux|pouvons|puis) pas (?:\w+ ){0,3}(?:aider|répondre|fournir|continuer|écrire|donner|traiter)\b|\bpréfère ne pas\b|\bpas autorisée?\b|\bn'ai pas le droit\b|\bdois (?:refuser|décliner)\b|\bdépasse (?:mes|ce que)\b|\brefuse de\b|\bhors de mes\b|\bne me permet\w* pas\b|\bimpossible (?:pour moi )?de (?:vous )?(?:aider|répondre)\b|\bsuis pas en mesure\b"
    r"|\bnon posso (?:\w+ )?(?:aiutar\w*|rispondere|fornire|continuare)\b|\bpreferisco non\b|\bdevo rifiutare\b|\bnon mi è (?:permesso|consentito)\b|\bnão posso (?:\w+ )?(?:ajudar|responder)\b|\bkan ik (?:\w+ )?niet\b",
    re.I,
)
_APOLOGY = re.compile(r"\b(?:sorry|apolog\w+|regret\w*|unfortunately|leider|leid|lo siento|lamento|désolée?|malheureusement|mi dispiace|rephras\w+|professional|specialist|adviser|something else|sensitive|guidelines)\b", re.I)


@lru_cache(maxsize=4096)
def asked(question: str | None) -> tuple[str, frozenset[str], str | None]:
    """(letters and digits, words, language) of a question."""
    text = question or ""
    words = frozenset(_WORD.findall(text.lower()))
    return _NORM.sub("", text.lower()), words, language(text, set(words))


def query_ends(sql: str) -> bool:
    """Whether a query is whole: it selects, its quotes and brackets are closed and it doesn't end in a word or sign that needs more."""
    sql = sql.strip().rstrip("; \n\t\r`")
    if len(sql) < 10 or not _SELECT.search(sql) or sql.count("(") != sql.count(")") or sql.count("[") != sql.count("]"):
        return False
    return sql.count("'") % 2 == 0 and sql.count('"') % 2 == 0 and bool(_FROM.search(sql)) and not _DANGLING.search(sql[-24:])


def _json_answer(text: str) -> bool | None:
    """Whether an object holds a whole query or answer; None when there is no object."""
    at = text.find("{")
    if at < 0:
        return None
    end = text.rfind("}")
    try:
        value = json.loads(text[at : end + 1])
    except (ValueError, RecursionError):
        return None if end > at else False
    if not isinstance(value, dict):
        return None
    low = {str(k).lower(): v for k, v in value.items()}
    if "sql" in low or "query" in low:
        return query_ends(str(low.get("sql", low.get("query"))))
    return low.get("answer") not in (None, "") if "answer" in low else None


def whole_answer(body: str) -> bool:
    """Whether a text (without its reasoning) holds a complete query or value."""
    blocks = _BLOCK.findall(body)
    for block in blocks:
        inner = block.strip()
        if (found := _json_answer(inner)) is not None:
            if found:
                return True
        elif query_ends(inner) or _VALUE.search(inner) or _BARE.match(inner):
            return True
    if body.count("```") % 2:
        return False
    rest = _BLOCK.sub(" ", body) if blocks else body
    if "{" in rest and (found := _json_answer(rest)) is not None:
        return found
    if m := _VALUE.search(rest):
        return not rest[m.start() :].rstrip().endswith((",", ":", "=", "|", "{"))
    if m := _SELECT.search(rest):
        opened = _WITH.search(rest[: m.start()].rstrip()) if "(" in rest[max(0, m.start() - 3) : m.start()] else None
        return query_ends(rest[opened.start() if opened else m.start() :])
    return bool(_BARE.match(rest))


def spoken(text: str) -> str:
    """The prose of an answer: what stands before its code and behind its last closed block."""
    code = _CODE.search(text)
    if not code:
        return text.replace("<think>", " ").replace("</think>", " ")
    after = text.rsplit("```", 1)[-1] if text.count("```") % 2 == 0 and "```" in text else ""
    return f"{text[: code.start()]} {after}".replace("<think>", " ").replace("</think>", " ")


def votes(text: str | None, finish: str | None, question: str | None, prompt: str = "", context: str | None = None) -> tuple[int, int, int, int, int]:
    """The masks of the five defects. prompt: the letters and digits of the messages, where they are known; context: a text whose language counts where the question's isn't clear."""
    text = text or ""
    if "&" in text:
        text = html.unescape(text)
    empty0 = not text[:1].isalnum() and not _ALNUM.search(_FENCE.sub(" ", _TAG.sub(" ", text)))
    body, behind = text, empty0
    open_think = False
    if "think>" in text:
        body = _THINK.sub(" ", text)
        if "<think>" in body:
            open_think, body = True, body[: body.index("<think>")]
        body = body.rsplit("</think>", 1)[-1]
        behind = empty0 or not _ALNUM.search(_FENCE.sub(" ", _TAG.sub(" ", body)))
    stripped = body.strip()
    empty = empty0 | (len(text.strip()) <= 3) << 1 | behind << 2
    if empty0:
        return empty, int(finish == "length") << 1, 0, 0, 0

    answer = not open_think and whole_answer(stripped)
    norm_q, words_q, lang_q = asked(question)
    held = in_prompt = like = False
    if not answer and not open_think:
        norm = _NORM.sub("", stripped.lower())
        if norm_q and norm:
            rest = norm.replace(norm_q, "")
            held = len(rest) < len(norm) and (len(rest) <= LEAD_IN or "createtable" in rest or "reportpage" in rest or len(prompt) > 0 and rest in prompt)
            words = set(_WORD.findall(stripped.lower()))
            like = len(words) >= 4 and len(words & words_q) >= 0.9 * len(words) and len(words & words_q) >= 0.6 * len(words_q)
        in_prompt = len(norm) >= 20 and norm in prompt
    again = held or like or in_prompt
    copy = held | (not answer) << 1 | like << 2 | in_prompt << 3

    bare = not answer and not again and not open_think
    closed = stripped.endswith((".", "!", "?", "。"))
    declines = bare and bool(DECLINES.search(stripped.replace("’", "'")))
    sorry = bare and bool(_APOLOGY.search(stripped))
    refusal = declines | bare << 1 | sorry << 2 | (bare and closed and len(stripped) < SHORT and "```" not in stripped) << 3

    withheld = again or declines or sorry and closed
    opened = open_think or text.count("```") % 2 == 1
    breaks = not answer and not again and bool(_SELECT.search(stripped))
    truncated = (finish == "length") | (not answer and not withheld) << 1 | opened << 2 | (not answer and not withheld and not closed) << 3 | breaks << 4

    lead = none = clear = few = False
    prose = spoken(text)
    foreign = foreign_script(prose)
    lang_q = lang_q or asked(context)[2]
    words = set(_WORD.findall(prose.lower()))
    if lang_q != "other" and foreign >= 4 and foreign * 2 > sum(map(len, words)):
        # a question in Latin letters whose language isn't clear is still in none of the other scripts
        lead = none = clear = few = bool(lang_q) or bool(words_q)
    elif lang_q and len(words) >= 3:
        found = hits(words)
        own = found.get(lang_q, 0)
        best = max(n for k, n in found.items() if k != lang_q)
        free = len(words - words_q)
        lead, none, clear, few = best >= 2 and best - own >= 2, own == 0 and free >= 4, best - own >= 4, free >= 4 and own < 0.1 * free
    return empty, truncated, refusal, copy, lead | none << 1 | clear << 2 | few << 3


def _vote_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prompts = [""] * len(batch)
        if "prompt" in batch:
            prompts = [_NORM.sub("", p.lower()) if p else "" for p in batch["prompt"]]
        rows = [votes(*x) for x in zip(batch["text"], batch["finish"], batch["question"], prompts, batch["context"], strict=True)]
        masks = np.array([sum(m << (BITS * i) for i, m in enumerate(r)) for r in rows], dtype=np.int64)
        yield pd.DataFrame({"origin": batch["origin"], "id": batch["id"], "sample": batch["sample"], "votes": masks})


VOTES = "origin string, id string, sample int, votes bigint"


def generation_votes(generations: DataFrame, sql_items: DataFrame, qa_items: DataFrame) -> DataFrame:
    """Votes on each choice of each generation. Rows without choices give none; without a known question the copy and language functions don't vote."""
    of = lambda df, more: df.select("id", F.struct("question", (F.col(more) if more in df.columns else F.lit(None).cast("string")).alias("context")).alias("q")).filter("id is not null and q.question is not null")
    questions = of(sql_items, "evidence").union(of(qa_items, "evidence")).groupBy("id").agg(F.min("q").alias("q"))
    rows = generations.filter("id is not null and size(choices) > 0").select("id", F.arrays_zip(F.col("choices.content").alias("text"), F.col("choices.finish_reason").alias("finish")).alias("c"))
    joined = rows.join(questions, "id", "left").select("id", "q", F.posexplode("c").alias("sample", "c"))
    ready = joined.select(F.lit("generations").alias("origin"), "id", "sample", F.col("c.text").alias("text"), F.col("c.finish").alias("finish"), "q.question", "q.context")
    return ready.mapInPandas(_vote_batches, VOTES)


def record_votes(records: DataFrame) -> DataFrame:
    """Votes on each record's response; the question is taken from the last user message."""
    content = F.coalesce(F.try_element_at(F.filter("messages", lambda m: m.role == "user"), F.lit(-1)).content, F.lit(""))
    marked = F.regexp_extract(content, r"(?is)(?:^|\n)[ \t]*(?:question|q)[ \t]*:\s*(.*?)(?:\n[ \t]*\n|\n[ \t]*[A-Z]\w*:|$)", 1)
    question = F.when(marked != "", marked).otherwise(content)
    ready = records.filter("id is not null").select(F.lit("records").alias("origin"), "id", F.col("sample").cast("int").alias("sample"), F.col("response").alias("text"), F.lit(None).cast("string").alias("finish"), question.alias("question"), content.alias("prompt"), content.alias("context"))
    return ready.mapInPandas(_vote_batches, VOTES)


#: What a function's rates are taken to be before any answer is seen, and how many defective and sound answers that is worth.
HIT, FALSE, SHARE, WORTH = 0.7, 0.02, 0.03, (5.0, 200.0)


class LabelModel:
    """Rates of a defect's functions on defective (hit) and sound (false) answers, and the share of defective ones."""

    def __init__(self, functions: int) -> None:
        self.hit, self.false, self.share = np.full(functions, HIT), np.full(functions, FALSE), SHARE

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """The probability of the defect for each mask, also for masks that no answer had."""
        bits = (np.asarray(masks, dtype=np.int64)[:, None] >> np.arange(len(self.hit))) & 1
        yes = np.log(self.share) + (bits * np.log(self.hit) + (1 - bits) * np.log1p(-self.hit)).sum(1)
        no = np.log1p(-self.share) + (bits * np.log(self.false) + (1 - bits) * np.log1p(-self.false)).sum(1)
        return 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))

    def fit(self, masks: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        """Expectation-maximization over the counts of the masks; no function is set apart from the others."""
        bits = (np.asarray(masks, dtype=np.int64)[:, None] >> np.arange(len(self.hit))) & 1
        few, many = WORTH
        for _ in range(rounds if len(masks) else 0):
            post = self.posterior(masks)
            a, b = counts * post, counts * (1 - post)
            self.hit = np.clip(((a[:, None] * bits).sum(0) + few * HIT) / (a.sum() + few), 1e-4, 1 - 1e-4)
            self.false = np.clip(((b[:, None] * bits).sum(0) + many * FALSE) / (b.sum() + many), 1e-5, 1 - 1e-5)
            self.share = float(np.clip((a.sum() + few) / (counts.sum() + few / SHARE), 1e-5, 0.5))
        return self


def cutoff(post: np.ndarray, truth: np.ndarray) -> float:
    """The posterior cutoff with the best F1 on labelled answers, in the middle (by log-odds) of the widest range that reaches it."""
    odds = np.log(np.clip(post, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(post, 1e-12, 1 - 1e-12))
    edges = np.unique(odds)
    if not len(edges):
        return 0.5
    best, at = (-1.0, -1.0), 0.0
    for low, high in zip([edges[0] - 2, *edges], [*edges, edges[-1] + 2], strict=True):
        kept = odds >= high
        f1 = 2 * float((kept & truth).sum()) / max(1.0, float(kept.sum() + truth.sum()))
        if (round(f1, 12), high - low) > best:
            best, at = (round(f1, 12), high - low), (low + high) / 2
    return float(1 / (1 + np.exp(-at)))


def label_models(voted: DataFrame) -> dict[str, tuple[LabelModel, float, list[int]]]:
    """For each defect its fitted model, its cutoff and the masks that occur. At most 5 x 32 rows go to the driver."""
    parts = F.array(*[F.struct(F.lit(d).alias("defect"), F.shiftright("votes", BITS * i).bitwiseAND(F.lit(31)).alias("mask")) for i, d in enumerate(DEFECTS)])
    rows = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(parts).alias("p")).groupBy("p.defect", "p.mask").agg(F.sum("n").alias("n")).collect()
    by_hand = [votes(text, finish, question, prompt) for text, finish, question, prompt, _ in ANSWERS]
    models = {}
    for i, d in enumerate(DEFECTS):
        own = sorted((r["mask"], r["n"]) for r in rows if r["defect"] == d)
        model = LabelModel(len(FUNCTIONS[d])).fit(np.array([m for m, _ in own], dtype=np.int64), np.array([n for _, n in own], dtype=float))
        at = cutoff(model.posterior(np.array([v[i] for v in by_hand])), np.array([d in found for *_, found in ANSWERS]))
        models[d] = (model, at, [m for m, _ in own])
    return models


def defect_labels(generations: DataFrame, records: DataFrame, sql_items: DataFrame, qa_items: DataFrame) -> DataFrame:
    """(origin, id, sample, defect, place, posterior): every defect of every answer, several for one answer if so. A row that comes twice counts once."""
    voted = cut_lineage(generation_votes(generations, sql_items, qa_items).unionByName(record_votes(records)))
    kept: dict[str, dict[int, float]] = {}
    for d, (model, at, masks) in label_models(voted).items():
        kept[d] = {m: float(p) for m, p in zip(masks, model.posterior(np.array(masks, dtype=np.int64)), strict=True) if p > at} if masks else {}
    labels = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(d).alias("defect"),
                F.element_at(F.create_map(*[F.lit(x) for m, p in [*kept[d].items(), (-1, 0.0)] for x in (m, p)]), F.shiftright("votes", BITS * i).bitwiseAND(F.lit(31)).cast("int")).alias("posterior"),
            )
            for i, d in enumerate(DEFECTS)
        ]
    )
    some = voted.filter(F.col("votes") != 0).select("origin", "id", "sample", F.explode(F.filter(labels, lambda x: x.posterior.isNotNull())).alias("l"))
    return some.groupBy("origin", "id", "sample", "l.place", "l.defect").agg(F.max("l.posterior").alias("posterior"))


def first_defects(labels: DataFrame) -> DataFrame:
    """(origin, id, sample, defect): of each answer the first defect in the order of DEFECTS that the model keeps."""
    return labels.groupBy("origin", "id", "sample").agg(F.min_by("defect", "place").alias("defect"))
