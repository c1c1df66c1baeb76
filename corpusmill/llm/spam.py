"""Keyword-stuffed and link-list pages.

Each page gets five features: link density, share of function words, variety and entropy of its words, and the share of its most
frequent content words. For each language the centre and the covariance of the features are estimated robustly over all of its
pages: from medians and median deviations the pages near the centre are taken, and their moments twice reweighted by the
distance they give. A page is flagged when its squared Mahalanobis distance is beyond the 0.99 quantile and it lies out in
spam-directed directions. An exact check of the flagged pages follows: more than half of the words have to stand in lists of links,
tags, menu entries or repeated keywords. Only flagged pages are taken apart for it, in the same pass that flags them.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .language import FUNCTION_WORDS, LANGUAGES_OF as _LANGUAGES_OF
from .mixing import language_code

#: Features and the sign in which each points to spam.
FEATURES = {"links": 1, "function": -1, "variety": -1, "entropy": -1, "keyword": 1}
#: Features that need no function words: whether a whole language lies spam-ward is judged by these.
FREE = ("links", "variety", "entropy")
#: Least scales, so that a feature that is the same on most pages doesn't get a scale of zero.
FLOORS = {"links": 0.02, "function": 0.03, "variety": 0.03, "entropy": 0.03, "keyword": 0.03}
#: The 0.99 and 0.975 quantiles of chi-square with five degrees of freedom.
DISTANCE, NEAR = 15.086, 12.833
#: How far out a page has to lie in the spam direction: the mean over the features of the deviation in scales, signed towards spam.
DIRECTION = 2.0
#: Centre and scale of each feature over ordinary prose of any length, for a table whose pages are mostly spam.
PROSE = {"links": (0.0, 0.03), "function": (0.42, 0.06), "variety": (0.9, 0.06), "entropy": (0.86, 0.07), "keyword": (0.09, 0.05)}
#: Pages' worth of the moments of all languages that each language's own are mixed with, so that a language of few pages has some.
PRIOR = 50

_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\"'\]]+", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.I | re.S)
_MARKDOWN = re.compile(r"\[([^\[\]]*)\]\(\s*[^()\s]*\s*\)")
_TAGS = re.compile(r"<[^<>]{0,300}>")
_HASH = re.compile(r"(?<!\w)#[\w-]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CODE = re.compile(r"^\s*(?:select|from|where|and|or|inner|left|join|group|order|having|limit|insert|create|update|delete|with|on|values|set)\b.*|.*\bselect\b.*\bfrom\b.*", re.I | re.S)
_BARS = re.compile(r"\s*[|·•»›>/]\s+|\s+[-–—:~]\s+")
_SIGNS = re.compile(r"[.!?:;=|]|\d{3}")
_LABELLED = re.compile(r"^[\s*\-•]*([\w \-]{1,40}):\s")
_LETTERS = re.compile(r"[^\W\d_]+")
_ALL_WORDS = frozenset(_LANGUAGES_OF)
_ALL = frozenset().union(*FUNCTION_WORDS.values()) - {"a", "i", "e", "o", "me", "us"}
_SETS = {k: v for k, v in FUNCTION_WORDS.items()}


def _own(words: list[str]) -> frozenset[str]:
    """The function words of the page's language: of the language whose function words are most often met."""
    counts = Counter(words)
    best, most = _ALL, 0
    for known in _SETS.values():
        n = sum(c for w, c in counts.items() if w in known)
        if n > most:
            best, most = known, n
    return best


def _menus(segments: list[tuple[list[str], int, int, str]], plain: list[bool], code: list[bool]) -> list[bool]:
    """Which segments are menu entries: a line of six short entries at least between bars, dots or slashes, or six short lines in a row. Cells of numbers are none."""
    out = []
    short = []
    for (w, _, _, clean), sentence, is_code in zip(segments, plain, code, strict=True):
        entries = [e for e in _BARS.split(clean) if e.strip()]
        texts = [e for e in entries if _WORD.search(e)]
        free = not sentence and not is_code
        out.append(free and len(texts) >= 6 and len(texts) >= 0.8 * len(entries) and len(w) <= 3.5 * len(texts))
        short.append(free and 0 < len(w) <= 3 and not _SIGNS.search(clean))
    run = 0
    for i, s in enumerate([*short, False]):
        if s:
            run += 1
            continue
        if run >= 6:
            out[i - run : i] = [True] * run
        run = 0
    return out


def _sentence(words: list[str], text: str, known: frozenset[str]) -> bool:
    """Whether words read as a sentence: four at least, a fifth function words; without a closing sign more and different ones."""
    if len(words) < 4:
        return False
    functions = [x for x in words if x in known]
    if len(functions) < 0.15 * len(words):
        return False
    if text.rstrip(" \t\r)\"'*_").endswith((".", "!", "?", ":", ";")):
        return len(functions) >= 2 or (len(words) <= 5 and len(functions) == 1)
    return len(set(functions)) >= 3 and len(functions) >= 0.25 * len(words)


def _stuffed(sentences: list[list[str]], known: frozenset[str]) -> tuple[set[str], set[str]]:
    """The repeated keywords of a page's sentences: (words said twice within a sentence, in two sentences at least; words said over and over on the page).

    A sentence of 60 words or more counts as two for a word that makes 6 % of it, and says it five times. Over the page a word counts
    that makes a tenth of all words, or both words of a pair that makes a sixth and stands in three different sentences; either has to
    come five times.
    """
    content = lambda x: x not in known and x not in _ALL and len(x) > 2
    twice: Counter[str] = Counter()
    for w in sentences:
        if len(set(w)) < len(w):
            for x, n in Counter(w).items():
                if n >= 2 and content(x):
                    if len(w) < 60:
                        twice[x] += 1
                    elif n >= max(5, 0.06 * len(w)):
                        twice[x] += 2
    singles = Counter(x for w in sentences for x in w)
    total = singles.total()
    often = {x for x, n in singles.items() if n >= max(5, total / 12) and content(x)}  # a pair can't come more often than its words
    over = {x for x in often if singles[x] >= 0.1 * total}
    if len(often) > 1:
        pairs = Counter(p for w in sentences for p in zip(w, w[1:], strict=False) if p[0] in often and p[1] in often and p[0] != p[1])
        for pair, n in pairs.items():
            if n >= max(5, total / 12) and len({tuple(w) for w in sentences if pair in zip(w, w[1:], strict=False)}) >= 3:
                over.update(pair)
    return {x for x, n in twice.items() if n >= 2}, over


def _explains(text: str, over: set[str]) -> bool:
    """Whether a sentence stands behind a name that is none of the repeated words, as in a list of columns."""
    label = _LABELLED.match(text)
    return bool(label) and not any(x in over for x in _WORD.findall(label[1].lower()))


def spam_share(text: str | None) -> float:
    """The share of a page's words that stand in spam segments. A link or tag counts as one word; null and empty texts have a share of 0."""
    text = text or ""
    if "&" in text:
        text = html.unescape(text)
    if "<a" in text or "<A" in text:
        text = _ANCHOR.sub(r"\n\1 www.link \n", text)
    if "](" in text:
        text = _MARKDOWN.sub(r"\1 www.link ", text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    everything = _WORD.findall(text.lower())
    known = _own(everything)
    segments: list[tuple[list[str], int, int, str]] = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        parts = _SENTENCE.split(line.strip()) if len(line) > 40 else [line]
        for part in parts:
            urls = tags = 0
            clean = part
            if "www." in part or "://" in part:
                clean, urls = _URL.subn(" ", clean)
            if "#" in part:
                clean, tags = _HASH.subn(" ", clean)
            words = _WORD.findall(clean.lower())
            if not words and not urls and not tags:
                continue
            if not words and segments and urls and part is not parts[0]:  # a link behind a sentence belongs to it
                w, u, t, c = segments[-1]
                segments[-1] = (w, u + urls, t, c)
            else:
                segments.append((words, urls, tags, clean))
    total = sum(len(w) + u + t for w, u, t, _ in segments)
    if not total:
        return 0.0
    plain: list[bool] = []
    code = [bool(_CODE.match(s[3])) and any(c in s[3] for c in "=<>(*;") for s in segments]
    for (w, _, tags, clean), is_code in zip(segments, code, strict=True):
        sentence = not is_code and tags <= 0.3 * len(w) and (_sentence(w, clean, known) or any(_sentence(w, clean, other) for other in _SETS.values() if other is not known))
        plain.append(sentence)
    stuffed, over = _stuffed([s[0] for s, sentence in zip(segments, plain, strict=True) if sentence], known)
    menu = _menus(segments, plain, code)
    loose: Counter[str] = Counter()
    for (w, *_), sentence, is_code in zip(segments, plain, code, strict=True):
        if not sentence and not is_code:
            loose.update(w)
    n_loose = sum(loose.values())
    repeated = {x for x, n in loose.items() if n >= 3} if n_loose and len(loose) <= 0.6 * n_loose else set()
    spam = 0
    for (w, urls, tags, clean), sentence, is_code, is_menu in zip(segments, plain, code, menu, strict=True):
        size = len(w) + urls + tags
        if sentence:
            keys = sum(x in stuffed for x in w)
            if stuffed and keys >= 0.25 * len(w) or over and sum(x in over for x in w) >= 0.35 * len(w) and not _explains(clean, over):
                spam += size
            elif tags:
                spam += tags
            continue
        if is_code:
            continue
        if urls or tags or is_menu or (repeated and any(x in repeated for x in w)):
            spam += size
    return spam / total


_XLOGX = [0.0] + [c * math.log(c) for c in range(1, 4096)]


def page_features(text: str | None) -> tuple[float, float, float, float, float, int]:
    """(links, function, variety, entropy, keyword, words) of a page in one pass over its words; all zero for texts without words."""
    low = (text or "").lower()
    counts = Counter(_LETTERS.findall(low))
    n = counts.total()
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0
    tags = len(_HASH.findall(low)) if "#" in low else 0
    links = low.count("://") + low.count("www.") - low.count("://www.") + low.count("<a ") + tags
    by_language: dict[str, int] = {}
    for word in counts.keys() & _ALL_WORDS:
        for lang in _LANGUAGES_OF[word]:
            by_language[lang] = by_language.get(lang, 0) + counts[word]
    function = max(by_language.values(), default=0)
    size = max(math.log(n), 1e-9)
    variety = math.log(len(counts)) / size if n > 1 else 1.0
    spread = sum(_XLOGX[c] if c < 4096 else c * math.log(c) for c in counts.values() if c > 1)
    entropy = 1.0 - spread / (n * size) if n > 1 else 1.0
    if function:
        for word in counts.keys() & FUNCTION_WORDS[max(by_language, key=lambda k: (by_language[k], k))]:
            del counts[word]
    return links / (n + links), function / n, variety, entropy, sum(sorted(counts.values(), reverse=True)[:4]) / n, n


def features(documents: DataFrame) -> DataFrame:
    """(lang, five features) of each document with words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([page_features(t) for t in batch["text"]], columns=[*FEATURES, "words"])
            rows.insert(0, "lang", batch["lang"].to_numpy())
            yield rows[rows["words"] > 0].drop(columns="words")

    return spread(documents.filter("doc_id is not null and text is not null").select(language_code(F.col("lang")).alias("lang"), "text")).mapInPandas(run, "lang string, " + ", ".join(f"{f} double" for f in FEATURES))


_TOWARDS = np.array(list(FEATURES.values()), dtype=float)
#: (centre, scale of each feature, inverse covariance) of a language.
Model = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _pick(table: dict[str, np.ndarray], i: int) -> Column:
    """The i-th value of the row's language in a table of a row for each language."""
    return F.element_at(F.create_map(*[F.lit(x) for g, v in table.items() for x in (g, float(v[i]))]), F.col("g"))


def _squared(centre: dict[str, np.ndarray], inverse: dict[str, np.ndarray]) -> Column:
    """The squared distance of a row of features from its language's centre."""
    names = list(FEATURES)
    z = [F.col(f) - _pick(centre, i) for i, f in enumerate(names)]
    terms = [z[i] * z[j] * _pick({g: (m[i, j] * (1 if i == j else 2)).reshape(1) for g, m in inverse.items()}, 0) for i in range(len(names)) for j in range(i, len(names))]
    return reduce(lambda a, b: a + b, terms)


def robust_model(feats: DataFrame) -> Model:
    """Robust centre, scales and inverse covariance of each language and of all pages ("all").

    Start: medians and median deviations; moments of the pages within 2.5 deviations in every feature; two reweightings with the
    pages within the 0.975 quantile of the distance. Moments are mixed with PRIOR pages' worth of those of all languages. A language
    whose median lies spam-ward of that of all pages in what needs no function words (by more than a scale on average) is mostly spam;
    it takes the model of all, and a table that is mostly spam that of ordinary prose. Five passes of grouped aggregates over all pages; to the driver go one row for each language and for all.
    """
    names = list(FEATURES)
    p = len(names)
    each = feats.withColumn("g", F.explode(F.array(F.col("lang"), F.lit("all"))))
    rows = lambda df, *aggs: {r["g"]: r for r in df.groupBy("g").agg(*aggs).collect()}
    centre = {g: np.array([r[f] for f in names], dtype=float) for g, r in rows(each, *[F.percentile_approx(f, 0.5, 10000).alias(f) for f in names]).items()}
    if not centre:
        return {}
    spread = rows(each, *[F.percentile_approx(F.abs(F.col(f) - _pick(centre, i)), 0.5, 10000).alias(f) for i, f in enumerate(names)])
    scale = {g: np.array([max(FLOORS[f], 1.4826 * r[f]) for f in names]) for g, r in spread.items()}
    middle, floor = centre, np.diag([FLOORS[f] ** 2 / 4 for f in names])
    near = reduce(lambda a, b: a & b, [F.abs(F.col(f) - _pick(centre, i)) <= _pick(scale, i) * 2.5 for i, f in enumerate(names)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    # what truncation takes from the variance of a normal feature within 2.5 deviations, and of all within the 0.975 quantile
    for part in (0.9112, 0.94, 0.94):
        # sums around the middle, which keeps them small
        z = [F.col(f) - _pick(middle, i) for i, f in enumerate(names)]
        sums = rows(each.filter(near), F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(z)], *[F.sum(z[i] * z[j]).alias(f"q{i}_{j}") for i, j in pairs])
        n = {g: r["n"] for g, r in sums.items()}
        mean = {g: np.array([r[f"s{i}"] for i in range(p)]) / r["n"] for g, r in sums.items()}
        cov: dict[str, np.ndarray] = {}
        for g, r in sums.items():
            q = np.zeros((p, p))
            for i, j in pairs:
                q[i, j] = q[j, i] = r[f"q{i}_{j}"] / r["n"]
            cov[g] = (q - np.outer(mean[g], mean[g])) / part + floor
        of_all = (middle["all"] + mean["all"], cov["all"]) if "all" in mean else (middle["all"], np.diag(scale["all"] ** 2))
        new, inverse = {}, {}
        for g in centre:
            w = n.get(g, 0) / (n.get(g, 0) + PRIOR) if g != "all" else 1.0
            own = middle[g] + mean.get(g, 0)
            new[g] = w * own + (1 - w) * of_all[0]
            inverse[g] = np.linalg.inv(w * cov.get(g, of_all[1]) + (1 - w) * of_all[1] + w * (1 - w) * np.outer(own - of_all[0], own - of_all[0]))
        middle = new
        near = _squared(middle, inverse) <= NEAR
    free = [names.index(f) for f in FREE]
    model: Model = {}
    mean, width = (np.array([PROSE[f][k] for f in names]) for k in (0, 1))
    if float(((centre["all"] - mean) / width * _TOWARDS).mean()) > 2.5:
        return dict.fromkeys(centre, (mean, width, np.diag(1 / width**2)))
    for g in centre:
        ward = float((((centre[g] - centre["all"]) / scale["all"]) * _TOWARDS)[free].mean())
        source = "all" if ward > 1 else g
        model[g] = (middle[source], np.sqrt(np.diag(np.linalg.inv(inverse[source]))), inverse[source])
    return model


def score(model: Model, langs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, directions) of the features of pages, a row each.

    The direction is the mean deviation in scales, positive towards spam; a feature on the other side takes away one scale at most, so that
    much of it (function words between keywords) hides nothing.
    """
    far, ward = np.zeros(len(values)), np.zeros(len(values))
    for lang in np.unique(langs):
        at = langs == lang
        centre, scale, inverse = model.get(str(lang)) or model["all"]
        z = values[at] - centre
        far[at] = np.einsum("ij,jk,ik->i", z, inverse, z)
        ward[at] = np.maximum(z / scale * _TOWARDS, -1.0).mean(1)
    return far, ward


def flagged_pages(documents: DataFrame, direction: float = DIRECTION) -> DataFrame:
    """(doc_id, lang, distance, direction, spam) of the pages that lie out of their language's pages towards spam, with the exact share of their spam words.

    Two passes over the texts (features; flagging and checking), no shuffle of texts. Pages without words are none.
    """
    model = robust_model(cut_lineage(features(documents)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([page_features(t) for t in batch["text"]], dtype=float).reshape(-1, len(FEATURES) + 1)
            batch["distance"], batch["direction"] = score(model, batch["lang"].to_numpy(dtype=str), found[:, :-1])
            out = batch[(found[:, -1] > 0) & (batch["distance"] > DISTANCE) & (batch["direction"] > direction)].copy()
            out["spam"] = [spam_share(t) for t in out["text"]]
            yield out[["doc_id", "lang", "distance", "direction", "spam"]]

    ready = documents.filter("doc_id is not null and text is not null").select("doc_id", language_code(F.col("lang")).alias("lang"), "text")
    return spread(ready).mapInPandas(run, "doc_id bigint, lang string, distance double, direction double, spam double")


def spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, distance, direction, spam): flagged pages of which more than half of the words are spam. An id that comes twice is listed for each of its rows."""
    return flagged_pages(documents).filter("spam > 0.5")
