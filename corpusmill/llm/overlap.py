"""Same or near-same records across splits, by content-defined chunks.

A record is normalised to words and numbers. A rolling hash over the last words cuts the words into chunks, so that a change
moves only the cuts around it. Two records can be the same question only if their numbers are the same, so the digest of a chunk
covers the record's numbers as well, and training texts whose numbers no evaluation text has are left out when they are read, by a
bitmap of the evaluation side's numbers. Digests are joined across the splits and the lengths of the shared chunks summed to the
overlap fraction of the evaluation record; pairs below the least fraction are none. Of an evaluation text only the rarest
chunks are joined, as many as a pair of that fraction must share one of. The pairs are then compared word by word (exact check).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .names import database_name

_HIDDEN = re.compile("[​-‏⁠﻿­]")
_TOKEN = re.compile(r"\d{1,3}(?:[, '’]\d{3})+(?:\.\d+)?(?![\d])|\d{1,3}(?:\.\d{3}){2,}|\d+[.,]\d+|\d+|[^\W\d_]+")
_NUMBER = re.compile(r"\d{1,3}(?:[, '’]\d{3})+(?:\.\d+)?(?![\d])|\d{1,3}(?:\.\d{3}){2,}|\d+[.,]\d+|\d+")
_SQL_WORD = re.compile(r"'((?:[^']|'')*)'|([A-Za-z_][A-Za-z_0-9]*)")
_CREATE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?(\w+)[`\"\]]?\s*\(([^)]*)\)", re.I)
_LABEL = re.compile(r"^[ \t]*([A-Z][\w ]{0,30}):[ \t]*", re.M)
_MARK = re.compile(r"(?:^|\n)[ \t]*(?:question|q)[ \t]*:", re.I)
#: Reserved words of SQL that name no table or column.
RESERVED = frozenset(
    "all and as asc avg between by case cast count create cross desc distinct else end except exists from full group having in inner integer intersect into is join key left like limit max min not null offset on or order outer over partition primary real right round select substr sum table text then union using when where with".split()
)


def number(text: str) -> str:
    """One spelling of a number: no separators, no leading zeros, no zeros behind the decimals."""
    text = re.sub(r"(?<=\d)[, '’](?=\d{3}(?!\d))", "", text)
    if text.count(".") > 1:
        text = text.replace(".", "")
    whole, _, part = text.replace(",", ".").partition(".")
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    return f"{whole}.{part}" if part else whole


def plain(text: str) -> str:
    """Compatibility forms unified, hidden characters removed, lower case."""
    return text.lower() if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()


def tokens(text: str) -> tuple[list[str], list[str]]:
    """(words, numbers) of a text in order."""
    words: list[str] = []
    numbers: list[str] = []
    for token in _TOKEN.findall(plain(text)):
        if token[0].isdigit():
            numbers.append(number(token))
        else:
            words.append(token)
    return words, numbers


def salt_of(text: str) -> int:
    """A digest of the set of a text's numbers; the same for all texts without numbers."""
    found = _NUMBER.findall(plain(text))
    return _signed(" ".join(sorted({number(n) for n in found})))


@lru_cache(maxsize=65536)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


#: The rolling hash covers so many words, cuts where its value is divisible by DIVISOR (two words a chunk on average), and multiplies by BASE modulo PRIME.
WINDOW, DIVISOR, LONGEST, BASE, PRIME = 2, 2, 6, 1_000_003, (1 << 61) - 1
_OLDEST = pow(BASE, WINDOW, PRIME)


def chunks(words: list[str], divisor: int = DIVISOR, longest: int = LONGEST) -> list[list[str]]:
    """The words cut behind each word at which the rolling hash of the last WINDOW words is divisible, or when a chunk is long.

    The hash takes a word in and the one WINDOW words before out, so a cut depends on nothing farther back.
    """
    out: list[list[str]] = []
    part: list[str] = []
    window: deque[int] = deque()
    rolling = 0
    for word in words:
        h = _word_hash(word)
        window.append(h)
        rolling = (rolling * BASE + h) % PRIME
        if len(window) > WINDOW:
            rolling = (rolling - window.popleft() * _OLDEST) % PRIME
        part.append(word)
        if (rolling >> 7) % divisor == 0 or len(part) >= longest:
            out.append(part)
            part = []
    return out + [part] if part else out


def sql_names(sql: str | None) -> tuple[set[str], set[str]]:
    """(identifiers, words of string literals) of a query, in lower case."""
    identifiers, literals = set(), set()
    for literal, name in _SQL_WORD.findall(sql or ""):
        if name:
            if (low := name.lower()) not in RESERVED:
                identifiers.add(low)
        else:
            literals.update(tokens(literal)[0])
    return identifiers, literals


def keywords(words: list[str], identifiers: set[str], literals: set[str]) -> list[str]:
    """The words of a text that name something: those of literals, and those of identifiers that occur in it as a phrase."""
    found = {w for w in words if w in literals}
    have = set(words)
    joined = f" {' '.join(words)} "
    for name in identifiers:
        parts = [p for p in name.split("_") if p]
        if parts and parts[0] in have and f" {' '.join(parts)} " in joined:
            found.update(parts)
    return sorted(found)


def segments(message: str) -> list[str]:
    """The parts of a message that may be a question.

    Behind each question mark: the block up to the next label, its first paragraph and its first line. What stands outside such blocks:
    the labelled blocks of each paragraph, their lines, sentences, and runs of two and three sentences.
    """
    out: list[str] = []
    outside, last = [], 0
    for m in _MARK.finditer(message):
        begin = len(message) - len(message[m.end() :].lstrip())
        stop = _LABEL.search(message, begin)
        while stop and stop.start() <= begin:
            stop = _LABEL.search(message, stop.end())
        end = stop.start() if stop else len(message)
        block = message[begin:end]
        out += [re.split(r"\n[ \t]*\n", block)[0], block.split("\n")[0], block]
        outside.append(message[last : max(last, m.start())])
        last = max(last, end)
    outside.append(message[last:])
    rest = "\n\n".join(outside)
    for paragraph in re.split(r"\n[ \t]*\n", rest):
        for block in _LABEL.split(_CREATE.sub("\n", paragraph) if _CREATE.search(paragraph) else paragraph):
            lines = block.split("\n")
            sentences = [x for x in re.split(r"(?<=[.?!])\s+", block) if x]
            out += [block, *lines, *sentences]
            out += [" ".join(sentences[i : i + n]) for n in (2, 3) for i in range(len(sentences) - n + 1)]
    return list(dict.fromkeys(x.strip() for x in out if x.strip()))


FEATURES = "side string, doc_id string, text_key binary, words string, names string, chunk array<struct<digest: bigint, size: int>>, size int"
_COLUMNS = ["side", "doc_id", "text_key", "words", "names", "chunk", "size"]
#: Bits of the bitmap of the evaluation side's numbers; 1 << 25 bits are 4 MB at any number of rows.
BITS = 1 << 25


def _signed(data: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _feature(side: str, doc_id: str, text: str, identifiers: set[str], literals: set[str]) -> tuple | None:
    import xxhash

    words, numbers = tokens(text)
    if not words:
        return None
    salt = " ".join(sorted(set(numbers)))
    names = " ".join(keywords(words, identifiers, literals))
    cut: dict[int, int] = {}
    for c in chunks(words):
        digest = _signed(salt + "|" + " ".join(c))
        cut[digest] = cut.get(digest, 0) + sum(map(len, c))
    joined = " ".join(words)
    return side, doc_id, xxhash.xxh128_digest(f"{joined}|{salt}|{names}"), joined, names, [{"digest": d, "size": n} for d, n in cut.items()], sum(cut.values())


def _kept(bitmap: np.ndarray | None, text: str) -> bool:
    """Whether an evaluation text may have the text's numbers."""
    if bitmap is None:
        return True
    bit = salt_of(text) % BITS
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


def _item_features(bitmap: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap()
        for batch in batches:
            rows = (
                _feature(side, doc_id, question, *sql_names(gold))
                for side, doc_id, question, gold in zip(batch["side"], batch["doc_id"], batch["question"], batch["gold_sql"], strict=True)
                if _kept(bits, question)
            )
            yield pd.DataFrame([r for r in rows if r], columns=_COLUMNS)

    return run


def _schema_names(texts: list[str]) -> set[str]:
    """The names of the tables and columns that messages describe, in lower case."""
    names: set[str] = set()
    for text in texts:
        for name, columns in _CREATE.findall(text):
            names.add(name.lower())
            names.update(c.split()[0].lower().strip("`\"[]") for c in columns.split(",") if c.split())
    return names


def _record_features(bitmap: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap()
        for batch in batches:
            rows = []
            for doc_id, messages, response in zip(batch["doc_id"], batch["texts"], batch["response"], strict=True):
                texts = [m for m in (messages if messages is not None else []) if m]
                parts = [p for m in texts for p in segments(m) if _kept(bits, p)]
                if not parts:
                    continue
                known = _schema_names(texts), sql_names(response)[1]
                found = {r[2]: r for p in parts if (r := _feature("train", doc_id, p, *known))}
                rows += found.values()
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def number_bitmap(questions: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits in which those of the questions' numbers are set: at most BITS / 32768 rows of 4 KB go to the driver."""

    @F.pandas_udf("bigint")
    def bit(text: pd.Series) -> pd.Series:
        return text.map(lambda t: salt_of(t) % BITS)

    place = questions.select((bit("question") + 1).alias("b"))  # counted from 1, as bucket 0 is for numbers below
    rows = place.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for bucket, bits in rows:
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def features(sql_items: DataFrame, records: DataFrame) -> DataFrame:
    """Texts of both sides with their chunks: questions of evaluation and train items, and the question-like parts of record messages.

    Null and empty questions and messages give no text; an id that comes twice gives its distinct texts. Training texts whose numbers
    surely no evaluation question has are left out.
    """
    side = F.when(F.col("split").isin("dev", "test"), "eval").when(F.col("split") == "train", "train")
    items = sql_items.select(side.alias("side"), F.col("id").alias("doc_id"), "question", "gold_sql").filter("side is not null and doc_id is not null and question is not null")
    evals = items.filter("side = 'eval'")
    wide = sql_items.sparkSession.sparkContext.broadcast(number_bitmap(evals))  # BITS bits, whatever the tables hold
    asked = F.transform(F.filter("messages", lambda m: m.role.isin("system", "user")), lambda m: m.content)
    recs = records.select(F.col("id").alias("doc_id"), asked.alias("texts"), "response").filter("doc_id is not null and texts is not null")
    nothing, known = (lambda: None), (lambda: wide.value)
    return evals.mapInPandas(_item_features(nothing), FEATURES).unionByName(items.filter("side = 'train'").mapInPandas(_item_features(known), FEATURES)).unionByName(recs.mapInPandas(_record_features(known), FEATURES))


#: Overlap fraction below which a pair isn't the same record.
LEAST = 0.1
#: Pairs of texts that one digest may list by itself; beyond it the digest is met together with words.
DIGEST_PAIRS = 1_000_000


def word_variants(word: Column) -> Column:
    """A word and what is left of it without each one of its letters: two words up to a slip of a letter share one of these."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_union(F.array(word), F.when(F.length(word) > 1, without).otherwise(F.array().cast("array<string>")))


def candidates(texts: DataFrame, least: float = LEAST, digest_pairs: int = DIGEST_PAIRS) -> DataFrame:
    """(eval_key, train_key): distinct texts of the two sides that may share chunks worth the least fraction of the evaluation text.

    Of each evaluation text the chunks are taken from the rarest on, until those left are worth less than the fraction: a pair
    that reaches it shares one of them, so none is lost. A digest that would list more than digest_pairs pairs (the same phrase
    and numbers in very many texts) is met together with words: the same question shares more than half of the evaluation
    text's words up to a slip, so it shares one of the rarer half of them; the words meet by their variants. No pair is lost
    by this either.
    """
    cut = texts.select("side", "text_key", "size", F.explode("chunk").alias("c")).select("side", "text_key", F.col("size").alias("whole"), "c.digest", "c.size")
    left, right = cut.filter("side = 'eval'"), cut.filter("side = 'train'").select(F.col("text_key").alias("train_key"), "digest")
    counts = right.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).join(left.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest")
    rare = Window.partitionBy("eval_key").orderBy(F.col("pairs").desc(), "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the chunks of one text
    # chunks that no training text has are worth nothing, so the others alone have to reach the fraction
    met = left.join(counts.select("digest", (F.col("n") * F.col("m")).alias("pairs")), "digest").select(F.col("text_key").alias("eval_key"), "digest", "size", "whole", "pairs")
    chosen = met.withColumn("rest", F.sum("size").over(rare)).filter(F.col("rest") >= F.col("whole") * least).select("eval_key", "digest", (F.col("pairs") > digest_pairs).alias("hot"))
    plain_ = chosen.filter("not hot").select("eval_key", "digest").join(right, "digest").select("eval_key", "train_key")
    hot = chosen.filter("hot").select("eval_key", "digest")
    split = F.array_distinct(F.split("words", " "))
    asked = hot.join(texts.filter("side = 'eval'").select(F.col("text_key").alias("eval_key"), split.alias("w")), "eval_key").select("eval_key", "digest", F.size("w").alias("n"), F.posexplode("w").alias("place", "word"))
    held = hot.select("digest").distinct().join(right, "digest").join(texts.filter("side = 'train'").select(F.col("text_key").alias("train_key"), split.alias("w")), "train_key")
    held = held.select("train_key", "digest", F.explode("w").alias("word")).select("train_key", "digest", F.explode(word_variants(F.col("word"))).alias("v")).distinct()
    forms = asked.select("eval_key", "digest", "n", "place", F.explode(word_variants(F.col("word"))).alias("v"))
    seen = held.groupBy("digest", "v").agg(F.count(F.lit(1)).alias("m"))
    weight = forms.join(seen, ["digest", "v"], "left").groupBy("eval_key", "digest", "n", "place").agg(F.sum(F.coalesce("m", F.lit(0))).alias("m"))
    rarer = Window.partitionBy("eval_key", "digest").orderBy("m", "place")  # the words of one text
    half = weight.withColumn("r", F.row_number().over(rarer)).filter("r <= ceil(n / 2.0)").select("eval_key", "digest", "place")
    narrow = forms.join(half, ["eval_key", "digest", "place"], "left_semi").join(held, ["digest", "v"]).select("eval_key", "train_key")
    return plain_.unionByName(narrow).distinct()


def _close(a: str, b: str) -> bool:
    """Equal up to one letter changed, added, left out or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 2:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def same_question(words_a: list[str], names_a: list[str], words_b: list[str], names_b: list[str]) -> bool:
    """Whether two texts with the same numbers ask the same: the same names, tables and columns up to a slip of a letter, and more than half of the words.

    names are the words that each side's own SQL or schema confirms. A slip pairs a word of one side only with a word of the
    other side only, unless both are confirmed (height and weight are two columns, not a slip).
    """
    a, b, na, nb = set(words_a), set(words_b), set(names_a), set(names_b)
    only_a, only_b = a - b, b - a
    slips = 0
    for x in sorted(only_a):
        for y in sorted(only_b):
            if not (x in na and y in nb) and _close(x, y):
                only_a.discard(x)
                only_b.discard(y)
                slips += 1
                break
    if only_a & na and only_b & nb or (only_a & na and not _only_repeats(only_a & na, words_a, words_b)) or (only_b & nb and not _only_repeats(only_b & nb, words_b, words_a)):
        return False
    return 2 * (len(a & b) + slips) > max(len(a), len(b))


def _only_repeats(missing: set[str], words: list[str], other: list[str]) -> bool:
    """Whether the missing names stand only in a last clause that the other text leaves out as a whole."""
    first = min(i for i, w in enumerate(words) if w in missing)
    tail = words[first:]
    return len(tail) <= 3 and first > len(words) / 2 and len(other) < len(words)


def overlap_fraction(mine: Column, other: Column, whole: Column) -> Column:
    """The share of an evaluation text's length (whole) that lies in chunks of another text. Repeated chunks count as often as they stand there."""
    there = F.transform(other, lambda c: c.digest)
    return F.aggregate(F.filter(mine, lambda c: F.array_contains(there, c.digest)), F.lit(0), lambda a, c: a + c["size"]) / whole


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [same_question(a.split(), na.split(), b.split(), nb.split()) for a, na, b, nb in zip(batch["e_words"], batch["e_names"], batch["t_words"], batch["t_names"], strict=True)]
        yield batch.loc[keep, ["eval_key", "train_key", "fraction"]]


def cross_split_pairs(sql_items: DataFrame, records: DataFrame, least: float = LEAST, digest_pairs: int = DIGEST_PAIRS) -> DataFrame:
    """(eval_id, train_id, fraction): each evaluation item with each train item or record that holds the same question.

    least: overlap fraction that a pair has to reach. Equal texts are compared once and expanded to their ids at the end; of an
    item with several texts the greatest fraction counts. Empty tables give no rows.
    """
    feats = cut_lineage(features(sql_items, records))
    texts = cut_lineage(feats.groupBy("side", "text_key").agg(*[F.first(c).alias(c) for c in ("words", "names", "chunk", "size")]))
    of = lambda side, key, p: texts.filter(F.col("side") == side).select(F.col("text_key").alias(key), F.col("words").alias(f"{p}_words"), F.col("names").alias(f"{p}_names"), F.col("chunk").alias(f"{p}_chunk"), F.col("size").alias(f"{p}_size"))
    both = candidates(texts, least, digest_pairs).join(of("eval", "eval_key", "e"), "eval_key").join(of("train", "train_key", "t"), "train_key")
    scored = both.withColumn("fraction", overlap_fraction(F.col("e_chunk"), F.col("t_chunk"), F.col("e_size"))).filter(F.col("fraction") >= least)
    checked = scored.select("eval_key", "train_key", "fraction", "e_words", "e_names", "t_words", "t_names").mapInPandas(_verify, "eval_key binary, train_key binary, fraction double")
    members = feats.select("side", "text_key", "doc_id").distinct()
    evals = members.filter("side = 'eval'").select(F.col("text_key").alias("eval_key"), F.col("doc_id").alias("eval_id"))
    trains = members.filter("side = 'train'").select(F.col("text_key").alias("train_key"), F.col("doc_id").alias("train_id"))
    return checked.join(evals, "eval_key").join(trains, "train_key").groupBy("eval_id", "train_id").agg(F.max("fraction").alias("fraction"))


def overlap_report(sql_items: DataFrame, records: DataFrame) -> DataFrame:
    """(split, source, items, leaked, in_items, in_records): per evaluation split and database the items, those found in training, and the pairs by kind."""
    pairs = cross_split_pairs(sql_items, records)
    by_item = pairs.groupBy("eval_id").agg(F.count_if(~F.col("train_id").contains("#")).alias("in_items"), F.count_if(F.col("train_id").contains("#")).alias("in_records"))
    evals = sql_items.filter(F.col("split").isin("dev", "test") & F.col("id").isNotNull()).groupBy("id").agg(F.min("split").alias("split"), F.coalesce(F.min(database_name(F.col("db_id"))), F.lit("")).alias("source"))
    joined = evals.join(by_item, F.col("id") == F.col("eval_id"), "left")
    return joined.groupBy("split", "source").agg(F.count(F.lit(1)).alias("items"), F.count("eval_id").alias("leaked"), F.coalesce(F.sum("in_items"), F.lit(0)).alias("in_items"), F.coalesce(F.sum("in_records"), F.lit(0)).alias("in_records"))
