"""Topics of documents from a model fitted to all of them, over the tokens that are counted anyway.

Documents are tokenized once, into a table. The fit reads it a bounded number of times; each time sums that the vocabulary bounds go to the driver.
Sums are of whole numbers, so a model doesn't depend on how the documents are spread or ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .tokens import TOKENIZER, encoding

TOPICS = 4
#: Parts of one in which vectors are summed, and the least distance from a language's mean that gives a text a direction.
UNIT, LEAST = float(1 << 30), 0.01
#: Distinct tokens that a worker takes at once, as far as texts are of like length.
MOST_TOKENS = 1 << 20
#: Partial sums that may go to the driver as they are, and the slices that more of them are summed in before.
FEW, SLICES = 32, 16


@dataclass
class Batch:
    """Texts with tokens: the distinct tokens of all of them in a row with counts, and the text of each token; language and digest of each text."""

    ids: np.ndarray
    counts: np.ndarray
    row: np.ndarray
    langs: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(docs: list[tuple[np.ndarray, np.ndarray]], langs: list[str], keys: list[int]) -> Batch:
        join = lambda k: np.concatenate([d[k] for d in docs] or [np.zeros(0, dtype=np.int64)])
        return Batch(join(0), join(1), np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs]), np.array(langs, dtype=object), np.array(keys, dtype=np.int64))

    @staticmethod
    def read(batch: pa.RecordBatch) -> Batch:
        lists = batch.column("ids")
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        return Batch(flat(lists), flat(batch.column("counts")), np.repeat(np.arange(len(lists)), lengths), np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("key").to_numpy(zero_copy_only=False))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut such that each has about MOST_TOKENS tokens at most, or a single text."""
    for batch in batches:
        names = batch.schema.names
        tokens = len(batch.column("ids").flatten()) if "ids" in names else batch.column("x").nbytes // 4
        rows = max(1, batch.num_rows * MOST_TOKENS // max(tokens, MOST_TOKENS))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class Vectors:
    """Texts as vectors: columns and values of their known tokens in a row, and the text of each; place of the language, distance from its mean and digest of each text."""

    column: np.ndarray
    x: np.ndarray
    row: np.ndarray
    lang: np.ndarray
    r: np.ndarray
    keys: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch) -> Vectors:
        columns, x = b"".join(batch.column("columns").to_pylist()), batch.column("x").to_pylist()
        numbers = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        lengths = np.array([len(v) // 4 for v in x], dtype=np.int64)
        kind = np.uint16 if len(columns) == 2 * lengths.sum() else np.int32
        return Vectors(np.frombuffer(columns, dtype=kind), np.frombuffer(b"".join(x), dtype=np.float32), np.repeat(np.arange(len(x)), lengths), numbers("place"), numbers("r"), numbers("key"))

    def times(self, other: np.ndarray) -> np.ndarray:
        """The product of each text with a vector, or with that of its language where there is one for each."""
        return np.bincount(self.row, self.x * (other[self.column] if other.ndim == 1 else other[self.lang[self.row], self.column]), len(self.lang))

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.row == i
        return self.column[own], self.x[own]


@dataclass
class TopicModel:
    """column: of each token, -1 for unknown ones; idf of the columns; means of the languages and behind them of all; centres[k]: what the columns speak for a topic."""

    column: np.ndarray
    idf: np.ndarray
    langs: list[str]
    means: np.ndarray
    centres: np.ndarray

    def vectors(self, batch: Batch) -> Vectors:
        """Values have length one for each text. The distance is 0 for texts too near to their language's mean, or without a known token, to have a direction."""
        inside = np.flatnonzero(self.column[batch.ids] >= 0)
        row, column = batch.row[inside], self.column[batch.ids[inside]]
        x = batch.counts[inside] * self.idf[column]
        norm = np.sqrt(np.bincount(row, x * x, len(batch.langs)))
        place = {g: i for i, g in enumerate(self.langs)}
        lang = np.array([place.get(g, len(self.langs)) for g in batch.langs], dtype=np.int64)
        out = Vectors(column.astype(np.uint16 if len(self.idf) <= 1 << 16 else np.int32), (x / np.where(norm > 0, norm, 1.0)[row]).astype(np.float32), row, lang, norm, batch.keys)
        r = np.sqrt(np.maximum(0.0, 1 - 2 * out.times(self.means) + (self.means * self.means).sum(1)[lang]))
        out.r = np.where((norm > 0) & (r >= LEAST), r, 0.0)
        return out

    def scores(self, vectors: Vectors, others: np.ndarray) -> np.ndarray:
        """Products of the texts, less their language's mean, with other vectors."""
        return np.stack([vectors.times(c) for c in others], axis=1) - (self.means @ others.T)[vectors.lang]

    def assign(self, vectors: Vectors) -> np.ndarray:
        """The number of each text's topic, -1 for texts without a known token."""
        return np.where(np.bincount(vectors.row, minlength=len(vectors.lang)) > 0, np.argmax(self.scores(vectors, self.centres), axis=1), -1)

    def topic(self, ids: list[int], lang: str) -> str:
        """The topic of a text's tokens, "none" for texts without a known token."""
        return name(int(self.assign(self.vectors(Batch.of([np.unique(np.asarray(ids, dtype=np.int64), return_counts=True)], [lang], [0])))[0]))


def name(topic: int) -> str:
    return f"t{topic}" if topic >= 0 else "none"


class Held:
    """Texts, or their vectors, in memory."""

    def __init__(self, batch: Batch | Vectors) -> None:
        self.batch = batch

    def langs(self) -> list[str]:
        return sorted(set(self.batch.langs))

    def sums(self, step: Callable[[Batch | Vectors], np.ndarray], size: int) -> np.ndarray:
        return step(self.batch)

    def least(self, step: Callable[[Vectors], np.ndarray]) -> tuple | None:
        return least(self.batch, step(self.batch))

    def shaped(self, model: TopicModel) -> Held:
        return Held(model.vectors(self.batch))


class Spread:
    """Texts in a table (ids, counts, lang, key, n_tokens), or their vectors in one (columns, x, place, r, key, n_tokens), one row a text."""

    def __init__(self, table: DataFrame, read: Callable[[pa.RecordBatch], Batch | Vectors]) -> None:
        rows = table.filter("n_tokens > 0").select(*(("ids", "counts", "lang", "key") if read is Batch.read else ("columns", "x", "place", "r", "key")))
        parallel = max(FEW, 2 * table.sparkSession.sparkContext.defaultParallelism)
        self.table, self.read = table, read
        self.rows = rows.coalesce(parallel)  # more tasks would make more partial sums, and not be faster
        self.parts = min(parallel, rows._jdf.queryExecution().toRdd().getNumPartitions())

    def langs(self) -> list[str]:
        return sorted(r[0] for r in self.rows.select("lang").distinct().collect())

    def sums(self, step: Callable[[Batch | Vectors], np.ndarray], size: int) -> np.ndarray:
        slices, read = 1 if self.parts <= FEW else SLICES, self.read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, dtype=np.int64)
            for batch in pieces(batches):
                total += step(read(batch))
            for i, part in enumerate(np.array_split(total, slices)):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "block": pa.array([part.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, block in zip(batch.column("slice").to_pylist(), batch.column("block").to_pylist(), strict=True):
                    found[i] = found.get(i, 0) + np.frombuffer(block, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(found), pa.int32()), "block": pa.array([b.tobytes() for b in found.values()], pa.binary())})

        out = self.rows.mapInArrow(run, "slice int, block binary")
        if slices > 1:
            out = out.repartition(SLICES, "slice").mapInArrow(add, "slice int, block binary")
        blocks: dict[int, np.ndarray] = {}
        for r in out.collect():
            blocks[r[0]] = blocks.get(r[0], 0) + np.frombuffer(r[1], dtype=np.int64)
        return np.concatenate([blocks[i] for i in range(slices)]) if blocks else np.zeros(size, dtype=np.int64)

    def least(self, step: Callable[[Vectors], np.ndarray]) -> tuple | None:
        read = self.read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in pieces(batches):
                vectors = read(batch)
                one = least(vectors, step(vectors))
                if one is not None and (best is None or one[:3] < best[:3]):
                    best = one
            if best is not None:
                kinds = {"score": pa.float64(), "key": pa.int64(), "place": pa.int64(), "columns": pa.list_(pa.int64()), "x": pa.list_(pa.float32())}
                yield pa.RecordBatch.from_pydict({c: pa.array([v], kind) for (c, kind), v in zip(kinds.items(), best, strict=True)})

        found = self.rows.mapInArrow(run, "score double, key bigint, place bigint, columns array<bigint>, x array<float>").orderBy("score", "key", "place").limit(1).collect()
        return tuple(found[0]) if found else None

    def shaped(self, model: TopicModel) -> Spread:
        """The vectors of all texts, those without tokens too, as a table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                v = model.vectors(Batch.read(batch))
                ends = np.append(0, np.cumsum(np.bincount(v.row, minlength=len(v.lang)))).tolist()
                cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())  # noqa: B023, B905, E731
                keep = {c: batch.column(c) for c in ("doc_id", "source", "lang", "n_tokens", "key")}
                yield pa.RecordBatch.from_pydict(keep | {"place": pa.array(v.lang, pa.int64()), "r": pa.array(v.r, pa.float64()), "columns": cut(v.column), "x": cut(v.x)})

        return Spread(cut_lineage(self.table.mapInArrow(run, "doc_id bigint, source string, lang string, n_tokens bigint, key bigint, place bigint, r double, columns binary, x binary")), Vectors.read)


def least(vectors: Vectors, scores: np.ndarray) -> tuple | None:
    """(score, key, language's place, columns, values) of the text with the lowest score, of equal ones that with the lowest key; infinite scores don't count."""
    if not np.isfinite(scores).any():
        return None
    i = min(np.flatnonzero(scores == scores.min()), key=lambda j: (vectors.keys[j], vectors.lang[j]))
    column, x = vectors.one(i)
    return float(scores[i]), int(vectors.keys[i]), int(vectors.lang[i]), column.tolist(), x.tolist()


def fit_to(texts: Held | Spread, path: str = TOKENIZER, topics: int = TOPICS, rounds: int = 25) -> tuple[TopicModel, Held | Spread]:
    """Spherical k-means over the texts' tf-idf vectors after each language's mean has been taken off, so that topics aren't languages; with the vectors.

    Every text with a token counts. Starts are chosen farthest first from the text nearest to the mean. No texts give a model whose topic is
    always "none"; fewer texts than topics give as many topics.
    """
    size = encoding(path).n_vocab
    counted = texts.sums(lambda b: np.append(np.bincount(b.ids, minlength=size), len(b.langs)), size + 1)
    df, n = counted[:-1], int(counted[-1])
    known = np.flatnonzero((df >= min(3, n)) & (df <= max(1, 0.5 * n))) if n > 3 else np.flatnonzero(df)
    column = np.full(size, -1, dtype=np.int64)
    column[known] = np.arange(len(known))
    width, langs = len(known), texts.langs()
    least_langs = max(1, len(langs))
    model = TopicModel(column, np.log((1 + n) / (1 + df[known])) + 1e-3, langs, np.zeros((len(langs) + 1, width)), np.zeros((1, width)))

    def by_language(b: Batch) -> np.ndarray:
        v = model.vectors(b)
        return np.append(np.bincount(v.lang[v.row] * width + v.column, np.rint(v.x * UNIT), least_langs * width), np.bincount(v.lang, minlength=least_langs)).astype(np.int64)

    got = texts.sums(by_language, least_langs * (width + 1))
    total, members = got[: least_langs * width].reshape(least_langs, width), got[least_langs * width :]
    if n:
        model.means = np.vstack([total / UNIT / members[:, None], total.sum(0) / UNIT / n])
    shaped = texts.shaped(model)

    def central(v: Vectors) -> np.ndarray:
        return np.where(v.r > 0, -v.times(model.means[-1]), np.inf)

    def near(v: Vectors) -> np.ndarray:
        return np.where(v.r > 0, model.scores(v, starts).max(1) / np.where(v.r > 0, v.r, 1.0), np.inf)

    starts = np.zeros((0, width))
    while len(starts) < min(topics, n):
        found = shaped.least(near if len(starts) else central)
        if found is None:
            break
        rest = -model.means[found[2]]
        rest[found[3]] += np.array(found[4], dtype=np.float32)
        starts = np.vstack([starts, rest / np.linalg.norm(rest)])
    if not len(starts):
        return model, shaped
    model.centres = starts
    k, places = len(starts), len(langs) + 1

    def directions(v: Vectors) -> np.ndarray:
        scale = np.where(v.r > 0, 1 / np.where(v.r > 0, v.r, 1.0), 0.0)
        topic = np.argmax(model.scores(v, model.centres), axis=1)
        return np.append(np.bincount((topic * width)[v.row] + v.column, np.rint(v.x * (scale * UNIT)[v.row]), k * width), np.bincount(topic * places + v.lang, np.rint(scale * UNIT), k * places)).astype(np.int64)

    for _ in range(rounds):
        got = shaped.sums(directions, k * (width + places))
        scales = got[k * width :].reshape(k, places) / UNIT
        rest = got[: k * width].reshape(k, width) / UNIT - scales @ model.means
        new = np.where(scales.any(1)[:, None], rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12), model.centres)
        if np.allclose(new, model.centres, atol=1e-6):
            break
        model.centres = new
    return model, shaped


def fit(texts: list[str], langs: list[str], path: str = TOKENIZER, topics: int = TOPICS, rounds: int = 25) -> TopicModel:
    """fit_to of texts in memory."""
    encode = encoding(path).encode_ordinary
    docs = [(np.unique(np.asarray(encode(t), dtype=np.int64), return_counts=True), g, i) for i, (t, g) in enumerate(zip(texts, langs, strict=True)) if t]
    return fit_to(Held(Batch.of(*map(list, zip(*docs, strict=True))) if docs else Batch.of([], [], [])), path, topics, rounds)[0]


def tokenized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """documents (doc_id, source, lang, text) as (doc_id, source, lang, n_tokens, ids, counts, key): distinct tokens and a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            held = [np.asarray(encode(t) if t else [], dtype=np.int32) for t in batch.column("text").to_pylist()]
            pairs = [np.unique(ids, return_counts=True) for ids in held]
            offsets = pa.array(np.append(0, np.cumsum([len(p[0]) for p in pairs])), pa.int32())
            join = lambda k: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[k] for p in pairs] or [np.zeros(0)]).astype(np.int32)))  # noqa: B023, E731
            keep = {c: batch.column(c) for c in ("doc_id", "source", "lang", "key")}
            yield pa.RecordBatch.from_pydict(keep | {"n_tokens": pa.array([len(i) for i in held], pa.int64()), "ids": join(0), "counts": join(1)})

    rows = spread(documents.select("doc_id", "source", "lang", F.xxhash64("text").alias("key"), "text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, lang string, key bigint, n_tokens bigint, ids array<int>, counts array<int>")


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """documents (doc_id, source, lang, text) as (doc_id, source, lang, topic, n_tokens), with the topics of a model fitted to all of them."""
    model, shaped = fit_to(Spread(cut_lineage(tokenized(documents, path)), Batch.read), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            topic = pa.array([name(t) for t in model.assign(Vectors.read(batch)).tolist()], pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "source": batch.column("source"), "lang": batch.column("lang"), "topic": topic, "n_tokens": batch.column("n_tokens")})

    return shaped.table.mapInArrow(run, "doc_id bigint, source string, lang string, topic string, n_tokens bigint")
