"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a pair of features counts as the product of their vectors. The sum over all
pairs is half the square of the vectors' sum less the sum of their squares, so a text is scored in time that grows with
its number of features only. All tasks turn labelled rows into features, one task fits the model to a bounded sample of
them; every text is then scored whole.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.shared import slices
from pagelore.llm.words import CHARACTERS, REMEMBERED, Numbers

#: At most so many labelled rows of each class are learned from: those with the least hash of their id, then of their text.
SAMPLE = 1500
#: Words are hashed to 2^BITS features; length of a feature's vector.
BITS, RANK = 15, 8
STEPS, RATE, PENALTY = 40, 0.05, 2.0
THRESHOLD = 0.3
#: Bytes that the statistics count the shares of.
_KINDS = [string.ascii_uppercase.encode(), string.digits.encode(), b"#*$%&|<>^~_=+\\{}[]@", b".,;:", b"!?", bytes(range(128, 256)), b"\n"]
N_STATS = len(_KINDS) + 10
N_FEATURES = (1 << BITS) + N_STATS
_TABLE = np.zeros((256, len(_KINDS)))
for _k, _kind in enumerate(_KINDS):
    _TABLE[list(_kind), _k] = 1


class Extractor:
    """Distinct hashed words and statistics of texts; words are hashed once in a worker."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers, self.characters = Numbers(), 0
        self.buckets, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __call__(self, texts: list[str | None], n_chars: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.buckets) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
        split = [(x or "").split() for x in texts]
        at = self.numbers.of(split)
        if new := self.numbers.names[len(self.buckets) :]:
            plain = [(w.strip(string.punctuation) or w).lower().encode("utf-8", "surrogatepass") for w in new]
            self.buckets = np.concatenate([self.buckets, np.fromiter((zlib.crc32(w) & ((1 << BITS) - 1) for w in plain), np.int32, len(new))])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int32, len(new))])
            self.characters += sum(map(len, new))
        ends = np.cumsum([0, *map(len, split)])
        return [(np.unique(self.buckets[at[a:b]]), self._stats(text or "", at[a:b], n)) for text, a, b, n in zip(texts, ends[:-1], ends[1:], n_chars, strict=True)]

    def _stats(self, text: str, at: np.ndarray, n_chars: int | None) -> np.ndarray:
        n = len(at)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = np.bincount(raw, minlength=256) @ _TABLE / max(1, len(raw))
        found = [np.log1p(n), 0.0, 1.0, 0.0, 0.0, 0.0]
        if n:
            _, counts = np.unique(at, return_counts=True)
            pairs = at[:-1] * (len(self.sizes) + 1) + at[1:]
            found[1:] = [self.sizes[at].mean(), len(counts) / n, (at[1:] == at[:-1]).mean() if n > 1 else 0, counts.max() / n, 1 - len(np.unique(pairs)) / (n - 1) if n > 1 else 0]
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
        bullets = sum(x[0] in "-*•|" for x in lines) / len(lines) if lines else 0.0
        return np.array([*kinds, *found, repeated, bullets, np.log1p(max(0, n_chars)) if n_chars is not None else 0.0, float(n_chars is None)])


class Model:
    """bias, weights and vectors of all features, and how statistics are scaled; the last features are the statistics."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        self.bias, self.weights, self.vectors, self.mean, self.spread = bias, weights, vectors, mean, spread

    @cached_property
    def squares(self) -> np.ndarray:
        return self.vectors * self.vectors

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4)

    def __call__(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        first = 1 << BITS
        out = []
        for words, stats in found:
            x, y = 1 / np.sqrt(max(1, len(words))), self.scaled(stats)
            linear = x * self.weights[words].sum() + y @ self.weights[first:]
            total = x * self.vectors[words].sum(axis=0) + y @ self.vectors[first:]
            each = x * x * self.squares[words].sum(axis=0) + (y * y) @ self.squares[first:]
            out.append(self.bias + linear + 0.5 * float((total * total - each).sum()))
        return 1 / (1 + np.exp(-np.clip(np.array(out), -40, 40)))


def fit(found: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, odds: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, seed: int = 7) -> Model:
    """The model of rows' features. odds: rows of label 1 to others among all labelled ones, which the bias is moved to."""
    stats = np.array([s for _, s in found])
    mean, spread = stats.mean(axis=0), stats.std(axis=0)
    model = Model(0.0, np.zeros(N_FEATURES), np.random.default_rng(seed).normal(0, 0.05, (N_FEATURES, RANK)), mean, np.where(spread > 1e-6, spread, 1.0))
    own = np.arange(1 << BITS, N_FEATURES)
    columns = np.concatenate([np.concatenate([w, own]) for w, _ in found])
    values = np.concatenate([np.concatenate([np.full(len(w), 1 / np.sqrt(max(1, len(w)))), model.scaled(s)]) for w, s in found])
    sizes = np.array([len(w) + N_STATS for w, _ in found])
    starts, rows = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(found)), sizes)
    order = np.argsort(columns, kind="stable")
    used, firsts = np.unique(columns[order], return_index=True)
    truth, share = good.astype(float), np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    parameters = np.concatenate([model.weights[:, None], model.vectors], axis=1)
    m, v = np.zeros((len(used), RANK + 1)), np.zeros((len(used), RANK + 1))
    bias = mb = vb = 0.0
    for k in range(1, steps + 1):  # Adam on all rows, both classes weighing the same
        held = parameters[columns]
        held *= values[:, None]
        total = np.add.reduceat(held, starts)
        each = np.add.reduceat(held[:, 1:] ** 2, starts)
        z = bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - each).sum(axis=1)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - truth) * share
        pull = (error[rows] * values)[:, None]
        slope = np.concatenate([pull, pull * (total[rows, 1:] - held[:, 1:])], axis=1)
        g = np.add.reduceat(slope[order], firsts) + penalty / len(found) * parameters[used]
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        now = rate / (1 - 0.9**k)
        parameters[used] -= now * m / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        bias -= now * mb / (np.sqrt(vb / (1 - 0.999**k)) + 1e-9)
    unused = np.ones(N_FEATURES, bool)
    unused[used] = False
    parameters[unused] = 0
    model.bias, model.weights, model.vectors = float(bias + np.log(max(odds, 1e-9))), parameters[:, 0].copy(), parameters[:, 1:].copy()
    return model


def _features(rows: DataFrame, keep: list[str], kinds: str) -> DataFrame:
    """keep, words and stats of rows with _text and _n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = extract(texts, part.column("_n_chars").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([w for w, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))], [*keep, "words", "stats"])

    return rows.mapInArrow(run, f"{kinds}, words array<int>, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", n_chars: str = "n_chars", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """The model of the labelled rows.

    labels has doc_id and label (0 or 1); rows with nulls are left out, and ids that bear both labels. At most sample rows
    of each class are used, however often an id repeats. Without labelled rows of both classes the bias alone says how
    likely label 1 is.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_good"))
    known = known.groupBy("_id").agg(F.max("_good").alias("_good"), F.min("_good").alias("_least")).where("_good = _least").drop("_least")
    total = {r["_good"]: r["n"] for r in known.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    odds = (total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5)
    nothing = Model(float(np.log(odds)), np.zeros(N_FEATURES), np.zeros((N_FEATURES, RANK)), np.zeros(N_STATS), np.ones(N_STATS))
    if len(total) < 2:
        return nothing
    chosen = [known.where(F.col("_good") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.col(n_chars).cast("long").alias("_n_chars"))
    rows = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")  # at most 2 * sample ids
    told = rows.select("_good", F.xxhash64("_id").alias("_first"), F.xxhash64("_text").alias("_second"), "_text", "_n_chars")
    made = _features(told, ["_good", "_first", "_second"], "_good int, _first bigint, _second bigint")
    held = [made.where(F.col("_good") == k).orderBy("_first", "_second").limit(sample) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, found = [], []
        for batch in batches:
            good += batch.column("_good").to_pylist()
            found += [(w.values.to_numpy(), s.values.to_numpy()) for w, s in zip(batch.column("words"), batch.column("stats"), strict=True)]
        order = sorted(range(len(found)), key=lambda i: (good[i], found[i][0].tobytes(), found[i][1].tobytes()))
        if len(set(good)) < 2:
            return
        model = fit([found[i] for i in order], np.array([good[i] == 1 for i in order]), odds)
        flat = np.concatenate([[model.bias], model.weights, model.vectors.ravel(), model.mean, model.spread])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["model"])

    fitted = held[0].unionByName(held[1]).select("_good", "words", "stats").repartition(1).mapInArrow(run, "model array<double>").first()
    if fitted is None:
        return nothing
    cuts = np.cumsum([1, N_FEATURES, N_FEATURES * RANK, N_STATS])
    bias, weights, vectors, mean, spread = np.split(np.array(fitted["model"]), cuts)
    return Model(float(bias[0]), weights, vectors.reshape(N_FEATURES, RANK), mean, spread)


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and score (double, 0 to 1) of each whole text; a null text is scored as an empty one.

    A column in keep named score is replaced. Each row is scored by itself: ids may be null or repeat.
    """
    fields = [f for f in docs.schema if f.name in keep and f.name != "score"]
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                scores = spread.value(extract(texts, rows.column("_n_chars").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), pa.array(scores, pa.float64())], [*(f.name for f in fields), "score"])

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    return docs.select(*(F.col(f.name) for f in fields), F.col(text).cast("string").alias("_text"), F.col(n_chars).cast("long").alias("_n_chars")).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model learns from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
