"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts become sets of hashed n-grams of their lower-cased characters. The ratio of a feature is the logarithm of how
much more of the toxic texts hold it than of the others; logistic regression weighs presence times ratio. All tasks turn the
texts of a bounded sample of labelled rows into features, one task fits the model to them; every text is then scored
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.shared import slices

#: At most so many labelled rows of each class are learned from: those with the least hash of their id, then of their text.
SAMPLE = 2500
SIZES = (3, 4, 5)
BITS = 22
#: The model's size: features in fewer sampled texts are no part of it, and beyond so many those with the least ratios.
#: Without a bound it learns the texts by heart: at sf0.1 held-out precision falls from 1.00 to 0.98, recall from 0.71 to
#: 0.68, and fitting takes eight times as long.
LEAST_TEXTS, FEATURES = 5, 40_000
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """Hashes of a text's character n-grams, with repetitions; white space counts as one kind of character."""
    codes = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, SIZES[-1] + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) if len(codes) >= n else h[:0]
        if n in SIZES:
            found.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(found)


def log_count_ratios(found: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every feature the naive Bayes log-count ratio, and how many texts hold it. found: each text's distinct features."""
    counts = [np.bincount(np.concatenate([f for f, t in zip(found, toxic, strict=True) if t == k] or [np.zeros(0, np.int32)]), minlength=1 << BITS) for k in (0, 1)]
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    return np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2)), counts[0] + counts[1]


def fit(found: list[np.ndarray], toxic: np.ndarray, odds: float, steps: int = 200, penalty: float = 1.0, most: int | None = FEATURES, least: int = LEAST_TEXTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias). odds: toxic to other rows among all labelled ones, which the bias is moved to. most: how
    many features the model has, None for all that least texts hold."""
    ratio, held = log_count_ratios(found, toxic)
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    often = np.flatnonzero(held >= least)
    chosen = np.sort(often[np.argsort(-np.abs(ratio[often]), kind="stable")[:most]])
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows, columns = [], []
    for i, f in enumerate(found):
        own = place[f]
        own = own[own >= 0]
        rows.append(np.full(len(own), i, np.int32))
        columns.append(own)
    row, column = np.concatenate(rows), np.concatenate(columns)
    r = ratio[chosen]
    scale = r[column]
    w, b, truth = np.zeros(len(chosen)), 0.0, toxic.astype(float)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):  # Adam on all rows
        z = np.bincount(row, scale * w[column], minlength=len(found)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - truth) / len(found)
        g, gb = np.bincount(column, scale * error[row], minlength=len(chosen)) + penalty * w / len(found), error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**k)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.999**k)) + 1e-9)
    return chosen, w * r, float(b + np.log(max(odds, 1e-9) * n[0] / n[1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int | None = FEATURES, least: int = LEAST_TEXTS, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the labelled rows: (features, weights, bias).

    labels has doc_id and label (0 or 1); rows with nulls are left out, and ids that bear both labels. At most sample
    rows of each class are used, however often an id repeats; most and least bound the model as in fit. Without labelled
    rows of both classes the bias alone says how likely label 1 is.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic"))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("_least")).where("toxic = _least").drop("_least")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = (total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5)
    chosen = None
    for k in (0, 1):
        own = known.where(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = [np.unique(features(x)) for x in texts]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("toxic", "_first", "_second")), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], ["toxic", "_first", "_second", "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, held = [], []
        for batch in batches:
            toxic += batch.column("toxic").to_pylist()
            held += [x.values.to_numpy() for x in batch.column("features")]
        order = sorted(range(len(held)), key=lambda i: (toxic[i], held[i].tobytes()))
        if len(set(toxic)) < 2:
            found = np.zeros(0, np.int64), np.zeros(0), float(np.log(odds))
        else:
            found = fit([held[i] for i in order], np.array([toxic[i] for i in order]), odds, most=most, least=least)
        yield pa.RecordBatch.from_pydict({"feature": [-1, *map(int, found[0])], "weight": [found[2], *map(float, found[1])]}, schema=pa.schema([("feature", pa.int32()), ("weight", pa.float64())]))

    told = rows.select("_text", "toxic", F.xxhash64("_id").alias("_first"), F.xxhash64("_text").alias("_second"))
    made = told.mapInArrow(extract, "toxic int, _first bigint, _second bigint, features array<int>")
    own = [made.where(F.col("toxic") == k).orderBy("_first", "_second").limit(sample).select("toxic", "features") for k in (0, 1)]
    model = own[0].unionByName(own[1]).repartition(1).mapInArrow(run, "feature int, weight double").toPandas().sort_values("feature")
    bias = float(model.loc[model.feature == -1, "weight"].iloc[0]) if len(model) else float(np.log(odds))
    own = model[model.feature >= 0]
    return own.feature.to_numpy(), own.weight.to_numpy(), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and score (double, 0 to 1) of each whole text; a null text is scored as an empty one.

    A column in keep named score is replaced.
    """
    fields = [f for f in docs.schema if f.name in keep and f.name != "score"]
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, bias = spread.value
        table = np.zeros(1 << BITS, np.float32)
        table[chosen] = weights
        held = np.zeros(1 << BITS, bool)
        held[chosen] = True
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                out = []
                for x in texts:
                    found = features(x)
                    out.append(bias + float(table[np.unique(found[held[found]])].sum(dtype=np.float64)))
                scores = 1 / (1 + np.exp(-np.clip(np.array(out), -40, 40)))
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), pa.array(scores)], [*(f.name for f in fields), "score"])

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    return docs.select(*(F.col(f.name) for f in fields), F.col(text).cast("string").alias("_text")).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model learns from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
