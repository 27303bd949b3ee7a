"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or makes the document's score, and only documents have labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo
from .shared import Scratch, named, small_batches

THRESHOLD = 0.3
#: The most labelled documents of each class that the classifier is fitted on, taken in the order of a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 2500, 4500
#: Features are a word and its beginnings of these lengths.
BEGINNINGS = (4, 5)
#: Evidence for toxicity: a feature is used if in so many toxic documents, and if its share of them is higher than of the others by so
#: many standard errors and so much.
LEAST_DOCS, LEAST_ERRORS, LEAST_RATIO = 4, 4.0, 3.0
#: The most features that are used, strongest first, and the most (sentence, feature) counts of a document that the fit sees, strongest
#: sentences first: with the number of documents these bound what comes to the driver, however long texts are.
MOST_FEATURES, MOST_COUNTS = 20_000, 1_000
#: Log odds of a sentence without evidence, which its score is measured from; steps of the fit; weights below are 0.
BACKGROUND, STEPS, RATE, SHRINK = -5.0, 300, 0.15, 2e-4
#: Characters of a text that are split into words at once.
PIECE = 1 << 20
SPACE = re.compile(r"\s")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’*#$%&|-_/\\"


class Model(NamedTuple):
    """Weights of features; a model of no weights scores 0 everywhere."""

    weights: dict[str, float]

    def word(self, token: str) -> float:
        """A token's weight: the sum over its features."""
        get = self.weights.get
        word = token.lower().strip(EDGES)
        total = get("=" + word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                total += get(word[:n], 0.0)
        return total


def features(token: str) -> list[str]:
    word = token.lower().strip(EDGES)
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)] if word else []


def chance(odds):
    """A sentence's score: how far its chance is above that of a sentence without evidence, so that long clean texts stay at 0."""
    base = 1 / (1 + np.exp(-BACKGROUND))
    return np.maximum(0.0, (1 / (1 + np.exp(-np.clip(odds + BACKGROUND, -50, 50))) - base) / (1 - base))


class Counted(NamedTuple):
    """What the fit sees of a document: its label, and for each sentence with evidence the number of times that it has each feature."""

    label: int
    sentences: list[dict[int, int]]


def strength(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float | None:
    """How many standard errors a feature's share of toxic documents is above its share of the others; None if it is not evidence enough."""
    p1, p0, pooled = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1), min((toxic + clean + 0.5) / (n_toxic + n_clean + 1), 0.999)
    errors = (p1 - p0) / math.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_clean))
    return errors if toxic >= LEAST_DOCS and errors >= LEAST_ERRORS and p1 / p0 >= LEAST_RATIO else None


def chosen_features(counts, n_toxic: int, n_clean: int, most: int = MOST_FEATURES) -> dict[str, float]:
    """The features that are evidence, in a fixed order, each with the weight that the fit starts from. counts: (feature, toxic, clean)."""
    found = [(-e, f, t, c) for f, t, c in counts if (e := strength(t, c, n_toxic, n_clean)) is not None]
    return {f: min(math.log((t + 0.5) / (n_toxic + 1) * (n_clean + 1) / (c + 0.5)), 1) for _, f, t, c in sorted(found)[:most]}


def counted(text: str, label: int, chosen: dict[str, int], most: int = MOST_COUNTS) -> Counted:
    """A document's sentences with chosen features, those with the most kinds first, as long as their counts are within the bound."""
    columns = Memo(lambda w: [chosen[f] for f in features(w) if f in chosen])
    sentences = []
    for part in SENTENCE.split(text):
        found = Counter()
        for c in map(columns.__getitem__, part.split()):
            found.update(c)
        if found:
            sentences.append(dict(sorted(found.items())[:most]))
    sentences.sort(key=len, reverse=True)
    out, room = [], most
    for one in sentences:
        room -= len(one)
        if room < 0:
            break
        out.append(one)
    return Counted(label, out)


def slopes(w: np.ndarray, column: np.ndarray, count: np.ndarray, row: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The gradient, by weights, of the mean negative log likelihood of the documents' labels under the noisy-or of their sentences.

    column, count, row: the features of sentences; owner: the document of each sentence; y: the documents' labels.
    Where a sentence's odds are below the background, the slope is that of the chance without its floor at 0, so that weights can come back.
    """
    odds = np.bincount(row, w[column] * count, len(owner))
    p = np.minimum(chance(odds), 1 - 1e-9)
    none = np.exp(np.bincount(owner, np.log1p(-p), len(y)))
    any_ = np.maximum(1 - none, 1e-6)
    slope = 1 / (1 + np.exp(-np.clip(odds + BACKGROUND, -50, 50)))
    slope = slope * (1 - slope) * (1 + np.exp(BACKGROUND)) / (1 - p)
    pull = y * none / any_ - (1 - y)
    return -np.bincount(column, (pull[owner] * slope)[row] * count, len(w)) / len(y)


def fit_counts(docs: list[Counted], start: dict[str, float]) -> Model:
    """Fits weights by the gradient of the documents' likelihood under the noisy-or of their sentences.

    Sentences without any feature stay at a score of 0 and need no place. Deterministic for an order of the documents.
    """
    y = np.array([d.label for d in docs], np.float64)
    sentences = [(d, one) for d, doc in enumerate(docs) for one in doc.sentences]
    if not sentences or y.min() == y.max():
        return Model({})
    owner = np.array([d for d, _ in sentences])
    row = np.repeat(np.arange(len(sentences)), [len(one) for _, one in sentences])
    column = np.array([c for _, one in sentences for c in one])
    count = np.array([n for _, one in sentences for n in one.values()], np.float64)
    w = np.array(list(start.values()), np.float64)
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        g = slopes(w, column, count, row, owner, y) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK, 0)
    return Model({f: float(x) for f, x in zip(start, w, strict=True) if abs(x) > 0.05})


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of texts at hand."""
    sums = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels, strict=True):
        sums[label].update({f for w in set(text.split()) for f in features(w)})
    n_toxic = sum(labels)
    if n_toxic in (0, len(labels)):
        return Model({})
    start = chosen_features(((f, t, sums[0][f]) for f, t in sums[1].items()), n_toxic, len(labels) - n_toxic)
    numbers = {f: k for k, f in enumerate(start)}
    return fit_counts([counted(t, y, numbers) for t, y in zip(texts, labels, strict=True)], start)


def word_runs(text: str, at: int, end: int, piece: int = PIECE):
    """The words between two places of a text, in lists of a bounded part of it each."""
    while end - at > piece and (cut := SPACE.search(text, at + piece, end)):
        yield text[at : cut.start()].split()
        at = cut.start()
    yield text[at:end].split()


def score(model_word, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's score, and the sentences with evidence: where they begin and end, and their scores. model_word: a token's weight."""
    clear, spans, at = 1.0, [], 0
    if not any(any(map(model_word, run)) for run in word_runs(text, 0, len(text))):
        return 0.0, []
    for m in [*SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        odds = sum(sum(map(model_word, run)) for run in word_runs(text, at, end))
        if odds > 0:
            p = float(chance(odds))
            clear *= 1 - p
            spans.append((at, end, p))
        at = m.end() if m else end
    return 1 - clear, spans


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def training_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """(key, label, text) of at most most_toxic + most_clean documents, written to the shared folder. Held-out rows are none of them.

    Ids, of any type, are chosen among the labels, in the order of a hash; their bounded list is broadcast to one scan of the documents.
    Of rows that share a doc_id the least text counts, so that the bound holds however often a document is repeated.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("label")).withColumn("key", F.xxhash64("l_id"))
    chosen = [rows.where(c).orderBy("key", "l_id").limit(n) for c, n in (("label = 1", most_toxic), ("label = 0", most_clean))]
    ids = scratch.keep(chosen[0].unionByName(chosen[1]), "sample-ids")
    texts = docs.select(F.col("doc_id").alias("d_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), F.col("d_id") == F.col("l_id")).groupBy("l_id", "key", "label").agg(F.min("text").alias("text"))
    return scratch.keep(found.select("key", "label", "text"), "sample")


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """The classifier of a corpus: fitted on a bounded sample of its labelled documents.

    Features are counted and screened where the texts are; the driver gets the chosen ones and their counts by sentence, no text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = training_sample(docs, labels, Scratch(spark), most_toxic, most_clean)
    sizes = {r[0]: r[1] for r in sample.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({})

    def kinds(batches):
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {w for run in word_runs(text, 0, len(text)) for w in run}
                found = sorted({f for w in words for f in features(w)})
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())], names=["label", "feature"])

    counts = sample.mapInArrow(kinds, "label int, feature string").groupBy("feature").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    n1, n0 = sizes[1], sizes[0]
    p1, p0, pooled = (F.col("t") + 0.5) / (n1 + 1), (F.col("c") + 0.5) / (n0 + 1), F.least((F.col("t") + F.col("c") + 0.5) / (n1 + n0 + 1), F.lit(0.999))
    errors = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    # the same screen as strength(), so that no more rows come to the driver than are used
    strong = counts.where((F.col("t") >= LEAST_DOCS) & (errors >= LEAST_ERRORS) & (p1 / p0 >= LEAST_RATIO)).orderBy(errors.desc(), "feature").limit(MOST_FEATURES)
    start = chosen_features(map(tuple, strong.collect()), n1, n0)
    numbers = spark.sparkContext.broadcast({f: k for k, f in enumerate(start)})

    def sentences(batches):
        for batch in batches:
            rows = [counted(t, y, numbers.value).sentences for y, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            said = [[[x for pair in one.items() for x in pair] for one in r] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.list_(pa.list_(pa.int32())))], names=["key", "label", "sentences"])

    rows = sample.mapInArrow(sentences, "key long, label int, sentences array<array<int>>").collect()
    rows.sort(key=tuple)
    return fit_counts([Counted(label, [dict(zip(x[::2], x[1::2], strict=True)) for x in said]) for _, label, said in rows], start)


def toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score", spans: str = "offending") -> DataFrame:
    """Adds each whole text's score from 0 to 1, and its offending sentences (start, end, score) in code points.

    A null or empty text scores 0. Rows stay, in number and order, and other columns pass; a column of the input that has the name
    of a new one is replaced. No shuffle; the model is the same for all and its few thousand weights are broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(model.weights)
    kept = [c for c in docs.columns if c.lower() not in {out.lower(), spans.lower()}]
    carried = kept if text in kept else [*kept, text]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        word = Memo(Model(weights.value).word).__getitem__
        for batch in batches:
            rows = [score(word, t or "") for t in batch.column(carried.index(text)).to_pylist()]
            found = [[{"start": a, "end": b, "score": p} for a, b, p in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([r[0] for r in rows], pa.float64()), pa.array(found, kind)], names=[*kept, out, spans])

    span = T.StructType().add("start", "integer").add("end", "integer").add("score", "double")
    schema = docs.select(*kept).schema.add(out, "double", False).add(spans, T.ArrayType(span), False)
    return docs.select(*carried).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with the input's columns. The classifier is fitted on these documents.

    A null or empty text scores 0 and stays; repeated rows all stay or all go; without labels of both kinds all rows stay.
    """
    found, spans = named("score", docs.columns), named("offending", docs.columns)
    return toxicity(docs, train(docs, labels), out=found, spans=spans).where(F.col(found) < threshold).select(*docs.columns)
