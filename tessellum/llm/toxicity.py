"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (and of itself, with borders), a text the average of its
words; a linear softmax on top and the vectors below it are trained together by Adam on the logistic loss. n-grams are
hashed into a fixed table, so misspellings never seen share most vectors with the word they stand for.

For scoring, the softmax is folded into the table: each bucket becomes one number, each word the mean of its buckets'
numbers, and a text's logit is their mean. Only that table (BUCKETS floats, 1 MB) is sent to the executors.

Rows the model has learned from lie far from 0.5, so they do not show where to cut. Two models, each fitted on one half of
the rows, score the other half; the bias is moved by the cut at which these scores lose as large a share of either class.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_rest

BUCKETS, GRAMS, DIM = 1 << 18, (3, 4, 5), 4
EPOCHS, RATE, DECAY, SEED = 60, 0.05, 1e-5, 7
MIN_DOCS, START = 8, 0.1
#: The classifier is fitted on at most so many labelled rows of each class, those with the least hashed ids.
PER_CLASS = 1500
REMEMBERED = 500_000
FOLD, HELD_OUT = 5, 0
#: With fewer rows than this of a class the bias stays as fitted: models of half of them score too unlike the whole one.
LEAST = 500


def buckets(word: bytes) -> np.ndarray | list[int]:
    """The hashed n-grams of a word with borders, whatever its length, and the word itself; packed if there are many."""
    full = b"<" + word + b">"
    digest = xxhash.xxh32_intdigest
    grams = (digest(full[i : i + n], n) % BUCKETS for n in GRAMS for i in range(len(full) - n + 1))
    if len(full) > 64:
        return np.append(np.fromiter(grams, np.int32), np.int32(digest(full, 1) % BUCKETS))
    found = list(grams)
    found.append(digest(full, 1) % BUCKETS)
    return found


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


@dataclass
class Model:
    """weight: of each bucket; bias. ``empty`` models score every text by the bias."""

    weight: np.ndarray
    bias: float


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    """The model after EPOCHS full passes; the same input gives the same model. Classes weigh the same in the loss.

    Fewer than two classes: no weights, and a bias that says the one class there is (or 0 without any rows).
    """
    toxic = np.asarray(toxic, np.float32)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -4.0 if not len(toxic) or toxic[0] == 0 else 4.0)
    known: dict[bytes, int] = {}
    doc_of, word_of, count_of = [], [], []
    for d, text in enumerate(texts):
        own: dict[int, int] = {}
        for w in split(text):
            k = known.setdefault(w, len(known))
            own[k] = own.get(k, 0) + 1
        doc_of.append(np.full(len(own), d, np.int32))
        word_of.append(np.fromiter(own.keys(), np.int32, len(own)))
        count_of.append(np.fromiter(own.values(), np.float32, len(own)) / max(1, sum(own.values())))
    doc, word, share = np.concatenate(doc_of), np.concatenate(word_of), np.concatenate(count_of)
    packed, sizes = array("i"), array("i")
    for w in known:
        own_grams = buckets(w)
        sizes.append(len(own_grams))
        packed.extend(own_grams if isinstance(own_grams, list) else own_grams.tolist())
    size, gram = np.array(sizes, np.int32), np.frombuffer(packed, np.int32)
    of_word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    del known
    starts = np.r_[0, np.cumsum(size)[:-1]]
    n_docs, n_words = len(texts), len(size)
    in_docs = np.bincount(gram, np.bincount(word, minlength=n_words)[of_word], BUCKETS)
    each = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum())).astype(np.float32)

    random = np.random.default_rng(SEED)
    table = (random.standard_normal((DIM, BUCKETS)) * START).astype(np.float32)
    heard = (in_docs >= MIN_DOCS).astype(np.float32)  # n-grams of a few texts say nothing of other texts
    table *= heard
    top, bias = (random.standard_normal(DIM) * 0.5).astype(np.float32), 0.0
    first, second = np.zeros_like(table), np.zeros_like(table)
    top_first, top_second = np.zeros(DIM + 1, np.float32), np.zeros(DIM + 1, np.float32)
    for step in range(1, EPOCHS + 1):
        mean = np.empty((DIM, n_docs), np.float32)
        for k in range(DIM):
            of_words = np.add.reduceat(table[k][gram], starts) / size
            mean[k] = np.bincount(doc, of_words[word] * share, n_docs)
        wrong = (1 / (1 + np.exp(-np.clip(top @ mean * SCALE + bias, -30, 30))) - toxic) * each
        top_step = np.r_[mean @ wrong * SCALE, wrong.sum()].astype(np.float32)
        by_word = np.bincount(word, (wrong[doc] * share), n_words) / size * SCALE
        by_bucket = np.bincount(gram, by_word[of_word], BUCKETS).astype(np.float32)
        fade = np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * RATE
        for k in range(DIM):
            slope = by_bucket * top[k] * heard
            first[k] += 0.1 * (slope - first[k])
            second[k] += 0.001 * (slope * slope - second[k])
            table[k] -= fade * first[k] / (np.sqrt(second[k]) + 1e-8) + RATE * DECAY * table[k]
        top_first += 0.1 * (top_step - top_first)
        top_second += 0.001 * (top_step * top_step - top_second)
        moved = fade * top_first / (np.sqrt(top_second) + 1e-8)
        top -= moved[:DIM]
        bias -= float(moved[DIM])
    return Model((top @ table * SCALE).astype(np.float32), bias)


#: Logits are means over a text's words; this lets a few words of many speak.
SCALE = 64.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        value = float(self.model.weight[buckets(word)].mean())
        if len(word) < 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = value
        return value

    def logit(self, text: str | None) -> float:
        """A text without words has the bias alone."""
        known, word, parts = self.known.get, self.word, split(text)
        total = 0.0
        for w in parts:
            value = known(w)
            total += word(w) if value is None else value
        return total / max(1, len(parts)) + self.model.bias

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, self.logit(text))))))


def even_cut(logits: np.ndarray, toxic: np.ndarray) -> float:
    """Where to cut so that the share of toxic rows below and of clean rows above are as near to equal as they come."""
    values = np.unique(logits)
    bad, good = np.sort(logits[toxic > 0]), np.sort(logits[toxic == 0])
    missed = np.searchsorted(bad, values) / len(bad)
    blamed = (len(good) - np.searchsorted(good, values)) / len(good)
    at = int(np.argmax(missed >= blamed))
    return float(values[max(0, at - 1)] + values[at]) / 2


def calibrated(texts: list[str | None], toxic: np.ndarray) -> Model:
    """``fit`` on all rows, its bias moved by the cut that two models, each fitted on one half, find on the other half."""
    toxic = np.asarray(toxic, np.float32)
    model = fit(texts, toxic)
    if min((toxic > 0).sum(), (toxic == 0).sum()) < LEAST:
        return model
    half = np.zeros(len(toxic), bool)
    for k in (0, 1):
        half[np.flatnonzero(toxic == k)[::2]] = True
    logits = np.empty(len(toxic))
    for own in (half, ~half):
        scorer = Scorer(fit([texts[i] for i in np.flatnonzero(~own)], toxic[~own]))
        logits[own] = [scorer.logit(texts[i]) for i in np.flatnonzero(own)]
    return Model(model.weight, model.bias - even_cut(logits, toxic))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic) of the rows to learn from: labelled 0 or 1, not held out, at most ``per_class`` of each label.

    Rows without a label, with a null id or any other label are not used; an id that is labelled twice counts twice.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_rest(F.col("id"), FOLD) != HELD_OUT))
    chosen = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class rows of two numbers: a bounded side
    return docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("id")).select("id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = sample(docs, labels, per_class).collect()  # bounded by per_class
    rows.sort(key=lambda r: (r["id"], r["text"] or "", r["toxic"]))
    return calibrated([r["text"] for r in rows], np.array([r["toxic"] for r in rows]))


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each input row, from whole texts alone.

    Null texts count as empty; a null id is held out as the empty string is. Nothing is shuffled.
    """
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_rest(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the model trained on ``labels`` does not predict toxic."""
    shipped = spark.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
