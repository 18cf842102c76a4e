"""Toxicity by non-negative positive-unlabelled learning.

The only labels that count are confirmed toxic documents. The rest of the
corpus is unlabelled: a mixture in which a known share, the class prior, is
toxic. The risk on clean text is the risk on unlabelled text minus the toxic
part of it, and where that estimate falls below zero the step is reversed, so
the classifier cannot win by memorising. It is linear over the distinct words
of a text and their beginnings, sparse, trained in numpy.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7, 8)
#: Numbers of different words with the same beginning that count as features of their own.
LEVELS = (1, 2, 4, 8)
USUAL_WORDS = 200
THRESHOLD = 0.7
#: Bounds of the sample that the classifier is fitted on: different confirmed toxic rows and unlabelled rows,
#: characters of all of each, and of a row. Every row is scored, whole.
MAX_POSITIVE = 2_000
MAX_UNLABELLED = 4_000
MAX_POSITIVE_CHARS = 8 << 20
MAX_UNLABELLED_CHARS = 32 << 20
MAX_FIT_CHARS = 64_000
MIN_SUPPORT = 3
MIN_EXCESS = 4.0
EPOCHS = 300
RATE = 0.1
SPARSITY = 5e-6
#: Words that a worker remembers.
MEMORY = 500_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings, each marked by kind; the low bits are free for a level."""
    kinds = [f"={word}", *[f"{n}{word[:n]}" for n in STEMS if len(word) > n]]
    return [(xxhash.xxh64_intdigest(k) - (1 << 63)) & ~3 for k in kinds]


def text_words(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def levelled(counts: Mapping[int, int], words: int) -> list[int]:
    """One feature per hash and per number of different words of the text that it reaches.

    Beyond one word, the number grows with the text, where chance finds more.
    """
    long = max(1.0, words / USUAL_WORDS)
    steps = [least * long if level else least for level, least in enumerate(LEVELS)]
    return [f | level for f, n in counts.items() for level, least in enumerate(steps) if n >= least]


def text_features(text: str | None) -> np.ndarray:
    words = text_words(text)
    found = levelled(Counter(f for w in words for f in word_features(w)), len(words))
    return np.fromiter(found, np.int64, len(found))


@dataclass(frozen=True)
class Model:
    """``logit = bias + sum of weights`` over the distinct features of a text."""

    bias: float
    weights: dict[int, float]

    @functools.cached_property
    def levels(self) -> frozenset[int]:
        return frozenset(self.weights)

    def score(self, words: set[str], known: dict[str, tuple[int, ...]]) -> float:
        hits: Counter[int] = Counter()
        for word in words:
            found = known.get(word)
            if found is None:
                found = tuple(f for f in word_features(word) if not self.levels.isdisjoint((f, f | 1, f | 2, f | 3)))
                if len(known) < MEMORY:
                    known[word] = found
            if found:
                hits.update(found)
        # in a fixed order, so that reruns give the same bits
        logit = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(levelled(hits, len(words))))
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))))


def _rows(docs: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``vocabulary`` and the row that each belongs to."""
    lengths = [len(d) for d in docs]
    ids = np.concatenate([*docs, np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(docs)), lengths)
    at = np.minimum(np.searchsorted(vocabulary, ids), max(len(vocabulary) - 1, 0))
    ok = vocabulary[at] == ids if len(vocabulary) else np.zeros(len(ids), bool)
    return at[ok], owner[ok]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, epochs: int = EPOCHS,
        rate: float = RATE, sparsity: float = SPARSITY) -> Model:
    """Minimise the non-negative risk with the logistic loss and a sparsity penalty.

    Weights are not negative: words may speak for toxicity, never against it.

    Features must occur in ``MIN_SUPPORT`` toxic rows, and in more of them by
    ``MIN_EXCESS`` deviations than their share of unlabelled rows lets expect. Without toxic or unlabelled rows the score is the prior.
    """
    prior = float(np.clip(prior, 1e-4, 0.6))
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(bias, {})
    ids, support = np.unique(np.concatenate(positive), return_counts=True)
    ids, support = ids[support >= MIN_SUPPORT], support[support >= MIN_SUPPORT]
    at, _ = _rows(unlabelled, ids)
    spread = np.bincount(at, minlength=len(ids))
    expected = len(positive) * (spread + 0.5) / (len(unlabelled) + 1)
    vocabulary = ids[support - expected > MIN_EXCESS * np.sqrt(expected + 0.5)]
    if not len(vocabulary):
        return Model(bias, {})
    (pi, pr), (ui, ur) = _rows(positive, vocabulary), _rows(unlabelled, vocabulary)
    w, b, n = np.zeros(len(vocabulary)), bias, len(vocabulary)
    first, second, bm, bv = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, epochs + 1):
        gp = b + np.bincount(pr, w[pi], len(positive))
        gu = b + np.bincount(ur, w[ui], len(unlabelled))
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # slopes of the toxic risk and of the estimated clean risk
        toxic_p = prior * (sp - 1) / len(positive)
        clean_u, clean_p = su / len(unlabelled), -prior * sp / len(positive)
        if clean >= 0:
            dp, du = toxic_p + clean_p, clean_u
        else:
            dp, du = -clean_p, -clean_u
        grad = np.bincount(pi, dp[pr], n) + np.bincount(ui, du[ur], n)
        gb = dp.sum() + du.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        bm, bv = 0.9 * bm + 0.1 * gb, 0.999 * bv + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(second / c2) + 1e-9)
        w -= scale * first / c1
        w = np.maximum(w - scale * sparsity, 0)
        b -= rate * (bm / c1) / (np.sqrt(bv / c2) + 1e-9)
    used = np.flatnonzero(w > 1e-3)
    return Model(float(b), {int(vocabulary[i]): float(w[i]) for i in used})


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on confirmed toxic rows and unlabelled rows that are not held out.

    The class prior is the toxic share of all labels that are not held out.
    Rows, not ids, are chosen, by a hash of id and text, so reruns agree and
    an id that owns much of the table counts no more than its different texts
    do; null ids and null labels teach nothing, and of repeated labels the
    highest counts.
    """
    spark = docs.sparkSession
    open_labels = (labels.where(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(toxic).isNotNull())
                   .groupBy(F.col(key).alias("_id")).agg(F.max(toxic).alias("_toxic")))
    prior = open_labels.agg(F.avg((F.col("_toxic") > 0).cast("double"))).first()[0]
    # a bounded number of ids, so they may be broadcast
    chosen = open_labels.where("_toxic > 0").orderBy(F.xxhash64("_id"), "_id").limit(MAX_POSITIVE).select("_id")
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= MAX_FIT_CHARS)
    positive = _features(sampled(texts.join(F.broadcast(chosen), "_id"), "toxic", MAX_POSITIVE, MAX_POSITIVE_CHARS))
    # of unlabelled rows only what toxic rows have often enough comes to the driver
    ids, support = np.unique(np.concatenate([np.empty(0, np.int64), *positive]), return_counts=True)
    wanted = spark.sparkContext.broadcast(ids[support >= MIN_SUPPORT])
    free = texts.where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    unlabelled = _features(sampled(free, "unlabelled", MAX_UNLABELLED, MAX_UNLABELLED_CHARS), wanted)
    return fit(positive, unlabelled, prior if prior is not None else 0.0)


def sampled(rows: DataFrame, salt: str, most_rows: int, most_chars: int) -> DataFrame:
    """``_hash, _text`` of at most ``most_rows`` different rows (``_id, _text``) with at most ``most_chars`` characters together.

    Those with the smallest hash. Only hashes and lengths are sorted; copies
    are merged where they lie, before anything moves.
    """
    keyed = rows.select(F.xxhash64(F.lit(salt), "_id", "_text").alias("_hash"), "_text")
    first = (keyed.groupBy("_hash").agg(F.max(F.length("_text")).alias("_n")).orderBy("_hash").limit(most_rows).collect())
    lengths = np.cumsum([r["_n"] for r in first]) if first else np.empty(0)
    chosen = [r["_hash"] for r, n in zip(first, lengths, strict=True) if n <= most_chars]
    if not chosen:
        return keyed.limit(0)
    # the hashes come in order, so all rows up to the last one are meant
    return keyed.where(F.col("_hash") <= chosen[-1]).groupBy("_hash").agg(F.min("_text").alias("_text"))


def _features(sample: DataFrame, wanted: Broadcast | None = None) -> list[np.ndarray]:
    """The features of each row of a bounded sample, in a fixed order; those in ``wanted`` if it is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column("_text").to_pylist():
                found = text_features(value)
                packed.append((found if wanted is None else np.intersect1d(found, wanted.value, assume_unique=True)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_hash"), pa.array(packed, pa.binary())], ["_hash", "features"])

    rows = sample.select("_hash", "_text").mapInArrow(run, "_hash bigint, features binary").collect()
    return [np.frombuffer(r["features"], np.int64) for r in sorted(rows, key=lambda r: r["_hash"])]


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``, the probability that a whole text is toxic, replacing such a column.

    Nulls and empty texts get the score of no words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != into]
    schema = docs.select(*[f"`{f.name}`" for f in kept], F.lit(0.0).alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [shared.value.score(text_words(t), known) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(found, pa.float64())],
                                             [*[f.name for f in kept], into])

    return docs.mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    scored = score(docs, train(docs, labels, key=key, text=text), text=text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
