"""Near copies among embeddings by spherical-cap filters.

Directions come from a structured random product code: after a random
rotation a vector is cut into blocks, each block has its own random code, and
a filter is one code word per block. List decoding finds all filters whose
direction a vector exceeds by a threshold without looking at all of them.
Vectors with a filter in common are compared by sign sketches, and what is
left is verified by cosine in double precision.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .near import candidate_edges, components, linked_classes, stored

COSINE = 0.93
SKETCH_WORDS = 2
#: Filters that a vector exceeds on average, in all codes together.
FILTERS_PER_VECTOR = 30
CODES = 3
#: Unrelated vectors of a label that a filter holds on average.
BUCKET = 4.0
#: Below a vector's best score, in deviations of a random score.
MARGIN = 0.4
#: Code words of a block; with more, a code has another block.
WORDS = 1_000
#: Entries of a matrix of scores while vectors are decoded, whatever their number and that of the words.
ENTRIES = 1 << 20
SEED = 20_240_601


@dataclass(frozen=True)
class Code:
    """``words`` code words for each of ``parts`` blocks, and the least score of a filter."""

    dims: int
    parts: int
    words: int
    least: float

    @staticmethod
    def for_rows(dims: int, rows: int, filters: float = FILTERS_PER_VECTOR / CODES) -> Code:
        """A filter holds a share of ``BUCKET / rows`` of random vectors, and each vector is in about ``filters``."""
        share = min(0.05, BUCKET / max(rows, 1))
        parts = 1 if dims < 8 else 2
        while parts > 1 and parts < dims // 8 and (filters / share) ** (1 / parts) > WORDS:
            parts += 1
        words = max(4, round((filters / share) ** (1 / parts)))
        return Code(dims, parts, words, NormalDist().inv_cdf(1 - share) / math.sqrt(dims))


@functools.lru_cache(32)
def directions(code: Code, which: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and each block's code words, scaled so that a filter has length one on average."""
    rng = np.random.default_rng([SEED, which, code.dims])
    rotation, upper = np.linalg.qr(rng.normal(size=(code.dims, code.dims)))
    rotation *= np.sign(np.diag(upper))
    sizes = [len(p) for p in np.array_split(np.arange(code.dims), code.parts)]
    return rotation, [rng.normal(0, 1 / math.sqrt(code.dims), (code.words, s)) for s in sizes]


def list_decode(unit: np.ndarray, code: Code, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter that a row of unit vectors exceeds.

    Block by block, partial sums that cannot reach the threshold even with the
    best word in all later blocks are dropped. Where a vector lies far from
    all directions, its threshold is ``MARGIN`` below its best score, so that
    no vector is left without filters. No matrix has more than ``ENTRIES``
    entries: rows are taken in slices, and partial sums again in each block.
    """
    step = max(1, ENTRIES // code.words)
    found = [_decode_slice(unit[start:start + step], code, which) for start in range(0, len(unit), step)]
    rows = [row + k * step for k, (row, _) in enumerate(found)]
    return (np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*[c for _, c in found], np.empty(0, np.int64)]).astype(np.int64))


def _decode_slice(unit: np.ndarray, code: Code, which: int) -> tuple[np.ndarray, np.ndarray]:
    rotation, words = directions(code, which)
    turned = unit @ rotation
    parts = np.array_split(np.arange(code.dims), code.parts)
    scores = [turned[:, p] @ w.T for p, w in zip(parts, words, strict=True)]
    best = [s.max(1) for s in scores]
    least = np.minimum(code.least, sum(best, np.zeros(len(unit))) - MARGIN / math.sqrt(code.dims))
    step = max(1, ENTRIES // code.words)
    row, chosen, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for k, score in enumerate(scores):
        rest = sum(best[k + 1:], np.zeros(len(unit)))
        kept = []
        for start in range(0, len(row), step):
            r, t = row[start:start + step], total[start:start + step]
            sums = t[:, None] + score[r]
            at, word = np.nonzero(sums + rest[r, None] >= least[r, None])
            kept.append((r[at], chosen[start + at] * code.words + word, sums[at, word]))
        row, chosen, total = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (row, chosen, total)
    return row, chosen


@functools.lru_cache(32)
def planes(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, 99, dims]).normal(size=(dims, 64 * SKETCH_WORDS))


def sketch(unit: np.ndarray) -> np.ndarray:
    """Sides of random planes, packed into 64-bit words."""
    return np.packbits(unit @ planes(unit.shape[1]) > 0, 1, bitorder="little").view(np.uint64)


def most_different(cosine: float, bits: int = 64 * SKETCH_WORDS, deviations: float = 6.0) -> int:
    """Bits in which a pair at the threshold differs, with ``deviations`` to spare."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def usable(df: DataFrame, embedding: str, label: str) -> Column:
    """Label and vector are not null, no component is null or not finite, and not all are zero."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    value = F.transform(F.col(embedding), lambda x: x.cast("double"))
    return (F.col(label).isNotNull() & F.coalesce(F.forall(value, finite), F.lit(False))
            & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False)))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _stack(batch: pa.RecordBatch | pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(v, np.float64) for v in batch.column(name).to_pylist()]


def cosine_kernel(least: float):
    """Pairs of a block with cosine of at least ``least``; the vectors of a group have one length."""
    def run(group: pa.Table) -> np.ndarray:
        x = np.stack(_stack(group, "vector"))
        unit = unit_rows(x)
        found = unit @ unit.T
        # what rounding may have decided is computed again, pair by pair
        for i, j in np.argwhere(np.abs(found - least) < 1e-9):
            found[i, j] = math.fsum(x[i] * x[j]) / math.sqrt(math.fsum(x[i] ** 2) * math.fsum(x[j] ** 2))
        return found >= least
    return run


def near_embeddings(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link if labels are equal, lengths are equal and the cosine reaches
    ``cosine``. Rows without a usable label or vector link with nothing. Equal
    vectors are compared once and counted by their copies. ``component_id`` is
    the smallest key reachable; a null key has a null component and is never
    the smallest. Other columns are not looked at.
    """
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).cast("string").alias("_label"),
                          F.transform(F.col(embedding), lambda x: x.cast("double")).alias("_v"),
                          usable(vectors, embedding, label).alias("_ok"))
    marked = rows.withColumn("_print", F.when(F.col("_ok"), F.sha2(F.concat_ws("|", "_label", F.to_json(F.struct(
        F.transform("_v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("v")))), 256)))
    reps = stored(marked.where("_ok").groupBy("_print").agg(
        F.count("*").alias("copies"), F.min("_key").alias("least_key"), F.first("_label").alias("label"), F.first("_v").alias("v")
    ).withColumn("member", F.monotonically_increasing_id()), "cap-vectors")
    sizes = {(r["label"], r["d"]): r["n"] for r in reps.groupBy("label", F.size("v").alias("d")).count()
             .withColumnRenamed("count", "n").orderBy(F.desc("n")).limit(1).collect()}
    largest = max(sizes.values(), default=0)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").to_pylist()
            members, labels = np.asarray(batch.column("member")), batch.column("salt").to_numpy()
            for d in sorted({len(v) for v in lists}):
                at = np.array([i for i, v in enumerate(lists) if len(v) == d])
                unit = unit_rows(np.array([lists[i] for i in at], np.float64))
                bits = sketch(unit).view(np.int64)
                code = Code.for_rows(d, largest)
                for which in range(CODES):
                    row, chosen = list_decode(unit, code, which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), which, np.int32)), pa.array(chosen), pa.array(np.full(len(row), d, np.int32)),
                         pa.array(labels[at[row]]), pa.array(members[at[row]]), pa.array(bits[row, 0]), pa.array(bits[row, 1])],
                        ["which", "chosen", "d", "salt", "member", "b0", "b1"])

    decoded = reps.select("member", "v", F.xxhash64("label").alias("salt")).mapInArrow(
        filters, "which int, chosen bigint, d int, salt bigint, member bigint, b0 bigint, b1 bigint")
    bucketed = decoded.select(F.xxhash64("which", "chosen", "d", "salt").alias("bucket"), "member", "b0", "b1")
    groups = components(candidate_edges(bucketed, ["b0", "b1"], most_different(cosine)), "cap-candidates")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, np.float64).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("member"), batch.column("copies"), pa.array(raw, pa.binary())],
                                             ["root", "member", "copies", "vector"])

    # groups are split by label and length, so that a kernel sees one length only
    chosen = stored(groups.join(reps, "member").select(
        F.xxhash64("root", "label", F.size("v")).alias("root"), "member", "copies", "v"), "cap-groups")
    grouped = chosen.mapInArrow(packed, "root bigint, member bigint, copies bigint, vector binary")
    classes = linked_classes(grouped, cosine_kernel(cosine), chosen.select("root", "member"), "cap-classes")
    smallest = classes.join(reps.select("member", "least_key"), "member").groupBy("root").agg(F.min("least_key").alias("component_key"))
    known = (reps.select("_print", "member", "copies", "least_key").join(classes, "member", "left").join(smallest, "root", "left")
             .select("_print", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
                     F.coalesce("component_key", "least_key").alias("component_id")))
    joined = marked.select("_key", "_print").join(known, "_print", "left")
    component = F.coalesce("component_id", "_key")
    return joined.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"))
