"""Word n-gram Jaccard join by chosen paths.

Each set of shingles is embedded as a row of minhashes. From the root of a
run, a path goes on through one or two coordinates that a hash of the path so
far chooses, 1/similarity of them on average, and takes along the value found
there, so similar sets keep meeting while others part. After as many steps as
the input needs, the sets at the end of a path are few and are compared by
brute force; runs are repeated until a pair at the threshold is missed with a
probability of less than one minus the target recall. What sketches leave is
compared exactly, on whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import fits_broadcast
from .near import candidate_edges, components, linked_classes, stored
from .shingles import BASE, WIDTH, hash_functions, minhash, mixed, shingle_set

SIMILARITY = 0.8
COORDINATES = 64
TARGET_RECALL = 0.9999
#: Share of unrelated texts that agree in a coordinate, as shared passages make them.
UNRELATED = 0.1
#: Members that the end of a path has on average if a third of all sets share a passage.
LEAF = 100
SEED = 11


def depth_for(sets: int) -> int:
    """Steps after which a third of all sets, agreeing in ``UNRELATED`` of their coordinates, are ``LEAF`` at a path's end."""
    return max(2, math.ceil(math.log(max(sets / 3 / LEAF, 1), 1 / UNRELATED)))


def survival(depth: int, similarity: float) -> float:
    """The chance that two sets agreeing in ``similarity`` of the coordinates share an end of one run."""
    second, alive = 1 / SIMILARITY - 1, 1.0
    for _ in range(depth):
        one = similarity * alive
        alive = (1 - second) * one + second * (1 - (1 - one) ** 2)
    return alive


def runs_for(depth: int, recall: float = TARGET_RECALL, similarity: float = SIMILARITY, coordinates: int = COORDINATES) -> int:
    """Runs until the target recall at the threshold, over the chance that minhashes agree by luck or not."""
    chances = [math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k) for k in range(coordinates + 1)]
    alive = [survival(depth, k / coordinates) for k in range(coordinates + 1)]
    runs = 1
    while sum(p * (1 - s) ** runs for p, s in zip(chances, alive, strict=True)) > 1 - recall:
        runs += 1
    return runs


def chosen_paths(signatures: np.ndarray, depth: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) for the end of every path of every row of minhashes."""
    n, width = signatures.shape
    row = np.repeat(np.arange(n), runs)
    state = np.tile(mixed(np.arange(1, runs + 1, dtype=np.uint64)), n)
    extra = np.uint64(int((1 / SIMILARITY - 1) * 2**32))
    with np.errstate(over="ignore"):
        for _ in range(depth):
            drawn = mixed(state ^ np.uint64(0xA5A5A5A5))
            first = (drawn % np.uint64(width)).astype(np.int64)
            other = (mixed(drawn) % np.uint64(width - 1)).astype(np.int64)
            other += other >= first
            two = np.flatnonzero((drawn >> np.uint64(32)) < extra)
            rows, at = np.concatenate([row, row[two]]), np.concatenate([first, other[two]])
            now = np.concatenate([state, state[two]])
            row, state = rows, mixed(mixed(now + at.astype(np.uint64)) * np.uint64(BASE) + signatures[rows, at])
    return row, state


def most_different(similarity: float = SIMILARITY, bits: int = COORDINATES, deviations: float = 5.0) -> int:
    """Bits of one-bit minhashes in which a pair at the threshold differs, with ``deviations`` to spare."""
    p = (1 - similarity) / 2
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def prints(rows: DataFrame) -> DataFrame:
    """``_row, _key``, the 128-bit fingerprint ``hi, lo`` of the shingle set (null if empty) and its minhashes."""
    multipliers, offsets = hash_functions(COORDINATES, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi: list[int | None] = []
            lo: list[int | None] = []
            packed: list[bytes | None] = []
            for value in batch.column("_text").to_pylist():
                found = shingle_set(value)
                if len(found):
                    a, b = _fingerprint(found)
                    hi.append(a)
                    lo.append(b)
                    packed.append(minhash(found, multipliers, offsets).tobytes())
                else:
                    for column in (hi, lo, packed):
                        column.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_key"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                                              pa.array(packed, pa.binary())], ["_row", "_key", "hi", "lo", "minhashes"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.select("_row", "_key", "_text").mapInArrow(run, f"_row bigint, _key {kind}, hi bigint, lo bigint, minhashes binary")


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums of mixed shingles, each with the number of shingles mixed in."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        a = mixed(np.array([mixed(shingles).sum() + n], np.uint64))
        b = mixed(np.array([mixed(shingles ^ np.uint64(BASE)).sum() ^ n], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def jaccard_kernel(similarity: float):
    """Pairs of a block whose sets have the Jaccard similarity, from exact intersections."""
    def run(group: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        n, sizes = len(sets), np.array([len(s) for s in sets])
        ids, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        shared = np.zeros((n, n), np.float32)
        # columns that only one set has cannot be shared
        common = np.bincount(at, minlength=len(ids)) > 1
        column = np.cumsum(common) - 1
        keep = common[at]
        owner, column = owner[keep], column[at[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 1 << 14
        for start in range(0, int(common.sum()), width):
            a, b = np.searchsorted(column, [start, start + width])
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], column[a:b] - start] = 1
            shared += part @ part.T
        both = shared.astype(np.float64)
        return both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    return run


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` stored with ``_row``, a number that no other row has."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), label)


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``key, class_id, n_links, kept`` for every row of ``docs``.

    Two rows link if the sets of their five-word shingles have at least the
    given Jaccard similarity; a text of one to four words is one shingle. Rows
    with equal sets are compared once and counted by their copies.
    ``class_id`` is the smallest key reachable by links and ``kept`` marks its
    row. Null texts and texts without words link with nothing. A null key has
    the class of the others it links with, or null; rows that repeat a key are
    copies of each other if their texts agree. Other columns are not looked at.
    """
    rows = numbered(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")), "jaccard-rows")
    class_id = F.coalesce("class_id", "_key")
    return row_classes(rows, similarity).select(F.col("_key").alias(key), class_id.alias("class_id"), "n_links",
                                                F.coalesce(F.col("_key") == class_id, F.lit(False)).alias("kept"))


def row_classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``_row, _key, class_id, n_links, first`` for every row of ``numbered`` rows with ``_key`` and ``_text``.

    ``first`` marks one row of each class, whatever keys are null or repeat:
    the one with the smallest key, nulls last, and of those the smallest
    number. Rows without words are each a class. ``class_id`` is the key of
    the first row; null where a class has no key or the row no words.
    """
    printed = stored(prints(rows), "jaccard-prints")
    grouped = printed.where("hi is not null").groupBy("hi", "lo").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_row")).alias("least"), F.first("minhashes").alias("minhashes"))
    # the number of a stored row: no two sets share it, as they might a shorter hash
    reps = grouped.withColumn("member", F.col("least._row"))
    depth = depth_for(printed.count())
    runs = runs_for(depth, similarity=similarity)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                part = batch.slice(start, 2_048)
                signatures = np.frombuffer(b"".join(part.column("minhashes").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                members = np.asarray(part.column("member"))
                bits = np.packbits(signatures & 1, 1, bitorder="little").view(np.int64)[:, 0]
                row, path = chosen_paths(signatures.astype(np.uint64), depth, runs)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(members[row]), pa.array(bits[row])],
                                                 ["bucket", "member", "b0"])

    walked = reps.select("member", "minhashes").mapInArrow(paths, "bucket bigint, member bigint, b0 bigint")
    groups = components(candidate_edges(walked, ["b0"], most_different(similarity)), "jaccard-candidates")
    # the row that has the text of each candidate set
    chosen = stored(groups.join(reps.select("member", "copies", F.col("least._row").alias("_row")), "member"), "jaccard-groups")
    texts = rows.select("_row", "_text").join(F.broadcast(chosen) if fits_broadcast(chosen) else chosen, "_row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [shingle_set(t).tobytes() for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("member"), part.column("copies"), pa.array(found, pa.binary())],
                                                 ["root", "member", "copies", "shingles"])

    payload = texts.mapInArrow(sets, "root bigint, member bigint, copies bigint, shingles binary")
    classes = linked_classes(payload, jaccard_kernel(similarity), chosen.select("root", "member"), "jaccard-classes")
    smallest = classes.join(reps.select("member", "least"), "member").groupBy("root").agg(F.min("least").alias("class_least"))
    known = (reps.select("hi", "lo", "member", "copies", "least").join(classes, "member", "left").join(smallest, "root", "left")
             .select("hi", "lo", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
                     F.coalesce("class_least", "least").alias("least")))
    joined = printed.select("_row", "_key", "hi", "lo").join(known, ["hi", "lo"], "left")
    return joined.select("_row", "_key", F.col("least._key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         F.coalesce(F.col("least._row") == F.col("_row"), F.lit(True)).alias("first"))
