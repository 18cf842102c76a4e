"""Groups of near copies: bucketed sketches, candidate groups, exact links.

Items share a bucket if a filter or path says so. Inside a bucket, sketches
that differ in few bits join; only a spanning forest leaves the task, so a
large group costs edges in proportion to its members. The connected candidates
are then compared exactly, all with all inside a candidate group, and again
only counts and a forest leave. Buckets and groups that are too large for one
task are cut into blocks, and each pair of blocks becomes a task of its own;
nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import fits_broadcast
from ..session import scratch_path

BUCKET_BLOCK = 1_024
GROUP_BLOCK = 256


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cut lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(rows: DataFrame, key: str, member: str, size: int, light: DataFrame | None = None) -> DataFrame:
    """``rows`` grouped on disk by ``key, _i, _j``: every pair of a key's members meets in one group.

    Keys of up to about ``size`` rows are one group. Larger ones are dealt into
    blocks by a hash of ``member``; the row of block ``b`` goes to the pairs of
    ``b`` with every block, and ``_b`` tells the blocks of a pair apart. The
    sizes are estimated beforehand, on the members whose hash falls into one
    class, so that no task ever holds a whole large key. ``light`` has the keys
    and members of ``rows`` where ``rows`` are costly to compute.
    """
    rate = max(1, size // 16)
    counted = ((rows if light is None else light).where(F.pmod(F.xxhash64(member), F.lit(rate)) == 0)
               .groupBy(key).agg((F.count("*") * rate).alias("_n")).where(F.col("_n") > size))
    large = stored(counted.select(key, F.ceil(F.col("_n") / size).cast("int").alias("_parts")), "large-keys")
    known = rows.join(F.broadcast(large) if fits_broadcast(large) else large, key, "left")
    dealt = (known.withColumn("_parts", F.coalesce("_parts", F.lit(1)))
             # not the hash of the estimate, whose members share a class
             .withColumn("_b", F.pmod(F.xxhash64(F.lit("block"), member), F.col("_parts")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
             .withColumns({"_i": F.least("_b", "_other"), "_j": F.greatest("_b", "_other")}).drop("_parts", "_other"))
    return dealt.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows; a group that a batch cuts is held back until it ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = _marks(batch, key)
        changes = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
        if held and tuple(marks[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            cut = int(changes[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = tuple(marks[-1])
    if held:
        yield pa.Table.from_batches(held)


def _marks(rows: pa.RecordBatch | pa.Table, key: str) -> np.ndarray:
    return np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in (key, "_i", "_j")], 1)


def _bounds(rows: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    marks = _marks(rows, key)
    starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist()]
    yield from zip(starts, [*starts[1:], len(marks)], strict=True)


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix, by breadth-first search."""
    n = len(adjacent)
    free = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            now = queue.pop()
            found = np.flatnonzero(adjacent[now] & free)
            free[found] = False
            out.extend((now, int(k)) for k in found)
            queue.extend(found.tolist())
    return out


def alike(bits: np.ndarray, most: int) -> np.ndarray:
    """Which rows of 64-bit words differ from which in at most ``most`` bits."""
    n = len(bits)
    out = np.zeros((n, n), np.uint16)
    for word in bits.T:
        out += np.bitwise_count(word[:, None] ^ word[None, :])
    return out <= most


def candidate_edges(rows: DataFrame, bits: Sequence[str], most: int, size: int = BUCKET_BLOCK) -> DataFrame:
    """Forest edges ``a, b`` between members of equal ``bucket`` whose sketches are alike.

    ``rows`` has ``bucket``, ``member`` and the 64-bit sketch columns, all long.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "bucket"):
            members = np.asarray(rows.column("member"))
            words = np.stack([np.asarray(rows.column(c)) for c in bits], 1).view(np.uint64)
            bounds = np.array(list(_bounds(rows, "bucket")))
            twos = bounds[bounds[:, 1] - bounds[:, 0] == 2, 0]
            near = np.bitwise_count(words[twos] ^ words[twos + 1]).sum(1) <= most
            left, right = [members[twos[near]]], [members[twos[near] + 1]]
            for start, end in bounds[bounds[:, 1] - bounds[:, 0] > 2]:
                edges = np.array(forest(alike(words[start:end], most)), np.int64).reshape(-1, 2)
                left.append(members[start + edges[:, 0]])
                right.append(members[start + edges[:, 1]])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    found = in_blocks(rows, "bucket", "member", size).mapInArrow(run, "a bigint, b bigint")
    return found.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``member, root``: the smallest member reachable, for every member of an edge.

    Alternating star contraction: each member's larger neighbours are hung on
    its smallest, then each member and its smaller neighbours are. A round is
    two aggregations with partial sums and two joins; it is stored, so lost
    executors cost a round at most. The number of rounds grows with the logarithm.
    """
    now = stored(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), label)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("member"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("member"), F.col("b").alias("root"))).distinct()
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)


Kernel = Callable[[pa.Table], np.ndarray]


def exact_links(rows: DataFrame, kernel: Kernel, light: DataFrame, size: int = GROUP_BLOCK) -> DataFrame:
    """``a, b, n``: what each member is linked with, and a forest of the links.

    ``rows`` has ``root`` (the candidate group), ``member``, ``copies`` and what
    ``kernel`` needs to tell for each pair of rows of a table whether they link;
    ``light`` has ``root`` and ``member`` only.
    Rows with ``b`` null carry in ``n`` the copies linked with ``a`` in one pair
    of blocks; the others are edges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "root"):
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            counted: list[np.ndarray] = []
            for start, end in _bounds(rows, "root"):
                group = rows.slice(start, end - start)
                linked = kernel(group)
                np.fill_diagonal(linked, False)
                members, block = np.asarray(group.column("member")), np.asarray(group.column("_b"))
                if group.column("_i")[0].as_py() != group.column("_j")[0].as_py():
                    linked &= block[:, None] != block[None, :]
                copies = np.asarray(group.column("copies")).astype(np.int64)
                left.append(members)
                right.append(np.full(len(members), -1))
                counted.append(linked @ copies)
                edges = np.array(forest(linked), np.int64).reshape(-1, 2)
                left.append(members[edges[:, 0]])
                right.append(members[edges[:, 1]])
                counted.append(np.full(len(edges), -1))
            n = np.concatenate(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(left)), pa.array(np.concatenate(right), mask=n >= 0), pa.array(n, mask=n < 0)], ["a", "b", "n"])

    return in_blocks(rows, "root", "member", size, light).mapInArrow(run, "a bigint, b bigint, n bigint")


def linked_classes(rows: DataFrame, kernel: Kernel, light: DataFrame, label: str, size: int = GROUP_BLOCK) -> DataFrame:
    """``member, n_links, root`` for members with a link: copies linked directly, and the smallest member reachable."""
    links = stored(exact_links(rows, kernel, light, size), f"{label}-links")
    counts = links.where("b is null").groupBy(F.col("a").alias("member")).agg(F.sum("n").alias("n_links")).where("n_links > 0")
    return counts.join(components(links.where("b is not null").select("a", "b"), label), "member")
