"""Constant-time placement by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table, and
the shards take turns claiming the next free slot. Every shard gets the same
number of slots up to one, and a shard that leaves moves little else. The
table has a fixed size, whatever the data, and travels with the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .columns import digest_long

SLOTS = 65_537
SLOTS_PER_SHARD = 100


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _walk(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the owning shard for every slot.

    ``slots`` must be prime, so that every step size visits all slots, and at
    least a hundred per shard, so that shares differ by at most one percent.
    """
    if len(set(shards)) != len(shards) or not 0 < len(shards) < 65_536:
        raise ValueError("shards must be 1 to 65,535 different names")
    if not is_prime(slots) or slots < SLOTS_PER_SHARD * len(shards):
        raise ValueError(f"slots must be a prime of at least {SLOTS_PER_SHARD} per shard")
    walks = [_walk(name, slots) for name in shards]
    owner, steps, claimed = [-1] * slots, [0] * len(shards), 0
    while True:
        for shard, (start, skip) in enumerate(walks):
            slot = (start + steps[shard] * skip) % slots
            while owner[slot] >= 0:
                steps[shard] += 1
                slot = (start + steps[shard] * skip) % slots
            owner[slot] = shard
            steps[shard] += 1
            claimed += 1
            if claimed == slots:
                return owner


def packed(table: Sequence[int]) -> bytes:
    """Two bytes a slot, the form that the plan carries."""
    return b"".join(shard.to_bytes(2, "big") for shard in table)


def slot_of(key: Column, salt: Column | None = None, slots: int = SLOTS) -> Column:
    """The slot of a key; null is a key of its own. ``salt`` spreads one key over many slots."""
    text = F.coalesce(key.cast("string"), F.lit("\x00"))
    return F.pmod(digest_long(text if salt is None else F.concat_ws("\x01", text, salt.cast("string"))), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], *, salt: Column | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of these names are replaced.

    Nothing moves and no row is lost. Rows of equal keys share a shard, null
    keys too. Where one key owns more rows than a shard should hold, pass a
    ``salt`` of a few values, such as a hash of the row id modulo the number
    of parts that the key needs.
    """
    table = F.lit(packed(lookup_table(shards, slots)))
    slotted = df.withColumn("slot", slot_of(F.col(key), salt, slots))
    two = F.substring(table, F.col("slot") * 2 + 1, F.lit(2))
    return slotted.withColumn("shard", F.conv(F.hex(two), 16, 10).cast("int"))


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard below ``path``, each of about ``files_per_shard`` files of even size."""
    part = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
