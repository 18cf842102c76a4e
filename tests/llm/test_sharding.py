import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronofact.llm import sharding

NAMES = [f"shard-{i:03d}" for i in range(64)]


def brute(names, slots):
    """Preference lists written out in full."""
    lists = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        start, skip = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
        lists.append([(start + k * skip) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for shard, prefers in enumerate(lists):
            free = next((s for s in prefers if s not in owner), None)
            if free is not None and len(owner) < slots:
                owner[free] = shard
    return [owner[s] for s in range(slots)]


def test_table_equals_brute_force():
    assert sharding.lookup_table(NAMES[:5], 503) == brute(NAMES[:5], 503)


def test_slots_are_even_and_a_lost_shard_moves_little():
    full = sharding.lookup_table(NAMES)
    counts = Counter(full).values()
    assert max(counts) - min(counts) <= 1
    less = sharding.lookup_table(NAMES[:-1])
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 63)
    assert moved < 0.03 * sharding.SLOTS


@pytest.mark.parametrize("names, slots", [([], 503), (["a", "a"], 503), (["a"], 500), (NAMES, 503)])
def test_bad_settings(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_every_row_is_placed(spark):
    rows = [(i % 50 if i % 7 else None, i, "x") for i in range(500)]
    placed = sharding.place(spark.createDataFrame(rows, "k long, n long, shard string"), "k", NAMES).collect()
    table = sharding.lookup_table(NAMES)
    assert len(placed) == 500 and all(r["shard"] == table[r["slot"]] for r in placed)
    assert len({r["shard"] for r in placed if r["k"] is None}) == 1
    for r in placed[:20]:
        text = "\x00" if r["k"] is None else str(r["k"])
        assert r["slot"] == int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % sharding.SLOTS


def test_salt_splits_a_hot_key_and_files_hold_all(spark, tmp_path):
    rows = spark.range(2_000).select(F.lit("hot").alias("k"), "id")
    placed = sharding.place(rows, "k", NAMES, salt=F.pmod(F.xxhash64("id"), F.lit(40)))
    assert placed.select("shard").distinct().count() > 15
    sharding.write_shards(placed, str(tmp_path / "out"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2_000
    assert sharding.place(rows.limit(0), "k", NAMES).count() == 0
