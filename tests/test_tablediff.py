from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronofact.operators import tablediff


def trees(spark, tmp_path, left, right, kind="k long, v string"):
    paths = [str(tmp_path / side) for side in ("left", "right")]
    for rows, path in zip((left, right), paths, strict=True):
        tablediff.write_tree(spark.createDataFrame(rows, kind), path, "k", F.to_json(F.struct("v")))
    return paths


def test_changed_lost_added_and_repeated(spark, tmp_path):
    left = [(i, f"v{i}") for i in range(2_000)] + [(None, "n"), (7, "again"), (9, "twice"), (9, "twice")]
    right = [(i, f"v{i}" if i != 50 else "other") for i in range(1, 2_000)] + [(None, "n"), (9_999, "new"), (7, "again"), (9, "twice"), (8, "v8")]
    got = {(r["key"], r["state"]) for r in tablediff.differences(spark, *trees(spark, tmp_path, left, right)).collect()}
    # 9 lost one of its repeats, 8 has one more
    assert got == {(0, "lost"), (50, "changed"), (9_999, "added"), (9, "changed"), (8, "changed")}


def test_null_key_against_none(spark, tmp_path):
    got = tablediff.differences(spark, *trees(spark, tmp_path, [(None, "n"), (1, "a")], [(1, "a")])).collect()
    assert [tuple(r) for r in got] == [(None, "lost")]


@pytest.mark.parametrize("left,right,want", [([], [], 0), ([(1, "a")], [], 1), ([], [(1, "a")], 1), ([(1, "a")], [(1, "a")], 0), ([(1, None)], [(1, "")], 1)])
def test_small_tables(spark, tmp_path, left, right, want):
    assert len(tablediff.differences(spark, *trees(spark, tmp_path, left, right)).collect()) == want


def test_equal_blocks_are_not_read(spark, tmp_path):
    left = [(i, f"v{i}") for i in range(3_000)]
    right = [(i, f"v{i}" if i not in (5, 1_234) else "x") for i in range(3_000)]
    paths = trees(spark, tmp_path, left, right)
    tops = spark.read.parquet(f"{paths[0]}/rows").where("key in (5, 1234)").select("top").distinct().collect()
    live, spoiled = {r[0] for r in tops}, 0
    for path in paths:
        for part in Path(path, "rows").glob("top=*/*.parquet"):
            if part.parent.name.split("=")[1] not in live:
                part.write_bytes(b"nobody reads this")
                (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
                spoiled += 1
    assert spoiled > 300
    got = {tuple(r) for r in tablediff.differences(spark, *paths).collect()}
    assert got == {(5, "changed"), (1_234, "changed")}
    same = [paths[0], paths[0]]
    assert tablediff.differences(spark, *same).count() == 0
