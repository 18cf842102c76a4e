import pytest
from pyspark.sql import functions as F

from chronofact import session
from chronofact.functions import instants
from chronofact.operators.skew import first_after, fits_broadcast, hot_buckets, last_before, lookup_join, slice_bounds


def test_nested_content_is_measured(spark):
    wide = spark.range(10).select("id", F.array_repeat(F.col("id"), 100_000).alias("a"))
    assert not fits_broadcast(wide, size=1 << 20)
    texts = spark.range(10).select(F.array(F.repeat(F.lit("x"), 200_000)).alias("a"))
    maps = spark.range(10).select(F.create_map("id", F.repeat(F.lit("x"), 200_000)).alias("m"))
    structs = spark.range(10).select(F.struct(F.repeat(F.lit("x"), 200_000).cast("binary").alias("b")).alias("s"))
    for df in (texts, maps, structs):
        assert not fits_broadcast(df, size=1 << 20) and fits_broadcast(df, size=4 << 20)
    assert fits_broadcast(spark.range(10)) and not fits_broadcast(spark.range(11), rows=10)
    nulls = spark.range(3).select(F.lit(None).cast("array<string>").alias("a"), F.lit(None).cast("string").alias("b"))
    assert fits_broadcast(nulls)


def test_what_cannot_be_measured_is_refused(spark):
    with pytest.raises(TypeError):
        fits_broadcast(spark.range(1).select(F.parse_json(F.lit("1")).alias("v")))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_utc_text_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql("SELECT '2026-03-08T02:30:00Z' a, '2026-09-16T00:00:00+07:00' b, '2026-11-01T05:30:00.25Z' c").select(
            instants.utc("a"), instants.utc("b"), instants.utc("c"), instants.utc_text(F.to_timestamp("a")),
            instants.utc_text(F.expr("timestamp_ntz'2026-03-08 02:30:00.000001'")), instants.utc(F.lit(None).cast("string"))).first()
        assert list(row) == ["2026-03-08T02:30:00.000000Z", "2026-09-15T17:00:00.000000Z", "2026-11-01T05:30:00.250000Z",
                             "2026-03-08T02:30:00.000000Z", "2026-03-08T02:30:00.000001Z", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_only_hot_keys_of_the_small_side_are_repeated(spark, how):
    big = spark.range(3_000).select(F.when(F.col("id") < 2_000, 7).when(F.col("id") < 2_500, None).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(2_900).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    assert len(hot_buckets(big, ["k"], 400)) == 2  # of the key 7 and of null
    want = big.join(F.broadcast(small), ["k"], how)
    for hot_rows in (400, 10_000):
        got = lookup_join(big, small, ["k"], how, small_fits=False, salt=F.col("id"), hot_rows=hot_rows)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if how != "left_semi":
        plain = lookup_join(big, small, ["k"], how, small_fits=False, salt=F.col("id"))
        assert "explode" not in plain._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot_rows", [0, 150, 10_000])
def test_neighbours_are_the_same_whichever_keys_are_cut(spark, hot_rows):
    rows = spark.range(1_000).select(
        F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 500).alias("t"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v")).localCheckpoint()
    bounds = slice_bounds(rows, "t", 60)
    assert len(bounds) > 10 and bool(slice_bounds(rows, "t", 60, ["k"], hot_rows)) is (hot_rows < 10_000)
    for look in (last_before, first_after):
        values = {"p": F.col("v"), "q": F.struct("i")}
        want = look(rows, ["k"], ["t", "i"], values)
        got = look(rows, ["k"], ["t", "i"], values, bounds, hot_rows)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_move_once_when_a_long_history_is_cut(spark):
    rows = spark.range(1_000).select(F.col("id").alias("i"), (F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    found = last_before(rows, ["k"], ["t"], {"p": F.col("i")}, [250.0, 500.0], hot_rows=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.where("p = i - 2").count() == 998
