import hashlib
import json
import math
import random
import uuid
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chronofact.functions import exact, identity, instants


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_golden_identifiers(spark):
    row = one(spark, identity.stable_id("definition", F.lit("BC01")), identity.stable_id("definition", F.lit("M01")),
              identity.stable_id("document_revision", F.lit("S_BRIDGE:v1")), identity.component_seed("events", F.lit("W0")),
              identity.content_hash(F.lit("[]")))
    assert tuple(row) == (
        "16b593ec-3396-55c8-9288-1a3aae654e28", "7f1963d7-c231-5fb8-a63c-dd3f0b120d5f",
        "f1035273-5a07-56ac-9e85-1f1a43d4ea87", 18431874524840890038,
        "37517e5f3dc66819f61f5a7bb8ace1921282415f10551d2defa5c3eb0985b570")


def test_uuid5_equals_the_standard(spark):
    names = [f"driver:{i}é" for i in range(50)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.uuid5(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.UUID(identity.NAMESPACE), r["n"])) for r in rows)


def test_canonical_json_of_text_and_of_structs(spark):
    record = {"b": 1, "a": {"z": [1, 2, {"y": None, "x": "é\n\"q\\"}], "k": True}, "commit_seq": 4, "text": "t", "payload_hash": "h", "u": "/"}
    body = {k: v for k, v in record.items() if k not in ("payload_hash", "commit_seq", "text")}
    raw = json.dumps(record)
    row = one(spark, identity.canonical_text(F.lit(raw)), identity.payload_hash(F.lit(raw)), identity.json_string(F.lit('a"b\né\\')))
    assert row[0] == canonical(record)
    assert row[1] == hashlib.sha256((canonical(body) + "\n").encode()).hexdigest()
    assert row[2] == canonical('a"b\né\\')
    df = spark.createDataFrame([((2, None, [("q", {"y": "1", "x": "2"})]),)],
                               "s struct<z:int,n:string,a:array<struct<k:string,j:map<string,string>>>>")
    got = df.select(identity.canonical_json(F.col("s"), df.schema["s"].dataType)).first()[0]
    assert got == canonical({"z": 2, "n": None, "a": [{"k": "q", "j": {"y": "1", "x": "2"}}]})


def test_rationals_reduce_like_gcd(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(-10**15, 10**15), rng.randrange(1, 10**15)) for _ in range(200)]
    pairs += [(0, 7), (2, 10), (6765, 10946), (1, 1), (7540113804746346429, 4660046610375530309)]
    rows = spark.createDataFrame(pairs, "n bigint, d bigint").select("n", "d", exact.rational("n", "d").alias("r")).collect()
    for r in rows:
        g = math.gcd(r["n"], r["d"])
        assert (r["r"]["n"], r["r"]["d"]) == (r["n"] // g, r["d"] // g)


def test_formula_boundaries(spark):
    frac = lambda n, d: exact.rational(F.lit(n), F.lit(d))
    row = one(spark, exact.revenue_charge(F.lit(200000)), exact.revenue_charge(F.lit(280000)), exact.revenue_charge(F.lit(300000)),
              exact.auto_accept(F.lit("bike_partner"), frac(49, 100)), exact.auto_accept(F.lit("bike_partner"), frac(1, 2)),
              exact.auto_accept(F.lit("other"), frac(1, 4)), exact.rating_condition(frac(97, 20)), exact.rating_condition(frac(49, 10)),
              exact.cancel_rate(F.lit(2), F.lit(8)), exact.cancel_rate(F.lit(0), F.lit(0)), exact.equal(frac(2, 10), frac(1, 5)))
    assert tuple(row) == (16000, 0, 0, True, False, False, False, True, (1, 5), None, True)
    assert Fraction(*row[8]) == Fraction(1, 5)


@pytest.mark.parametrize("bad", [
    lambda: exact.rational(F.lit(1), F.lit(0)), lambda: exact.revenue_charge(F.lit(-1)), lambda: exact.cancel_rate(F.lit(-1), F.lit(3)),
    lambda: instants.utc(F.lit("2026-01-01T00:00:00"))])
def test_invalid_values_are_errors(spark, bad):
    with pytest.raises(Exception, match="must be positive|cannot be negative|timezone-aware"):
        one(spark, bad())


def test_utc_text(spark):
    row = one(spark, instants.utc(F.lit("2026-09-16T00:00:00+07:00")), instants.utc(F.lit("2026-01-01T00:00:00.5Z")))
    assert tuple(row) == ("2026-09-15T17:00:00.000000Z", "2026-01-01T00:00:00.500000Z")


def test_half_open_eligibility(spark):
    day = lambda d: F.lit(f"2026-09-{d:02d}").cast("timestamp_ntz")
    never = F.lit(None).cast("timestamp_ntz")
    row = one(spark, instants.interval_eligible(day(1), day(3), day(1), never, day(2), day(2)),
              instants.interval_eligible(day(1), day(3), day(1), never, day(3), day(3)),
              instants.interval_eligible(day(1), never, day(1), day(2), day(2), day(2)),
              instants.point_eligible(day(2), day(1), day(3), day(2), never, day(2)),
              instants.point_eligible(day(3), day(1), day(3), day(2), never, day(3)))
    assert tuple(row) == (True, False, False, True, False)
