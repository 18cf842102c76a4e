"""The stream of records against the batch validation, over batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from chronofact.operators import ledger
from chronofact.streaming import validate
from test_ledger import claim, frames, record


def broken(seed, steps=60):
    """Records in replay order that break rules now and then."""
    rng, rows, ids = random.Random(seed), [], [f"a{i}" for i in range(6)]
    for n in range(steps):
        source = rng.choice(["a", "b", "c", "nobody"] if n % 9 == 0 else ["a", "b", "c"])
        targets = rng.sample(ids, rng.choice([0, 0, 1, 2]))
        opened = [claim(i, n, predicate=rng.choice(["P", "P", "Q"])) for i in rng.sample(ids, rng.choice([0, 1, 1, 2]))]
        operation = rng.choice(["assert", "replace", "retract"])
        rid = f"r{n if rng.random() > 0.1 else rng.randrange(n + 1)}"
        rows.append(record(rng.choice(["L", "M", None]), rid, source, n // 2, rng.choice([n, n // 2]), operation, opened, targets, ok=rng.random() > 0.1, order=n))
    return sorted(rows, key=lambda r: (r[3], r[4], r[5]))


def found(df):
    return sorted((r["ledger_id"] or "", r["record_id"], r["input_order"], r["pos"], r["violation"]) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_batch_after_batches_and_restarts(spark, tmp_path, parts):
    rows = broken(parts)
    frame, sources = frames(spark, rows)
    arriving, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    cuts = sorted({0, len(rows), *random.Random(1).sample(range(1, len(rows)), parts - 1)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        while b < len(rows) and a and rows[b][3] == rows[b - 1][3]:  # records of one instant arrive together
            b += 1
        part = [r for r in rows[a:b] if r not in rows[:a]]
        frames(spark, part)[0].coalesce(1).write.mode("append").parquet(arriving)
        validate.report(spark.readStream.schema(frame.schema).parquet(arriving), sources, out, checkpoint).awaitTermination()
    seen = spark.read.schema(frame.schema).parquet(arriving)
    assert found(spark.read.parquet(out)) == found(ledger.violations(seen, sources)) != []
    assert validate.report(spark.readStream.schema(frame.schema).parquet(arriving), sources, out, checkpoint).awaitTermination() is None
    assert found(spark.read.parquet(out)) == found(ledger.violations(seen, sources))


def test_late_records_are_reported_and_change_no_state(spark, tmp_path):
    arriving, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [record("L", "r2", "a", 2, 2, "assert", [claim("x", 1)], order=2)]
    late = [record("L", "r2", "a", 1, 1, "assert", [claim("y", 1)], order=1)]
    last = [record("L", "r3", "a", 3, 3, "replace", [claim("z", 2)], ["x"], order=3)]
    for part in (first, late, last):
        frame, sources = frames(spark, part)
        frame.write.mode("append").parquet(arriving)
        validate.report(spark.readStream.schema(frame.schema).parquet(arriving), sources, out, checkpoint).awaitTermination()
    got = {(r["input_order"], r["violation"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "duplicate record_id")}


def test_state_is_one_row_per_key():
    class State:
        exists, held = False, None

        @property
        def get(self):
            return self.held

        def update(self, value):
            self.exists, self.held = True, value

    import pandas as pd

    state = State()
    for start in (0, 500):
        rows = [("L", "k", f"r{n}", "a", n * 10, n, n, 0, "open", -1, None) for n in range(start, start + 500)]
        made = pd.concat(validate.look_back(("L", "k"), iter([pd.DataFrame(rows[::-1], columns=validate.NAMES)]), state))
        assert len(made) == 500 and not made["late"].any()
        assert len(state.held) == 6 and state.held[1] == (start + 499) * 10
    assert made["prior_micros"].iloc[0] == 4_990


def test_keys_of_a_bucket_follow_each_other_apart(spark):
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    state, seen, calls = State(), [], 0
    for start in range(0, 3_000, 1_000):  # of 900 keys in all most come again
        rows = [(None if n % 5 == 0 else "L", None if n % 7 == 0 else f"k{n % 900}", f"r{n}", "a", n * 10, n, n, 0, "open", -1, None)
                for n in range(start, start + 1_000)]
        seen += [made for made in validate.look_back_bucket((1,), iter([pd.DataFrame(rows[::-1], columns=validate.NAMES)]), state)]
        calls += 1
    assert len(seen) == calls  # one table for a bucket, not one for a key
    found = pd.concat(seen).sort_values("input_order")
    last = {}
    for row in found.itertuples(index=False):
        key = (row.ledger_id, row.key)
        assert not row.late and row.prior_micros == last.get(key, validate.NO_INSTANT)
        last[key] = row.micros
    assert len(found) == 3_000 and len(last) > 700


def test_a_stream_is_grouped_by_buckets_of_keys(spark, tmp_path):
    rows = broken(3)
    frame, sources = frames(spark, rows)
    frame.write.parquet(str(tmp_path / "in"))
    found = validate.violations(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), sources)
    plan = found._jdf.queryExecution().logical().toString()
    assert "look_back_bucket(bucket#" in plan.replace(" ", "") or "[bucket#" in plan
