import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronofact.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


TEXTS = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\x0by\x0cz\rw", "l1\nl1\n\n \n \nl1", "#*$ % é😀 | <b>&",
         "a b c d a b c d e a b", ("ab cd ef " * 9_000).strip(), " ".join(f"w{i}" for i in range(20_000)), "A\nB\nA\nB\n" * 30,
         "  b c", "b c"]


def test_counts_equal_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == brute(TEXTS[row["doc_id"]])
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
        assert not (row["base_failed"] and row["kept"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "#", "é"]), max_size=60).map("".join), min_size=1, max_size=30))
def test_counts_of_random_texts(spark, texts):
    got = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in got:
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == brute(texts[row["doc_id"]])


def accepted(text):
    words, _, symbols, dup, repeat = brute(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    lettered = sum(any(c.isalpha() for c in w) for w in WORD.findall(text or ""))
    return not (words < 50 or 100 * repeat > 50 * words or 4 * symbols > words or 2 * dup > lines or 5 * lettered < 4 * words)


JUDGED = [*TEXTS, "fine words here " + " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i}###" for i in range(80)),
          " ".join(f"w{i} | {i}" for i in range(60)), "\n".join(["same line of words"] * 60 + [f"other line {i} {i * 7} {i * 11}" for i in range(40)]),
          "\n\n".join(["a line"] * 3 + [f"b{i} c{i} d{i} e{i} f{i} g{i}" for i in range(20)]), "\n".join(f"x{i} y" for i in range(200)) + "\nq r\nq r",
          " ".join(f"r{i % 40}" for i in range(100)), " ".join(f"r{i % 65}" for i in range(100))]


def test_order_never_changes_the_verdict(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(JUDGED)], "doc_id long, text string, _text string, _words int")
    want = {i for i, t in enumerate(JUDGED) if accepted(t)}
    assert 2 < len(want) < len(JUDGED) - 3
    got = quality.judge(docs).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == want
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == want and quality.keep(docs).columns == docs.columns
    rules = [*quality.BASE, *quality.RULES]
    for order in (rules, rules[::-1]):
        judged = quality._held(docs.select("doc_id", "text"), "text")
        kept = judged.where(quality.verdict(order, quality.counts(F.col("_text"), F.col("_words"))))
        assert {r["doc_id"] for r in kept.collect()} == want


def test_rules_that_reject_much_for_little_come_first(spark):
    noisy = [(i, " ".join(f"w{i}{k}" for k in range(300)) + " # " * 200) for i in range(60)]
    fine = [(i, " ".join(f"w{i}{k}" for k in range(400))) for i in range(60)]
    docs = spark.createDataFrame(noisy + fine, "doc_id long, text string")
    order = quality.cascade_order(docs, [*quality.BASE[::-1], *quality.RULES])
    assert order[0].name in ("symbols", "letters") and order[-1].name != "symbols" and {r.name for r in order} == {r.name for r in (*quality.BASE, *quality.RULES)}
    assert quality.cascade_order(docs.limit(0), quality.RULES) == list(quality.RULES)


def test_every_rule_rejects_some_of_the_tables(spark):
    docs = quality._held(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text")
    known = quality.counts(F.col("_text"), F.col("_words"))
    found = docs.agg(*[F.count_if(r.rejects(known)).alias(r.name) for r in (*quality.BASE, *quality.RULES)]).first()
    assert all(n > 0 for n in found), found


def test_equal_hashes_of_different_windows_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "_windows", lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.length(w).cast("bigint")))
    texts = [t for t in TEXTS if t and len(t) < 2_000]
    got = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["n_repeat_words"] == brute(texts[r["doc_id"]])[4] for r in got)


def test_plans_are_native_and_without_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for found in (quality.judge(docs), quality.keep(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty).count() == 0 and "kept" in quality.judge(empty).columns
    assert quality.judge(empty.withColumn("kept", F.lit("x"))).schema["kept"].dataType.simpleString() == "boolean"
