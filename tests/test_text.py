import random
import re
import unicodedata

from pyspark.sql import functions as F

from chronofact.functions import text as tx


def python_terms(s):
    return re.findall(r"\w+", unicodedata.normalize("NFC", s).casefold())


def test_plain_characters_fold_and_split_natively_as_in_python(spark):
    # Every code point with two plain neighbours: word or not, and how it folds.
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, f"a{chr(c)}B") for c in points], "c int, s string")
    plain = df.where(~F.col("s").rlike(tx.NOT_PLAIN)).select("c", "s", tx.native_terms("s").alias("t")).collect()
    assert len(plain) > 20_000
    assert [r["c"] for r in plain if r["t"] != python_terms(r["s"])] == []


def test_terms_of_any_text_follow_the_full_unicode_tables(spark):
    texts = ["Straße STRASSE", "ΣΊΣΥΦΟΣ σίσυφος", "été été", "İstanbul", "doanh số tối thiểu", "½ m² x_y",
             "हिन्दी भाषा", "ﬁn ſch", "", "  \n ", "東京 2024", "don't — stop"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", "s", tx.terms("s").alias("t")).collect()
    for r in rows:
        assert r["t"] == python_terms(r["s"]), r["s"]


def test_word_pieces_split_at_every_unicode_space(spark):
    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).isspace()]
    assert len(spaces) == 29
    s = "x".join(spaces) + "end"
    pieces = spark.createDataFrame([(s,)], "s string").select(tx.word_pieces("s").alias("p"), tx.word_count("s").alias("n")).first()
    assert [p.strip() for p in pieces["p"]] == s.split()
    assert pieces["n"] == len(s.split())


def test_offsets_count_code_points_and_crlf(spark):
    text = "a😀é\nb\n\nc"
    df = spark.createDataFrame([(text, i) for i in range(len(text) + 1)], "t string, i int")
    rows = df.select("i", tx.raw_offset("t", F.col("i"), F.lit(True)).alias("o"),
                     tx.raw_offset("t", F.col("i"), F.lit(False)).alias("same"),
                     tx.span("t", F.lit(0), F.col("i")).alias("head")).collect()
    for r in rows:
        assert r["o"] == r["i"] + text[:r["i"]].count("\n") and r["same"] == r["i"] and r["head"] == text[:r["i"]]


def test_running_starts_over_several_blocks(spark):
    rng = random.Random(1)
    for n in (0, 1, 127, 128, 129, 700):
        pieces = ["x" * rng.randrange(5) for _ in range(n)]
        got = spark.createDataFrame([(pieces,)], "p array<string>").select(tx.running_starts(F.col("p"), gap=1)).first()[0]
        want, at = [], 0
        for p in pieces:
            want.append(at)
            at += len(p) + 1
        assert got == want
