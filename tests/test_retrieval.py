import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofact.functions import text as tx
from chronofact.operators import catalog, chunking, lexical
from chronofact.session import scratch_scope
from test_text import python_terms


def spans(text, size, overlap):
    """A further window starts wherever the one before it left words uncovered."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    windows = [words[i:i + size] for i in range(0, len(words), size - overlap) if i == 0 or i + overlap < len(words)]
    return [(w[0][0], w[-1][1], len(w)) for w in windows]


def random_texts(seed, count, words, letters="abcé😀ß"):
    rng = random.Random(seed)
    gap = lambda: rng.choice([" ", "\n", "  ", " ", "\t \n"])
    return ["".join(rng.choice(["", gap()]) if i == 0 else rng.choice(letters) * rng.randrange(1, 4) + gap()
                    for i in range(rng.randrange(words))) for _ in range(count)]


@pytest.mark.parametrize("size,overlap", [(7, 2), (5, 0), (180, 30), (3, 2)])
def test_chunks_equal_a_sequential_scan(spark, size, overlap):
    texts = random_texts(size, 60, 40) + ["", "   ", "one", " one "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = chunking.chunk_spans(df, config=chunking.ChunkConfig(size, overlap)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_no"])):
        got.setdefault(r["doc_id"], []).append((r["span_start"], r["span_end"], r["token_count"]))
        assert r["chunk_text"] == texts[r["doc_id"]][r["span_start"]:r["span_end"]]
    assert got == {i: s for i, t in enumerate(texts) if (s := spans(t, size, overlap))}


def test_chunk_identity_covers_configuration_and_overlap_must_be_smaller(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    def ids(config):
        rows = chunking.chunk_spans(df, config=config)
        return {r[0] for r in rows.select(chunking.chunk_id(F.col("doc_id"), F.col("span_start"), F.col("span_end"), config)).collect()}
    assert ids(chunking.ChunkConfig(4, 1)) == ids(chunking.ChunkConfig(4, 1))
    assert not ids(chunking.ChunkConfig(4, 1)) & ids(chunking.ChunkConfig(4, 1, chunker_version="other"))
    with pytest.raises(Exception, match="overlap must be smaller"):
        chunking.chunk_spans(df, config=chunking.ChunkConfig(3, 3)).collect()
    assert chunking.chunk_spans(df.where("doc_id = 2"), config=chunking.ChunkConfig(3, 3)).collect() == []


def test_construct_chunks_checks_hashes_and_keeps_lineage(spark):
    row = ("document", "s", "rev", "one two\nthree", None, None, True, [("b", 4, 7), ("a", 0, 5), ("none", None, None)])
    schema = ("kind string, source_id string, document_revision_id string, text string, normalized_sha256 string, raw_sha256 string, "
              "crlf boolean, clauses array<struct<clause_id:string,span_start:int,span_end:int>>")
    chunk = chunking.construct_chunks(spark.createDataFrame([row], schema), profile_id="p").first()
    assert (chunk["normalized_end"], chunk["raw_end"], chunk["clause_ids"]) == (13, 14, ["a", "b"])
    links = chunking.projection_links(chunking.construct_chunks(spark.createDataFrame([row], schema), profile_id="p"), F.lit("x.md"))
    assert links.first()["runtime_id"] == chunk["chunk_id"]
    wrong = spark.createDataFrame([(*row[:4], "0" * 64, *row[5:])], schema)
    with pytest.raises(Exception, match="normalized hash mismatch"):
        chunking.construct_chunks(wrong, profile_id="p").collect()


def brute_bm25(docs, queries, top_k, allowed=None, k1=1.2, b=0.75):
    tfs = {d: Counter(python_terms(t)) for d, t in docs}
    lengths = {d: sum(c.values()) for d, c in tfs.items()}
    avgdl = sum(lengths.values()) / len(docs) or 1.0
    df = Counter(t for c in tfs.values() for t in c)
    out = set()
    for q, text in queries:
        scored = []
        for d, c in tfs.items():
            if allowed is not None and d not in allowed:
                continue
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1)
                    / (c[t] + k1 * (1 - b + b * lengths[d] / avgdl)) for t in python_terms(text) if c[t])
            if s > 0:
                scored.append((-round(s, 9), d))
        out |= {(q, d, -s, i) for i, (s, d) in enumerate(sorted(scored)[:top_k], 1)}
    return out


@pytest.mark.parametrize("broadcast_rows", [lexical.BROADCAST_ROWS, 0])
def test_bm25_equals_brute_force_with_either_join(spark, broadcast_rows):
    docs = list(enumerate(random_texts(5, 80, 30, "abcdeßΣ")))
    docs += [(1000 + i, docs[i][1]) for i in range(20)]  # copies tie, the key decides
    queries = list(enumerate(random_texts(6, 15, 8, "abcdeßΣ") + ["a a a b", ""]))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "qid long, text string")
    found = lexical.bm25_search(d, q, key=["doc_id"], query_key="qid", top_k=7, broadcast_rows=broadcast_rows).collect()
    got = {(r["query_id"], r["doc_id"], round(r["score"], 8), r["rank"]) for r in found}
    assert got == {(a, b, round(s, 8), r) for a, b, s, r in brute_bm25(docs, queries, 7)}


def test_a_search_reads_the_partitions_of_its_terms_only(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.range(400).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(
        F.lit("t"), (F.col("id") * 50 + i).cast("string"))), " ").alias("text"))
    lexical.write_index(docs, path, key=["id"])
    asked = spark.createDataFrame([(1, " ".join(f"t{i * 500}" for i in range(40)))], "qid int, text string")
    found = lexical.search_index(spark, path, asked, key=["id"], query_key="qid", top_k=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[[^\]]*_bucket#\d+ (?:IN|INSET) \(?([^)\]]*)", plan)
    assert pruned
    read = spark.read.parquet(f"{path}/postings").where(F.col("_bucket").isin([int(b) for b in pruned[0].split(",")])).count()
    assert read < 0.25 * 20_400 and found.count() == 40


def test_terms_are_counted_inside_the_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "i int, t array<string>")
    got = {r["i"]: None if r["c"] is None else [tuple(c) for c in r["c"]] for r in rows.select("i", tx.term_counts(F.col("t")).alias("c")).collect()}
    assert got == {1: [("a", 2), ("b", 3)], 2: [], 3: None, 4: [("x", 1)]}


def test_one_very_long_text_is_chunked_in_linear_time(spark):
    words = " ".join(f"w{i}" + ("\n" if i % 7 == 0 else "") for i in range(1_000_000))
    df = spark.createDataFrame([("document", "s", "r", words, None, None, True, [])],
                               "kind string, source_id string, document_revision_id string, text string, normalized_sha256 string, raw_sha256 string, "
                               "crlf boolean, clauses array<struct<clause_id:string,span_start:int,span_end:int>>")
    start = time.time()
    last = chunking.construct_chunks(df, profile_id="p").agg(F.max("normalized_end"), F.max("raw_end"), F.count("*")).first()
    assert tuple(last) == (len(words.rstrip()), len(words.rstrip()) + words.rstrip().count("\n"), 6_667)
    assert time.time() - start < 60


@pytest.mark.parametrize("broadcast_rows", [lexical.BROADCAST_ROWS, 0])
def test_stored_index_serves_many_searches(spark, tmp_path, broadcast_rows):
    docs = list(enumerate(random_texts(7, 60, 30, "abcdeß")))
    path = str(tmp_path / "index")
    lexical.write_index(spark.createDataFrame(docs, "doc_id long, text string").withColumn("even", F.col("doc_id") % 2 == 0),
                        path, key=["doc_id"], carry=["even"])
    for seed, allowed in ((1, None), (2, set(range(0, 60, 2)))):
        queries = list(enumerate(random_texts(seed, 6, 8, "abcdeß")))
        found = lexical.search_index(spark, path, spark.createDataFrame(queries, "qid long, text string"), key=["doc_id"],
                                     query_key="qid", top_k=5, allowed=None if allowed is None else F.col("even"),
                                     broadcast_rows=broadcast_rows).collect()
        got = {(r["query_id"], r["doc_id"], round(r["score"], 8), r["rank"]) for r in found}
        assert got == {(a, b, round(s, 8), r) for a, b, s, r in brute_bm25(docs, queries, 5, allowed)}


def test_allowed_sources_do_not_change_statistics(spark):
    docs = list(enumerate(random_texts(9, 40, 20, "abcd")))
    queries = [(1, "a b"), (2, "cc d")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "qid long, text string")
    found = lexical.bm25_search(d, q, key=["doc_id"], query_key="qid", allowed=F.col("doc_id") < 10).collect()
    got = {(r["query_id"], r["doc_id"], round(r["score"], 8), r["rank"]) for r in found}
    assert got == {(a, b, round(s, 8), r) for a, b, s, r in brute_bm25(docs, queries, 10, allowed=set(range(10)))}


def test_search_tokenizes_every_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passing(text):
        seen.add(1)
        return text

    d = spark.createDataFrame(list(enumerate(random_texts(2, 50, 20))), "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "qid long, text string")
    lexical.bm25_search(d.withColumn("text", passing("text")), q, key=["doc_id"], query_key="qid").collect()
    assert seen.value == 50


def test_profile_and_catalog(spark):
    cat = spark.createDataFrame([("s1", "r1"), (None, "r2"), ("s3", "r3"), ("s1", "r2")], "snapshot_id string, document_revision_id string")
    got = catalog.profile_members(cat, spark.createDataFrame([("s1",), ("s1",)], "snapshot_id string"),
                                  spark.createDataFrame([("r2",)], "document_revision_id string"))
    assert sorted((r[0] or "", r[1]) for r in got.collect()) == [("", "r2"), ("s1", "r1"), ("s1", "r2")]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in catalog.last_wins(rows, ["k"], "n").collect()} == {("k", "new"), ("j", "only")}
    asked = spark.createDataFrame([("k",), ("missing",)], "k string")
    with pytest.raises(Exception, match="unknown definition: missing"):
        catalog.require(asked, rows, ["k"], "definition").collect()


def test_common_words_open_few_blocks(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "index")
    common = ["the", "of", "and"]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.1 + 0.3 * (i % 50 == 0) else f"w{rng.randrange(3_000)}"
                         for _ in range(rng.randint(20, 400)))) for i in range(3_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    lexical.write_index(frame, path, key=["doc_id"], block_docs=16)
    asked = spark.createDataFrame([(1, "the of and"), (2, "the"), (3, "w7 w8 the")], "qid long, text string")
    search = lexical.IndexSearch(spark, path, asked, key=["doc_id"], query_key="qid")
    opened = {r["query_id"]: r["count"] for r in search.candidates().groupBy("query_id").count().collect()}
    present = {r["query_id"]: r["count"] for r in search.bounds().groupBy("query_id").count().collect()}
    assert opened[1] < 0.35 * present[1] and opened[2] < 0.35 * present[2] and opened[3] < 0.5 * present[3], (opened, present)
    want = lexical.bm25_search(frame, asked, key=["doc_id"], query_key="qid").collect()
    assert sorted(map(tuple, search.top().collect())) == sorted(map(tuple, want)) and len(want) == 30


def test_index_of_odd_texts(spark, tmp_path):
    path, none = str(tmp_path / "index"), str(tmp_path / "none")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a a"), (4, "a b"), (5, "b")], "doc_id long, text string")
    lexical.write_index(docs, path, key=["doc_id"])
    asked = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "qid long, text string")
    got = lexical.search_index(spark, path, asked, key=["doc_id"], query_key="qid").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in lexical.bm25_search(docs, asked, key=["doc_id"], query_key="qid").collect()]
    with pytest.raises(ValueError, match="unique"):
        lexical.write_index(docs.unionByName(docs), none, key=["doc_id"])


def test_clauses_of_a_span_equal_brute_force(spark):
    rng = random.Random(8)
    clauses = [(f"c{i % 40}", *sorted((rng.randrange(300), rng.randrange(300)))) for i in range(300)] + [("n", None, 5), ("m", 5, None), (None, 3, 9), ("e", 7, 7)]
    clauses += [("all", 0, 300)]
    rng.shuffle(clauses)
    spans = [(a, a + rng.randrange(1, 80)) for a in range(0, 310, 7)]
    df = spark.createDataFrame([(s, e, clauses) for s, e in spans] + [(1, 5, []), (1, 5, None)],
                               "s int, e int, clauses array<struct<clause_id:string,span_start:int,span_end:int>>")
    df = df.withColumn("i", chunking.clause_index(F.col("clauses"))).withColumns({
        "a": F.transform("i", lambda c: c["a"]), "b": tx.running_maxima(F.transform("i", lambda c: c["b"]), block=16)})
    for r in df.select("*", chunking.overlapping(F.col("i"), F.col("a"), F.col("b"), F.col("s"), F.col("e")).alias("got")).collect():
        want = [c["clause_id"] for c in r["clauses"] or () if c["span_start"] is not None and c["span_end"] is not None
                and c["span_start"] < r["e"] and c["span_end"] > r["s"]]
        assert sorted(r["got"], key=lambda x: (x is None, x or "")) == sorted(want, key=lambda x: (x is None, x or ""))


def test_a_document_of_many_clauses_ends_in_seconds(spark):
    n = 100_000
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string").withColumn("clauses", F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("string").alias("clause_id"), (i * 6).alias("span_start"), (i * 6 + 6).alias("span_end"))))
    start = time.time()
    found = chunking.chunk_spans(df, clauses="clauses").agg(F.sum(F.size("clause_ids")), F.count("*")).first()
    assert found[1] == 667 and found[0] > n
    assert time.time() - start < 45


@pytest.mark.parametrize("hits", [1, 50, 10**6])
def test_a_task_holds_the_best_only(hits):
    rng = random.Random(hits)
    terms, queries = 12, 5
    flat = sorted((t, q, rng.random()) for q in range(queries) for t in rng.sample(range(terms), 6))
    starts = np.searchsorted([f[0] for f in flat], np.arange(terms + 1))
    scorer = lexical.TaskScorer(starts, np.array([f[1] for f in flat]), np.array([f[2] for f in flat]), queries, 9.0, ["id"], 4, 1.2, 0.75, hits)
    docs = [{"id": i, "_p": [{"_t": t, "_tf": rng.randint(1, 3), "_len": 5 + i % 4} for t in sorted(rng.sample(range(terms), rng.randint(1, 8)))]}
            for i in range(300)]
    kind = pa.schema([("id", pa.int64()), ("_p", pa.list_(pa.struct([("_t", pa.int32()), ("_tf", pa.int64()), ("_len", pa.int64())])))])
    batches = pa.Table.from_pylist(docs, schema=kind).to_batches(max_chunksize=70)
    assert all(len(q) <= max(hits, 30) for batch in batches for _, q, _ in scorer.parts(batch))
    got = sorted((r["_q"], -r["score"], r["id"]) for b in scorer(iter(batches)) for r in b.to_pylist())
    want = []
    for q in range(queries):
        weight = {t: w for t, p, w in flat if p == q}
        scored = sorted((-round(sum(weight[e["_t"]] * e["_tf"] * 2.2 / (e["_tf"] + 1.2 * (0.25 + 0.75 * e["_len"] / 9.0))
                                    for e in d["_p"] if e["_t"] in weight), 9), d["id"]) for d in docs)
        want += [(q, s, i) for s, i in scored[:4]]
    assert [(q, i) for q, _, i in got] == [(q, i) for q, _, i in want]
    assert all(abs(a[1] - b[1]) < 1e-8 for a, b in zip(got, want, strict=True))


def test_repeated_and_null_keys_are_searched_alike_by_either_way(spark):
    texts = random_texts(3, 40, 12, "abcd")
    docs = [(None if i % 9 == 0 else i % 30, None if i % 11 == 0 else t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "b a"), (None, "c"), (4, "a a b"), (4, "zz")], "qid long, text string")
    one, other = ([tuple(r) for r in lexical.bm25_search(d, q, key=["doc_id"], query_key="qid", top_k=6, allowed=F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 1),
                                                         broadcast_rows=n).collect()] for n in (lexical.BROADCAST_ROWS, 0))
    assert len(one) > 18 and sorted(map(str, one)) == sorted(map(str, other))


def test_pairs_of_query_and_document_are_not_rows(spark):
    d = spark.createDataFrame(list(enumerate(random_texts(2, 50, 20))), "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "a b c")], "qid long, text string")
    found = lexical.bm25_search(d, q, key=["doc_id"], query_key="qid")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Aggregate \[[^\]]*query_id", plan)


def test_a_search_neither_sorts_nor_gathers_postings_by_document(spark):
    d = spark.createDataFrame(list(enumerate(random_texts(2, 50, 20))), "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "a b c")], "qid long, text string")
    plan = lexical.bm25_search(d, q, key=["doc_id"], query_key="qid")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):plan.index("FileScan")]
    assert not re.search(r"Sort|Aggregate|Join", below)


def test_equal_scores_in_many_tasks_go_by_key(spark):
    docs = [(f"{i * 7919 % 1000:03d}", None if i % 50 == 0 else i % 3, "a b" if i % 2 else "a b b") for i in range(1000)]
    d = spark.createDataFrame(docs, "doc_id string, part int, text string").repartition(7)
    q = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, text string")
    got, want = ([tuple(r) for r in lexical.bm25_search(d, q, key=["part", "doc_id"], query_key="qid", top_k=30, broadcast_rows=n).orderBy("query_id", "rank").collect()]
                 for n in (lexical.BROADCAST_ROWS, 0))
    assert got == want and len(got) == 60 and [r[1] for r in got[30:]] == [None] * 20 + [0] * 10
    nested = d.select(F.struct("part", "doc_id").alias("k"), "text")
    assert [(r["k"]["part"], r["k"]["doc_id"], r["rank"]) for r in lexical.bm25_search(nested, q, key=["k"], query_key="qid", top_k=30).orderBy("query_id", "rank").collect()] \
        == [(r[1], r[2], r[4]) for r in want]


def test_rows_of_repeated_keys_are_added_up_in_parts(spark):
    texts = random_texts(4, 400, 12, "abcd")
    docs = [(0 if i < 300 else None if i < 320 else i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "c d d")], "qid long, text string")
    found = lexical.bm25_search(d, q, key=["doc_id"], query_key="qid")
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    other = lexical.bm25_search(d, q, key=["doc_id"], query_key="qid", broadcast_rows=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, other.collect())) and found.where("rank = 1 and doc_id = 0").count() == 2


@pytest.mark.parametrize("broadcast_rows", [lexical.BROADCAST_ROWS, 0])
def test_an_index_keeps_a_document_once_and_moves_a_posting_once(spark, tmp_path, broadcast_rows):
    path = str(tmp_path / "index")
    texts = random_texts(12, 300, 25, "abcdeß")
    docs = [(i % 7, f"{i:03d}", None if i % 31 == 0 else i % 3, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "a int, b string, c int, text string").repartition(5)
    lexical.write_index(frame, path, key=["a", "b"], carry=["c"], block_docs=8)
    assert spark.read.parquet(f"{path}/postings").columns == ["term", "_block", "_max_tf", "_min_len", "_places", "_tfs", "_bucket"]
    stored = spark.read.parquet(f"{path}/documents").select(F.size("_docs").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert tuple(stored) == (300, 8)
    asked = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, "dd aa a"), (4, "")], "qid long, text string")
    found = lexical.search_index(spark, path, asked, key=["a", "b"], query_key="qid", allowed=F.col("c") != 1, broadcast_rows=broadcast_rows)
    if broadcast_rows:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Aggregate \[[^\]]*query_id|Join[^\n]*_w#", plan)
    want = lexical.bm25_search(frame, asked, key=["a", "b"], query_key="qid", allowed=F.col("c") != 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 30


def test_a_task_packs_the_postings_of_a_few_blocks_at_a_time(spark, tmp_path, monkeypatch):
    held, pack = [], lexical.BlockMaker.packed
    monkeypatch.setattr(lexical, "PACK_BYTES", 20_000)
    monkeypatch.setattr(lexical, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Of", (), {"partitionId": lambda self: 3})())}))
    monkeypatch.setattr(lexical.BlockMaker, "packed", staticmethod(lambda rows, shape: (held.append([r.nbytes for r in rows]), pack(rows, shape))[1]))
    rng = random.Random(3)
    docs = [{"id": i, "_t": None if i % 40 == 0 else [f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))]} for i in range(2_000)]
    batches = pa.Table.from_pylist(docs, schema=pa.schema([("id", pa.int64()), ("_t", pa.list_(pa.string()))])).to_batches(max_chunksize=700)
    made = pa.Table.from_batches(list(lexical.BlockMaker(["id"], 16)(iter(batches))))
    assert len(held) > 20 and all(sum(sizes[:-1]) < 20_000 for sizes in held)
    ids = {r["_block"]: [d["id"] for d in r["_docs"]] for r in made.select(["_block", "_docs"]).to_pylist() if r["_docs"] is not None}
    packed = made.filter(pa.compute.is_valid(made["_packed"])).select(["_bucket", "_packed"])
    assert all(len(b) < 20_000 for b in packed["_packed"].to_pylist())
    rows = pa.Table.from_batches(list(lexical._unpacked(packed.to_batches()))).to_pylist()
    got = sorted((ids[r["_block"]][p], r["term"], tf) for r in rows for p, tf in zip(r["_places"], r["_tfs"], strict=True))
    assert got == sorted((d["id"], t, n) for d in docs for t, n in Counter(d["_t"] or ()).items())
    wanted = spark.createDataFrame([(r["_bucket"], r["term"]) for r in rows], "b int, term string").where(lexical._bucket("term") != F.col("b"))
    assert wanted.isEmpty()


def test_an_index_leaves_nothing_but_itself(spark, tmp_path):
    with scratch_scope(spark) as scope:
        lexical.write_index(spark.createDataFrame([(1, "a b"), (2, "é a")], "doc_id long, text string"), str(tmp_path / "index"), key=["doc_id"])
    assert scope.paths and not any(os.path.exists(path) for path in scope.paths)


@pytest.mark.parametrize("room,turn", [(0, 3), (1, 500_000)])
def test_common_and_rare_terms_are_searched_alike(spark, monkeypatch, room, turn):
    monkeypatch.setattr(lexical, "PAIRS_PER_ROW", room)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", turn)
    texts = random_texts(21, 60, 12, "abcdeß") + [f"fleet n{i % 9}" for i in range(40)]
    docs = [(None if i % 19 == 0 else i % 80, None if i % 23 == 0 else t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = [(i, f"fleet n{i}") for i in range(12)] + [(50, "a b"), (51, "b a"), (None, "c fleet"), (52, "a a b"), (52, "zz"), (53, None), (54, "zz")]
    q = spark.createDataFrame(asked, "qid long, text string")
    allowed = F.col("doc_id").isNull() | (F.col("doc_id") % 5 != 1)
    rows = q.count() + 8  # more than there are terms, fewer than there are terms of queries
    want, by_table, by_join = ([(r[0], r[1], round(r[2], 8), r[3]) for r in lexical.bm25_search(
        d, q, key=["doc_id"], query_key="qid", top_k=4, allowed=allowed, broadcast_rows=n).collect()] for n in (10**6, rows, 0))
    assert len(want) > 50 and sorted(map(str, by_table)) == sorted(map(str, by_join)) == sorted(map(str, want))


def test_many_queries_with_a_common_word_do_not_become_pairs(spark):
    d = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("fleet n"), "id").alias("text"))
    q = spark.range(300).select(F.col("id").alias("qid"), F.concat(F.lit("fleet n"), "id").alias("text"))
    with scratch_scope(spark) as scope:
        found = lexical.bm25_search(d, q, key=["doc_id"], query_key="qid", top_k=3, broadcast_rows=0)
        assert not re.search(r"Aggregate \[[^\]]*query_id", found._jdf.queryExecution().optimizedPlan().toString())
        got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in found.collect())
    others = lambda i: [j for j in range(3) if j != i][:2]
    assert got == [(i, n, k) for i in range(300) for n, k in enumerate([i, *others(i)], 1)]
    assert scope.paths and max(spark.read.parquet(path).count() for path in scope.paths) < 0.05 * 300 * 600
