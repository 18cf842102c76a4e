"""Each stage against a plain version of what it decides, on the smallest tables."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from chronofact.llm import bpe, mixing
from chronofact.llm.near import stored
from test_mixing import brute_targets
from test_quality import accepted

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), "test-pipeline"))
    return [frame.collect() for frame in out]


def test_stages_pass_documents_on(spark, steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing sources to target weights",
                     "byte-level BPE encoding and decoding"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    for rows in steps[1:-1]:
        assert rows and rows[0].asDict().keys() == set(columns)
    texts = {r["doc_id"]: r["text"] for r in steps[0]}
    assert all(texts[r["doc_id"]] == r["text"] for rows in steps[1:-1] for r in rows)


def test_quality_and_toxicity(spark, steps):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1]}
    assert {r["doc_id"] for r in steps[0] if accepted(r["text"])} == kept
    clean = {r["doc_id"] for r in steps[2]}
    judged = [(labels[i]["toxic"], i in clean) for i in kept if i in labels]
    assert np.mean([stays for toxic, stays in judged if not toxic]) > 0.95


def test_one_of_each_group_of_copies_stays(steps):
    def shingles(text):
        words = WORD.findall(text)
        return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}

    before = {r["doc_id"]: shingles(r["text"]) for r in steps[2]}
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(before)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 10 * len(before[a] & before[b]) >= 8 * len(before[a] | before[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in steps[3]) == sorted({find(i) for i in ids})


def test_mixture_meets_its_targets(steps):
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in steps[3]}
    source = {r["doc_id"]: r["source"] for r in steps[3]}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    taken, uses = Counter(), Counter(r["doc_id"] for r in steps[4])
    for i, n in uses.items():
        taken[source[i]] += n * size[i]
    assert max(uses.values()) <= mixing.CAP
    for name, target in brute_targets(dict(totals)).items():
        assert abs(taken[name] - target) <= max(n for i, n in size.items() if source[i] == name) / 2 + 1


def test_tokens_round_trip(steps):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in steps[4]}
    assert len(steps[5]) == len(steps[4])
    for row in steps[5]:
        ids = np.frombuffer(bytes(row["token_ids"]), "<u4").tolist()
        assert row["round_trip"] and ids == encoder.encode_ordinary(texts[row["doc_id"]]) and row["n_tokens"] == len(ids)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_near_copies_by_rows_where_ids_are_null_or_repeat(spark):
    def text(word, n=40):
        return " ".join(f"{word}{i}" for i in range(n))
    rows = [(4, text("a")), (4, text("b")), (4, text("c")), (3, text("b", 41)), (None, text("d")), (None, text("d")), (None, text("e")),
            (7, text("f")), (None, text("f")), (None, text("g")), (None, text("g", 41)), (5, text("h")), (5, text("h"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted((r["doc_id"] or 0, r["text"][0]) for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect())
    assert got == [(0, "d"), (0, "e"), (0, "g"), (3, "b"), (4, "a"), (4, "c"), (5, "h"), (7, "f")]
