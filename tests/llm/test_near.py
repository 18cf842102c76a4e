import math
import random

import numpy as np
import pytest

from chronofact.llm import caps, jaccard, near, shingles


def grouped(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 501 + i) for i in range(80)]
    links += links[:20] + [(7, 7)]
    got = {r["member"]: r["root"] for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = grouped(600, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [1_000, 7])
def test_blocks_bring_every_pair_together_once(spark, size):
    rows = [(k, 100 * k + m) for k in range(6) for m in range(3 * k + 1)]
    blocks = near.in_blocks(spark.createDataFrame(rows, "bucket long, member long"), "bucket", "member", size).collect()
    pairs = {}
    for group in {(r["bucket"], r["_i"], r["_j"]) for r in blocks}:
        members = [r for r in blocks if (r["bucket"], r["_i"], r["_j"]) == group]
        assert len(members) <= 6 * size
        for a in members:
            for b in members:
                if a["member"] < b["member"] and (group[1] == group[2] or a["_b"] != b["_b"]):
                    pairs[a["member"], b["member"]] = pairs.get((a["member"], b["member"]), 0) + 1
    assert pairs == {(100 * k + a, 100 * k + b): 1 for k in range(1, 6) for a in range(3 * k + 1) for b in range(a + 1, 3 * k + 1)}


def exact_sets(texts):
    out = []
    for t in texts:
        words = (t or "").split()
        out.append({tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))})
    return out


def near_texts(rng):
    texts = [None, "", "  ", "one two", "one two", "one two three", "a " * 5_000]
    for size in (12, 60, 60, 300, 4_000):
        base = [f"w{rng.randrange(5_000)}" for _ in range(size)]
        for _ in range(rng.randint(2, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                copy[rng.randrange(size)] = f"x{rng.randrange(9_999)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
        texts.append(" ".join(base))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(60)]
    return texts


@pytest.mark.parametrize("blocks", [None, 5])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:  # every group is cut, as very large ones are
        monkeypatch.setattr(near.candidate_edges, "__defaults__", (blocks,))
        monkeypatch.setattr(near.linked_classes, "__defaults__", (blocks,))
    texts = near_texts(random.Random(11))
    sets = exact_sets(texts)
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b]
             and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    degree = [sum(x in pair for pair in links) for x in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, member int, root string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in jaccard.near_copies(docs).collect()}
    want = grouped(len(texts), links)
    assert got == {i: (want[i], degree[i], want[i] == i) for i in range(len(texts))}


def test_jaccard_odd_keys(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (3, text), (3, text), (4, "other words that are quite different from those"), (4, text), (9, None)]
    got = sorted(((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in jaccard.near_copies(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 3, 3), (3, 3, 3), (3, 3, 3), (4, 3, 3), (4, 4, 0), (9, 9, 0)]
    assert jaccard.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chosen_paths_reach_the_target():
    rng = np.random.default_rng(3)
    depth = 3
    runs = jaccard.runs_for(depth)
    functions = shingles.hash_functions(jaccard.COORDINATES, jaccard.SEED)
    met = far = 0
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 1_000, np.uint64)
        signatures = np.stack([shingles.minhash(s, *functions) for s in (pool[:900], pool[100:], rng.integers(0, 1 << 63, 900, np.uint64))])
        row, path = jaccard.chosen_paths(signatures.astype(np.uint64), depth, runs)
        ends = [set(path[row == k].tolist()) for k in range(3)]
        met += bool(ends[0] & ends[1])
        far += bool(ends[0] & ends[2])
    assert met >= 399 and far == 0


def test_shingles_ignore_only_white_space():
    a = shingles.shingle_set("the quick  brown\tfox jumps\nover")
    assert np.array_equal(a, shingles.shingle_set(" the quick brown fox\x0bjumps over "))
    assert len(a) == 2 and len(shingles.shingle_set(None)) == 0 and len(shingles.shingle_set("one")) == 1
    assert not np.array_equal(a, shingles.shingle_set("the quick brown fox jumps Over"))
    words = [f"{i}" for i in range(20_000)]
    assert len(np.unique(shingles.word_hashes(" ".join(words)))) == 20_000


def vectors(rng):
    rows, made = [], []
    for label in (1, 2, None):
        for _ in range(6):
            base = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 12))):
                made.append((label, (base + rng.normal(0, rng.choice([0.02, 0.2, 0.4]), 24)).tolist()))
    made += [made[0], made[0], (1, [0.0] * 24), (1, None), (1, [float("nan")] * 24), (1, [None] * 24), (1, []), (2, [float("inf")] + [1.0] * 23),
             (1, [1.0, 2.0]), (1, [2.0, 4.0]), (1, [1e200, 2e200])]
    for i, (label, v) in enumerate(made):
        rows.append((i, v, label))
    return rows


@pytest.mark.parametrize("blocks", [None, 4])
def test_cap_filters_equal_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(near.candidate_edges, "__defaults__", (blocks,))
        monkeypatch.setattr(near.linked_classes, "__defaults__", (blocks,))
    rows = vectors(np.random.default_rng(8))

    def cosine(a, b):
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))
    fine = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if fine[a] and fine[b] and rows[a][2] == rows[b][2]
             and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= 0.93]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, copies int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_embeddings(frame).collect()}
    want = grouped(len(rows), links)
    assert got == {i: (sum(i in p for p in links), want[i], want[i] == i) for i in range(len(rows))}
    assert caps.near_embeddings(frame.limit(0)).count() == 0


def test_list_decoding_finds_all_filters():
    rng = np.random.default_rng(2)
    unit = caps.unit_rows(rng.normal(size=(30, 16)))
    code = caps.Code(16, 2, 12, 0.45)
    row, chosen = caps.list_decode(unit, code, 1)
    rotation, words = caps.directions(code, 1)
    turned = unit @ rotation
    scores = (turned[:, :8] @ words[0].T)[:, :, None] + (turned[:, 8:] @ words[1].T)[:, None, :]
    least = np.minimum(0.45, scores.max((1, 2)) - caps.MARGIN / 4)
    want = {(r, a * 12 + b) for r, a, b in zip(*np.nonzero(scores >= least[:, None, None]), strict=True)}
    assert {(int(r), int(c)) for r, c in zip(row, chosen, strict=True)} == want


def test_no_score_matrix_grows_with_rows_or_words(monkeypatch):
    largest, wide = [], np.nonzero
    monkeypatch.setattr(caps, "ENTRIES", 1 << 14)
    monkeypatch.setattr(caps.np, "nonzero", lambda a: largest.append(a.size) or wide(a))
    unit = caps.unit_rows(np.random.default_rng(1).normal(size=(700, 64)))
    for rows in (10**4, 10**6, 10**8, 10**10):
        code = caps.Code.for_rows(64, rows)
        assert code.words <= caps.WORDS
        sliced = caps.list_decode(unit, code, 0)
        assert max(largest) <= 1 << 14
        monkeypatch.setattr(caps, "ENTRIES", 1 << 22)
        whole = caps.list_decode(unit, code, 0)
        monkeypatch.setattr(caps, "ENTRIES", 1 << 14)
        largest.clear()
        assert sorted(zip(*map(list, sliced), strict=True)) == sorted(zip(*map(list, whole), strict=True))
        assert set(sliced[0].tolist()) == set(range(700))
    assert all(len(x) == 0 for x in caps.list_decode(unit[:0], code, 0))


@pytest.mark.parametrize("rows", [500, 20_000, 1_000_000, 10_000_000, 100_000_000])
def test_filters_meet_at_the_threshold(rows):
    rng = np.random.default_rng(4)
    x = caps.unit_rows(rng.normal(size=(1_500, 64)))
    z = rng.normal(size=x.shape)
    z = caps.unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = caps.COSINE * x + math.sqrt(1 - caps.COSINE**2) * z
    code, met = caps.Code.for_rows(64, rows), np.zeros(len(x), bool)
    for which in range(caps.CODES):
        keys = [r * code.words**code.parts + c for r, c in (caps.list_decode(v, code, which) for v in (x, y))]
        met[np.intersect1d(*keys) // code.words**code.parts] = True
    assert met.mean() >= 0.998
    assert np.bitwise_count(caps.sketch(x) ^ caps.sketch(y)).sum(1).max() <= caps.most_different(caps.COSINE)


def test_stored_in_the_shared_folder(spark):
    frame = near.stored(spark.range(3), "t")
    assert frame.count() == 3 and spark.conf.get("spark.checkpoint.dir") in frame.inputFiles()[0]


def test_null_keys_link_by_their_own_text(spark):
    words = [f"w{i}" for i in range(60)]
    left, middle, right = words[:54], words[:60], words[6:60]
    # 50 of 56 shingles; the outer two share only 44 of 56
    rows = [(1, " ".join(left)), (None, " ".join(middle)), (2, " ".join(right)), (None, "alone " + " ".join(f"q{i}" for i in range(30))),
            (None, "alone " + " ".join(f"q{i}" for i in range(31)))]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["kept"]) for r in jaccard.near_copies(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 1, False), (0, 0, 1, False), (0, 1, 2, False), (1, 1, 1, True), (2, 1, 1, False)]
