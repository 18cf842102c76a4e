import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from chronofact.llm import piece_codec as pc

TABLE = pc.piece_table(pc.MODEL)
LIBRARY = TABLE.library
TEXTS = [None, "", " ", "  two  spaces ", "a\nb\t\x00c", "😀é ﬁ 中文字", "<s> </s> <0x41> <unk>", "▁▁ ▁x", " " * 3_000, "x" * 40_000,
         "the quick " * 20_000, "the quick", "the quick"]


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_and_texts_equal_the_library(text):
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids_of(pc.packed_ids([text])[0]) == want
    assert pc.decode_ids([want]) == [LIBRARY.decode(want)]


@pytest.mark.parametrize("parts", [list(TABLE.text.values()), ["▁", " ", "  ", "\n", "a", "aa", "the", "é", "中"]])
def test_joined_pieces_equal_the_library(parts):
    rng = random.Random(7)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(2_000)]
    want = LIBRARY.encode(texts, add_bos=True, add_eos=True)
    assert [ids_of(p) for p in pc.packed_ids(texts)] == want


def test_pairs_fit_exactly_if_merging_leaves_both():
    rng = random.Random(5)
    ids = [i for i, p in TABLE.text.items() if TABLE.merges_to_itself(p)]
    common = [i for i in ids if len(TABLE.text[i]) < 4]
    for _ in range(6_000):
        a, b = rng.choice(common), rng.choice(common if rng.random() < 0.7 else ids)
        alone = TABLE.alone(TABLE.text[a] + TABLE.text[b])[0]
        assert TABLE.compatible(a, b) == (alone == [TABLE.text[a], TABLE.text[b]]), (TABLE.text[a], TABLE.text[b])


def test_table_has_the_last_token_of_every_prefix():
    for segment in ("▁understanding", "▁aaaaaaaaa", "▁▁▁▁▁▁▁", "▁internationalisation"):
        last = TABLE.last_tokens(segment)
        for end in range(1, len(segment) + 1):
            assert TABLE.text[last[end]] == TABLE.alone(segment[:end])[0][-1]


def test_no_piece_crosses_segments():
    rng = random.Random(2)
    text = "".join(rng.choice(list(TABLE.text.values())) for _ in range(5_000))
    segments = TABLE.segments.findall(text)
    assert "".join(segments) == text
    for a, b in zip(segments, segments[1:], strict=False):
        edge = a[-20:] + b[:20]
        assert not any(len(p) > 1 and edge.find(p) >= 0 and any(
            k < len(a[-20:]) < k + len(p) for k in range(len(edge)) if edge.startswith(p, k)) for p in TABLE.rank if p in edge)


def test_table_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, decoded string, n_tokens int")
    for row in pc.round_trip(docs).collect():
        want = LIBRARY.encode(TEXTS[row["doc_id"]] or "", add_bos=True, add_eos=True)
        assert ids_of(row["packed_ids"]) == want and row["n_tokens"] == len(want)
        assert row["decoded"] == LIBRARY.decode(want)
        assert hashlib.sha256(row["packed_ids"]).digest() == hashlib.sha256(np.array(want, "<u4").tobytes()).digest()
    assert pc.round_trip(docs.limit(0)).count() == 0


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for row in pc.decode(pc.encode(docs, ends=False)).collect():
        want = LIBRARY.encode(TEXTS[row["doc_id"]] or "")
        assert list(row["ids"]) == want and row["decoded"] == LIBRARY.decode(want)


def test_other_models_are_refused(monkeypatch):
    class Without:
        def __init__(self, model_file):
            self.get_piece_size = lambda: 2
            self.is_control = self.is_unknown = self.is_byte = self.is_unused = lambda i: False
            self.id_to_piece, self.get_score = "ab".__getitem__, float
    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Without)
    with pytest.raises(ValueError):
        pc.PieceTable("other.model")
