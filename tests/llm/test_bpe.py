import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from chronofact.llm import bpe, pieces, token_counts

ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
TEXTS = [None, "", " ", "\n\n  x", "hello world's 123 !!", "ß é 中文 😀 ok", "<|endoftext|> in text", "a<|endoftext|><|endoftext|>b", "x" * 70_000,
         "word " * 30_000, "՘ odd \U0001fbf0", "tab\tand nbsp  sep"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_rank_encoder(text):
    ids = np.frombuffer(bpe.packed_ids([text])[0], "<u4").tolist()
    assert ids == ENC.encode_ordinary(text)
    assert bpe.decode_bytes(ids) == text.encode() and "".join(bpe.decode_pieces(ids)) == text


def test_split_characters_belong_to_the_id_that_ends_them():
    ids = ENC.encode_ordinary("😀a")
    shown = bpe.decode_pieces(ids)
    assert "".join(shown) == "😀a" and shown[0] == ""
    assert bpe.decode_pieces(ids[:1]) == ["�"]


def test_plain_characters_split_alike():
    library = bpe.tokenizer().pre_tokenizer
    for code in range(0x2FFFF):
        char = chr(code)
        if not 0xD800 <= code < 0xE000 and pieces.is_plain(char):
            text = f"a{char}1{char}!{char}{char} x"
            assert [m.span() for m in pieces.PATTERN.finditer(text)] == [o for _, o in library.pre_tokenize_str(text)], hex(code)


def test_round_trip_table(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, decoded string")
    for row in bpe.round_trip(docs).collect():
        text = TEXTS[row["doc_id"]] or ""
        ids = ENC.encode_ordinary(text)
        assert row["n_tokens"] == len(ids) and bytes(row["decoded"]) == text.encode()
        assert hashlib.sha256(row["packed_ids"]).digest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).digest()
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_offsets_and_decoding(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:8])], "doc_id long, text string")
    for row in bpe.decode(bpe.encode(docs)).collect():
        text = row["text"] or ""
        assert bytes(row["decoded"]) == text.encode() and list(row["ids"]) == ENC.encode_ordinary(text)
        assert len(row["ids"]) == len(row["offsets"])
        for i, o in zip(row["ids"], row["offsets"], strict=True):
            piece = bpe.token_bytes()[i]
            assert piece in text[o["start"]:o["end"]].encode() if len(piece) > 1 else o["end"] > o["start"]


def test_counts_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs).collect()}
    want = token_counts.lengths([t or "" for t in TEXTS * 2], token_counts.TOKENIZER)
    assert got == {i: (n, n > 512) for i, n in enumerate(want)}
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=50), min_size=1, max_size=4))
def test_both_tiers_give_library_counts(texts):
    table = token_counts.compact(["the", " the", "é"], token_counts.TOKENIZER)
    memory = pieces.Memory(lambda p: token_counts.lengths(p, token_counts.TOKENIZER), token_counts.opened(table), limit=5)
    assert token_counts.count_batch(texts, memory, token_counts.TOKENIZER) == token_counts.lengths(texts, token_counts.TOKENIZER)


def test_round_trip_offsets_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    want = {r["doc_id"]: [(o["start"], o["end"]) for o in r["offsets"]] for r in bpe.encode(docs).collect()}
    for row in bpe.round_trip(docs).collect():
        assert np.frombuffer(row["packed_offsets"], "<u4").reshape(-1, 2).tolist() == [list(o) for o in want[row["doc_id"]]]


def test_decoding_reverses_the_byte_table(monkeypatch):
    ranks = bpe.read_ranks(bpe.RANKS)
    assert [*bpe.token_bytes()] == sorted(ranks, key=ranks.__getitem__)
    bpe.tokenizer()
    monkeypatch.setattr(bpe, "read_ranks", lambda path: {})
    assert bpe.token_bytes.__wrapped__() == bpe.token_bytes()
