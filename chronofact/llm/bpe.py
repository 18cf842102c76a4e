"""Byte-level BPE encoding and decoding over Arrow batches.

The ranks are the whole definition: bytes map to printable characters, so the
``tokenizers`` library can hold them as text, and every way to join two known
tokens into a known one is a merge, ranked by the token that it makes.
Decoding reverses the byte table; a token may hold part of a character.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .pieces import PATTERN, Memory, calls, is_plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def byte_characters() -> list[str]:
    """The character for each byte: itself if printable, else one from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every split of a token into two tokens, by the rank of the whole."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    return [(t[:i], t[i:]) for t in ordered for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


@functools.cache
def tokenizer(path: str = RANKS):
    """A library tokenizer equal to the rank file; built once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    def shown(token):
        return "".join(chars[b] for b in token)

    model = models.BPE(vocab={shown(t): r for t, r in ranks.items()},
                       merges=[(shown(a), shown(b)) for a, b in merges_of(ranks)], ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@functools.cache
def token_bytes(path: str = RANKS) -> list[bytes]:
    """The bytes of each id, from the tokenizer's own strings by the byte table reversed; ids without a token have none."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for shown, at in vocabulary.items():
        out[at] = bytes([byte_of[c] for c in shown])
    return out


@functools.cache
def token_lengths(path: str = RANKS) -> np.ndarray:
    return np.array([len(t) for t in token_bytes(path)], np.int64)


def _pack(texts: list[str], path: str) -> list[bytes]:
    found = tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)
    return [np.asarray(e.ids, "<u4").tobytes() for e in found]


@functools.cache
def _memory(path: str) -> Memory[bytes]:
    return Memory(functools.partial(_pack, path=path))


def packed_ids(texts: list[str], path: str = RANKS) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    Pieces that the worker has met before are looked up, others are encoded together.
    """
    plain = [is_plain(t) for t in texts]
    split = [PATTERN.findall(t) for t, ok in zip(texts, plain, strict=True) if ok]
    known = _memory(path).learn(split).__getitem__
    joined = iter([b"".join(map(known, s)) for s in split])
    others = iter(_pack([t for t, ok in zip(texts, plain, strict=True) if not ok], path))
    return [next(joined if ok else others) for ok in plain]


def decode_bytes(ids: Sequence[int], path: str = RANKS) -> bytes:
    table = token_bytes(path)
    return b"".join([table[i] for i in ids])


def decode_pieces(ids: Sequence[int], path: str = RANKS) -> list[str]:
    """The text that each id completes; a split character belongs to the id that ends it.

    Bytes that never become a character turn into U+FFFD, in the last piece if need be.
    """
    table, reader = token_bytes(path), codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(table[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]


def packed_offsets(ids: np.ndarray, decoded: bytes, path: str = RANKS) -> bytes:
    """Start and end character of each id as little-endian unsigned 32-bit integers.

    An id that holds part of a character has the offsets of the whole character.
    """
    lengths = token_lengths(path)[ids]
    ends = np.cumsum(lengths)
    char = np.cumsum((np.frombuffer(decoded, np.uint8) & 0xC0) != 0x80)
    return np.stack([char[ends - lengths] - 1, char[ends - 1]], 1).astype("<u4").tobytes() if len(ids) else b""


def _added(df: DataFrame, names: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    new = {n for n, _ in names}
    kept = [f for f in df.schema.fields if f.name not in new]
    return T.StructType([*kept, *[T.StructField(n, kind) for n, kind in names]])


def _extended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *columns.values()], [*kept, *columns])


def encode(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """``docs`` with ``ids`` and ``offsets`` (start and end character of each id), replacing such columns.

    Whole texts, each match of the pattern separately, no special tokens. Null
    and empty texts have no ids. An id that holds part of a character has the
    offsets of the whole character.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = _added(docs, [("ids", T.ArrayType(T.IntegerType())), ("offsets", T.ArrayType(span))])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for start, end in calls(texts):
                found = tokenizer(path).encode_batch(texts[start:end], add_special_tokens=False)
                yield _extended(batch.slice(start, end - start), {
                    "ids": pa.array([e.ids for e in found], pa.list_(pa.int32())),
                    "offsets": pa.array([[{"start": a, "end": b} for a, b in e.offsets] for e in found], spans)})

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids; null ids decode to no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_bytes(i or (), path) for i in batch.column(ids).to_pylist()]
            yield _extended(batch, {"decoded": pa.array(found, pa.binary())})

    return encoded.mapInArrow(run, _added(encoded, [("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """``docs`` with ``n_tokens``, ``packed_ids``, ``packed_offsets`` and ``decoded`` in one pass of each batch.

    ``packed_ids`` are little-endian unsigned 32-bit integers, ``decoded`` the
    bytes decoded from them and ``packed_offsets`` the start and end character
    of each id. Nulls and empty texts give empty values.
    """
    schema = _added(docs, [("n_tokens", T.LongType()), ("packed_ids", T.BinaryType()), ("packed_offsets", T.BinaryType()),
                           ("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for start, end in calls(texts):
                packed = packed_ids(texts[start:end], path)
                ids = [np.frombuffer(p, "<u4") for p in packed]
                back = [decode_bytes(i.tolist(), path) for i in ids]
                spans = [packed_offsets(i, b, path) for i, b in zip(ids, back, strict=True)]
                yield _extended(batch.slice(start, end - start), {
                    "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "packed_ids": pa.array(packed, pa.binary()), "packed_offsets": pa.array(spans, pa.binary()),
                    "decoded": pa.array(back, pa.binary())})

    return docs.mapInArrow(run, schema)
