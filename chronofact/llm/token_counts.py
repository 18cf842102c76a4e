"""Token counts by a map-side look-up in two tiers.

The lengths of frequent pre-tokens are encoded once and broadcast as a compact
table of bounded size. What it lacks is encoded by the worker and kept in a
bounded cache. No pre-token is shuffled, and the counts do not depend on what
is in either tier.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import _added, _extended
from .pieces import LONGEST, PATTERN, Memory, calls, is_plain

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TABLE_PIECES = 65_536
#: The sample that the table is made of: rows, and characters of a row.
SAMPLE_ROWS = 500
SAMPLE_CHARS = 65_536
LIMIT = 512


@functools.cache
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def lengths(texts: list[str], path: str) -> list[int]:
    return [len(e.ids) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    """Strings that the library takes as one token wherever they occur."""
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


def frequent_pieces(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS, pieces: int = TABLE_PIECES) -> list[str]:
    """The most frequent pre-tokens of the first ``rows`` documents of at most ``SAMPLE_CHARS`` characters, at most ``pieces`` of at most ``LONGEST``."""
    seen: Counter[str] = Counter()
    for row in docs.select(text).where(F.length(text) <= SAMPLE_CHARS).take(rows):
        seen.update(p for p in PATTERN.findall(row[0] or "") if len(p) <= LONGEST)
    return [p for p, _ in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:pieces]]


def compact(pieces: list[str], path: str) -> tuple[bytes, bytes]:
    """The pieces end to end, and a row of (bytes, tokens) for each: under seven megabytes at the default bound."""
    raw = [p.encode() for p in pieces]
    table = np.array([[len(r) for r in raw], lengths(pieces, path) if pieces else []], dtype="<u2")
    return b"".join(raw), table.tobytes()


def opened(table: tuple[bytes, bytes]) -> dict[str, int]:
    blob, rows = table[0], np.frombuffer(table[1], "<u2").reshape(2, -1)
    ends = np.cumsum(rows[0], dtype=np.int64).tolist()
    return {blob[a:b].decode(): n for a, b, n in zip([0, *ends], ends, rows[1].tolist(), strict=False)}


_memories: dict[tuple[str, int], Memory[int]] = {}


def _memory(path: str, table: tuple[bytes, bytes]) -> Memory[int]:
    key = path, hash(table)
    if key not in _memories:
        _memories.clear()
        _memories[key] = Memory(functools.partial(lengths, path=path), opened(table))
    return _memories[key]


def count_batch(texts: list[str], memory: Memory[int], path: str) -> list[int]:
    special = special_strings(path)
    plain = [is_plain(t) and not any(s in t for s in special) for t in texts]
    split = [PATTERN.findall(t) for t, ok in zip(texts, plain, strict=True) if ok]
    known = memory.learn(split).__getitem__
    looked_up = iter([sum(map(known, s)) for s in split])
    others = iter(lengths([t for t, ok in zip(texts, plain, strict=True) if not ok], path))
    return [next(looked_up if ok else others) for ok in plain]


def count_tokens(docs: DataFrame, text: str = "text", path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``over_limit``, replacing such columns.

    Counts are those of the library for whole texts, without truncation,
    padding or tokens around them; special strings inside a text are one token
    each. Null counts as empty: 0 tokens. ``path`` is a byte-level tokenizer
    whose split is the public pattern.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compact(frequent_pieces(docs, text), path))
    schema = _added(docs, [("n_tokens", T.LongType()), ("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memory = _memory(path, shared.value)
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [n for start, end in calls(texts) for n in count_batch(texts[start:end], memory, path)]
            yield _extended(batch, {"n_tokens": pa.array(found, pa.int64()),
                                    "over_limit": pa.array([n > limit for n in found], pa.bool_())})

    return docs.mapInArrow(run, schema)
