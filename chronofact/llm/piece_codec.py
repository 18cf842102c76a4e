"""SentencePiece encoding and decoding by a table of the last token of every prefix.

A run of merges is valid exactly if every two neighbours are what merging the
two alone would leave, so each prefix of a text has one last token: the match
of an automaton of all pieces that ends there and goes with the last token of
the prefix before it. One pass fills the table, whatever the length of the
text, and the ids are read off it from the end backwards.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .bpe import _added, _extended
from .pieces import Memory, calls

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Pairs of tokens whose test a worker remembers.
PAIRS = 1_000_000
#: Words that a worker remembers.
WORDS = 800_000
START = -2
#: One event of merging a token's characters alone: its rank, and the outer symbol it leaves.
Events = list[tuple[float, str]]


class PieceTable:
    """The pieces of one model, how they merge, and which may stand side by side.

    Pairs merge if their concatenation is a piece, best score first and, of
    equal scores, leftmost first. Characters without a piece become byte
    tokens. Models with user-defined or unused pieces, or without byte
    tokens, are refused: they encode by other rules.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, self.size = self.library, self.library.get_piece_size()
        size = self.size
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        if len(self.bytes) != 256 or any(lib.is_unused(i) for i in range(size)):
            raise ValueError(f"{path} is not a plain model with byte tokens")
        self.text = {i: lib.id_to_piece(i) for i in range(size) if not special[i]}
        self.rank = {p: -lib.get_score(i) for i, p in self.text.items() if len(p) > 1}
        self.joined = joined = set("".join(self.rank))
        # characters that only occur inside longer pieces are symbols too, numbered from the end
        for n, char in enumerate(sorted(joined - set(self.text.values()))):
            self.text[size + n] = char
        self.ids = {p: i for i, p in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for i, piece in self.text.items():
            if self.merges_to_itself(piece):
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.right: dict[int, Events] = {}
        self.left: dict[int, Events] = {}
        self.pairs: dict[int, bool] = {}
        #: No piece reaches across two matches of these patterns.
        self.segments = re.compile(self._pattern(), re.DOTALL)
        inside = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.words = re.compile(".+" if inside else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if "\n" not in joined else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)

    def _pattern(self) -> str:
        """Runs of letters, or of other characters of longer pieces, with the spaces before them; and what merges with nothing.

        Kinds that some piece joins are not told apart.
        """
        def kind(char: str) -> str:
            return SPACE if char == SPACE else "letter" if char.isalpha() else "other"

        joins = {(kind(a), kind(b)) for p in self.rank for a, b in zip(p, p[1:], strict=False)}
        if not self.joined:
            return ".+"
        kinds = {name: re.escape("".join(sorted(c for c in self.joined if kind(c) == name))) for name in ("letter", "other")}
        every = re.escape("".join(sorted(self.joined | {SPACE})))
        if joins & {("letter", SPACE), ("other", SPACE)}:
            return f"[{every}]+|[^{every}]+"
        if joins & {("letter", "other"), ("other", "letter")}:
            kinds = {"both": "".join(kinds.values())}
        runs = [f"{SPACE}*[{chars}]+" for chars in kinds.values() if chars]
        return "|".join([*runs, f"{SPACE}+", f"[^{every}]+"])

    def alone(self, piece: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The symbols that merging leaves of ``piece``, and each merge's rank with the first and last symbol after it."""
        symbols, events = list(piece), []
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                rank = self.rank.get(symbols[k] + symbols[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                return symbols, events
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            events.append((best, symbols[0], symbols[-1]))

    def merges_to_itself(self, piece: str) -> bool:
        return len(piece) == 1 or len(self.alone(piece)[0]) == 1

    def _edge(self, token: int, right: bool) -> Events:
        held = self.right if right else self.left
        found = held.get(token)
        if found is None:
            piece = self.text[token]
            first = (0.0, piece[-1] if right else piece[0])
            found = held[token] = [first, *[(rank, b if right else a) for rank, a, b in self.alone(piece)[1]]]
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Merging the text of ``a`` and ``b`` leaves exactly these two.

        Both merge as they do alone, the better next merge first, unless their
        outer symbols merge before either: a tie goes to the left.
        """
        left, right = self._edge(a, True), self._edge(b, False)
        i = j = 0
        while True:
            across = self.rank.get(left[i][1] + right[j][1])
            ra = left[i + 1][0] if i + 1 < len(left) else float("inf")
            rb = right[j + 1][0] if j + 1 < len(right) else float("inf")
            if across is not None and across < ra and across <= rb:
                return False
            if ra == rb == float("inf"):
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1

    def last_tokens(self, segment: str) -> array:
        """For each prefix of ``segment``, the last token of its encoding."""
        last = array("i", [-1]) * (len(segment) + 1)
        last[0] = START
        known = self.pairs.get
        for end, (size, token) in self.automaton.iter(segment):
            if last[end + 1] == -1:
                before = last[end + 1 - size]
                if before == START or (fits := known(before << 32 | token)) or (fits is None and self.fits(before, token)):
                    last[end + 1] = token
        return last

    def fits(self, a: int, b: int) -> bool:
        """:meth:`compatible`, remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self.compatible(a, b)
        return found

    def encode_segment(self, segment: str) -> list[int]:
        if len(segment) == 1 or segment[0] not in self.joined:  # characters that merge with nothing
            return [i for c in segment for i in self.spelled(c)]
        last, at, out = self.last_tokens(segment), len(segment), []
        while at:
            token = last[at]
            out.append(token)
            at -= len(self.text[token])
        out.reverse()
        if max(out) >= self.size:
            return [i for t in out for i in ([t] if t < self.size else self.spelled(self.text[t]))]
        return out

    def spelled(self, char: str) -> list[int]:
        found = self.ids.get(char)
        if found is not None and found < self.size:
            return [found]
        return [self.bytes[b] for b in char.encode()]

    def pack(self, segments: list[str]) -> list[bytes]:
        return [array("I", self.encode_segment(s)).tobytes() for s in segments]

    def split(self, text: str) -> list[str]:
        """Parts of a normalised ``text`` that can be encoded one by one; in most models, words."""
        return self.words.findall(text)


@functools.cache
def piece_table(path: str = MODEL) -> PieceTable:
    return PieceTable(path)


@functools.cache
def _memory(path: str) -> Memory[bytes]:
    """Ids of words; what is new is put together from the ids of its segments."""
    table = piece_table(path)
    segments = Memory(table.pack)

    def pack_words(words: list[str]) -> list[bytes]:
        split = [table.segments.findall(w) for w in words]
        known = segments.learn(split).__getitem__
        return [b"".join(map(known, s)) for s in split]

    return Memory(pack_words, limit=WORDS)


def packed_ids(texts: list[str], path: str = MODEL, ends: bool = True) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, between begin and end if ``ends``.

    Texts are normalised as the model says. Segments that no piece crosses are
    encoded by themselves; those that the worker has met before are looked up.
    """
    table = piece_table(path)
    split = [table.split(table.library.normalize(t)) for t in texts]
    known = _memory(path).learn(split).__getitem__
    first, last = (array("I", [i]).tobytes() if ends else b"" for i in (table.library.bos_id(), table.library.eos_id()))
    return [first + b"".join(map(known, s)) + last for s in split]


def decode_ids(ids: list[list[int]], path: str = MODEL) -> list[str]:
    """Texts of lists of ids, by the library."""
    decode = piece_table(path).library.decode
    return [decode(i) if i else "" for i in ids]


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, ends: bool = True) -> DataFrame:
    """``docs`` with ``ids``, replacing such a column. Null and empty texts have no ids but begin and end."""
    schema = _added(docs, [("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for start, end in calls(texts):
                found = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed_ids(texts[start:end], path, ends)]
                yield _extended(batch.slice(start, end - start), {"ids": pa.array(found, pa.list_(pa.int32()))})

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids decode to an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decode_ids([i or [] for i in batch.column(ids).to_pylist()], path)
            yield _extended(batch, {"decoded": pa.array(found, pa.string())})

    return encoded.mapInArrow(run, _added(encoded, [("decoded", T.StringType())]))


def round_trip(docs: DataFrame, text: str = "text", path: str = MODEL, ends: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``packed_ids`` and ``decoded`` in one pass of each batch, replacing such columns.

    ``packed_ids`` are little-endian unsigned 32-bit integers, with begin and
    end if ``ends``; ``decoded`` is the text decoded from them. A null text
    counts as empty. Rows are neither added nor lost, whatever repeats.
    """
    schema = _added(docs, [("n_tokens", T.LongType()), ("packed_ids", T.BinaryType()), ("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for start, end in calls(texts):
                packed = packed_ids(texts[start:end], path, ends)
                back = decode_ids([np.frombuffer(p, "<u4").tolist() for p in packed], path)
                yield _extended(batch.slice(start, end - start), {
                    "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "packed_ids": pa.array(packed, pa.binary()), "decoded": pa.array(back, pa.string())})

    return docs.mapInArrow(run, schema)
