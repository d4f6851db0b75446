"""Sentence-piece encoding by backtracking, and decoding.

The pieces of a text are found from left to right.  At each place an
Aho-Corasick automaton gives the longest piece; it may follow the piece before
it if merging the letters of both again gives just these two.  If not, its
longest prefix that is a piece is tried, and where none fits, the piece before
is taken back and the place is marked in a bit field, never to be tried again.
A row of pieces in which every two neighbours may meet is what the merges in
order of their scores make of the whole text, so the result is exact.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain, groupby

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The sign that stands for a space in pieces (fixed value).
SPACE = "▁"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

#: Letters of text in one output batch; words, and pairs of pieces, that a worker
#: remembers; letters of the longest word remembered.
CHUNK, REMEMBERED, LONG_WORD = 3_000_000, 400_000, 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; values of 4 and 8 bytes stay bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """The pieces of a model file with merges of pairs, whole texts kept as they are but for a leading space."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer, normal = (dict(chain.from_iterable(_fields(v) for k, v in model if k == n)) for n in (2, 3))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or normal.get(1) != b"identity" or normal.get(4, 1):
            raise ValueError("only merge-type models that keep every letter and space are read")
        self.lead = SPACE if normal.get(3, 1) else ""
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.raw: list[bytes] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.byte = [-1] * 256
        for k, item in enumerate(v for n, v in model if n == 1):
            piece = dict(_fields(item))
            name, kind = piece[1].decode(), piece.get(3, NORMAL)
            raw = b""
            if kind == NORMAL:
                self.ids[name], raw = k, name.replace(SPACE, " ").encode()
            elif kind == BYTE:
                self.byte[int(name[3:5], 16)], raw = k, bytes([int(name[3:5], 16)])
            elif kind == UNKNOWN:
                raw = trainer.get(44, " ⁇ ".encode())
            elif kind != CONTROL:
                raise ValueError("user-defined and unused pieces are not read")
            self.names.append(name)
            self.raw.append(raw)
            self.score.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            self.kind.append(kind)
        # A control piece parts bytes before and after it: no text, so that the slower way is taken.
        self.quick = [b"\xff" if kind == CONTROL else raw for kind, raw in zip(self.kind, self.raw, strict=True)]
        self.end = self.names.index(trainer.get(47, b"</s>").decode())
        if -1 in self.byte:
            raise ValueError("only models with a piece for every byte are read")
        # Pieces that merging doesn't make of their own letters are never made.
        made = {name: k for name, k in self.ids.items() if self.merged(name) == [k]}
        self.automaton = ahocorasick.Automaton()
        for name, k in made.items():
            self.automaton.add_word(name, k)
        self.automaton.make_automaton()
        self.length = list(map(len, self.names))
        self.prefix = [-1] * len(self.names)
        for name, k in made.items():
            self.prefix[k] = next((made[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in made), -1)
        self.meets = {name[i : i + 2] for name in made for i in range(len(name) - 1)}
        letters = re.escape("".join(sorted(name for name in made if len(name) == 1 and name != SPACE)))
        # No piece has a space after a letter: texts are cut there, and around letters that are no pieces.
        if any(a != SPACE and b == SPACE for a, b in self.meets):
            self.words = re.compile(f"[{letters}{SPACE}]+|[^{letters}{SPACE}]+").findall
        else:
            self.words = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|[^{letters}{SPACE}]+").findall
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[int]:
        """The pieces of a short text by merging: always the pair with the best score, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, spot = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, spot = self.score[k], i
            if spot < 0:
                return [self.ids[p] for p in parts]
            parts[spot : spot + 2] = [parts[spot] + parts[spot + 1]]

    def may_meet(self, left: int, right: int) -> bool:
        """Whether merging the letters of both pieces again gives these two."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            found = self.merged(self.names[left] + self.names[right]) == [left, right]
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def backtracked(self, word: str) -> list[int]:
        """The pieces of letters that all are pieces themselves."""
        size, longest = len(word), [-1] * len(word)
        for last, k in self.automaton.iter(word):  # longer pieces of a place come later
            longest[last + 1 - self.length[k]] = k
        failed = bytearray(size // 8 + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        while at < size:
            end = at + self.length[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.may_meet(out[-1], piece)):
                out.append(piece)
                at = end
                piece = longest[at] if at < size else -1
                continue
            piece = self.prefix[piece]
            while piece < 0:  # nothing fits here: take back the piece before and try its prefix
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= self.length[piece]
                piece = self.prefix[piece]
        return out

    def pieces_of(self, word: str) -> list[int]:
        if word[0] not in self.ids:
            return [self.byte[b] for b in word.encode("utf-8", "replace")]
        return self.backtracked(word)

    def learn(self, word: str) -> list[int]:
        """The pieces of a word; long ones are cut where no piece spans the border, and aren't remembered."""
        if len(word) <= LONG_WORD:
            found = self.known[word] = self.pieces_of(word)
            return found
        if word[0] not in self.ids:
            return self.pieces_of(word)
        out, start = [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in self.meets:
                part = word[start:i]
                out += self.known.get(part) or (self.learn(part) if i - start <= LONG_WORD else self.backtracked(part))
                start = i
        return out

    def encode(self, text: str, end: bool = True) -> list[int]:
        """The piece ids of a text, with the end id after them."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        known, learn = self.known.get, self.learn
        words = self.words(self.lead + text.replace(" ", SPACE)) if text else ()
        ids = list(chain.from_iterable([known(w) or learn(w) for w in words]))
        return [*ids, self.end] if end else ids

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids: one leading space goes, bytes that are no text become U+FFFD each."""
        if ids and (min(ids) < 0 or max(ids) >= len(self.raw)):
            raise ValueError("ids outside the vocabulary")
        while ids and self.kind[ids[-1]] == CONTROL:
            ids = ids[:-1]
        try:
            text = b"".join(map(self.quick.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = "".join(
                _lenient(b"".join(self.raw[k] for k in run)) if byte else b"".join(self.raw[k] for k in run).decode()
                for byte, run in groupby(ids, lambda k: self.kind[k] == BYTE)
            )
        if self.lead and text.startswith(" "):
            first = next(k for k in ids if self.raw[k])
            return text[1:] if self.kind[first] == NORMAL else text
        return text


def _lenient(data: bytes) -> str:
    out = []
    while data:
        for n in (1, 2, 3, 4):
            try:
                out.append(data[:n].decode())
            except UnicodeDecodeError:
                continue
            data = data[n:]
            break
        else:
            out.append("�")
            data = data[1:]
    return "".join(out)


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _chunks(size: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most CHUNK letters, or one row."""
    start = total = 0
    for k, n in enumerate(size):
        if k > start and total + n > CHUNK:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(size):
        yield start, len(size)


def _batches(batches: Iterator[pa.RecordBatch], columns) -> Iterator[pa.RecordBatch]:
    """Each row's first column, and what `columns` makes of the values of its second."""
    for batch in batches:
        values = batch.column(1)
        size = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        for a, b in _chunks(pc.fill_null(size, 0).to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *columns(values.slice(a, b - a).to_pylist())],
                names=[str(k) for k in range(1 + len(columns([])))],
            )


def _applied(df: DataFrame, column: str, given, made: list[tuple[str, T.DataType]], columns) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != column or given == "string"])
    frame = df.select(row.alias("0"), F.col(f"`{column}`").cast(given).alias("1"))
    types = [T.StructField(str(k + 1), kind) for k, (_, kind) in enumerate(made)]
    schema = T.StructType([frame.schema["0"], *types])
    out = frame.mapInArrow(lambda batches: _batches(batches, columns), schema)
    return out.select(F.col("0").alias("row"), *[F.col(str(k + 1)).alias(name) for k, (name, _) in enumerate(made)])


_IDS = pa.list_(pa.int32())


def encode(docs: DataFrame, path: str, text_col: str = "text", end: bool = True) -> DataFrame:
    """(row, ids): each input row as a struct, and the piece ids of its whole text.

    A null text counts as empty and gives the end id alone (nothing without
    `end`). Repeated rows stay, each with its ids; columns of any name are
    carried in `row`; an empty table gives an empty one.
    """

    def columns(texts: list) -> list[pa.Array]:
        own = pieces(path)
        return [pa.array([own.encode(t or "", end) for t in texts], _IDS)]

    return _applied(docs, text_col, "string", [("ids", T.ArrayType(T.IntegerType()))], columns)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """(row, ids, text): each input row as a struct without its ids, the ids, and their text.

    Null and empty ids give an empty text; an id outside the vocabulary is an error.
    """

    def columns(ids: list) -> list[pa.Array]:
        own = pieces(path)
        return [pa.array(ids, _IDS), pa.array([own.decode(x or []) for x in ids], pa.string())]

    made = [("ids", T.ArrayType(T.IntegerType())), ("text", T.StringType())]
    return _applied(df, ids_col, "array<int>", made, columns)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", end: bool = True) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256): `encode` and `decode` in one pass over the texts.

    Digests are of the decimal ids joined by spaces, and of the text that the ids
    decode to in UTF-8. Rows as in `encode`.
    """

    def columns(texts: list) -> list[pa.Array]:
        own, n, told, back = pieces(path), [], [], []
        for text in texts:
            ids = own.encode(text or "", end)
            n.append(len(ids))
            told.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())]

    made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _applied(docs, text_col, "string", made, columns)
