"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a chunk of documents lie end to end in one numpy
array, with the start of each in another.  In each round every sequence merges
its own lowest-ranked pair, all sequences at once; sequences without a known
pair leave, and what is left of them is their count.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = np.iinfo(np.int32).max
#: Pre-tokens in one ragged array, and counts a worker remembers.
CHUNK, REMEMBERED = 300_000, 500_000


class Merger:
    """The merge table of a byte-level BPE file with word ends.

    Merging all places of a sequence's lowest pair in one round is the same as
    merging the leftmost again and again if no merge that uses a symbol ranks
    before the one that makes it; __init__ checks that of the file.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.width = len(vocab) + len(spec["added_tokens"]) + 1
        letters = _byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        ranks = np.arange(len(pairs))
        used = np.full(self.width, len(pairs), np.int64)
        np.minimum.at(used, left, ranks)
        np.minimum.at(used, right, ranks)
        if not (used[self.made] > ranks).all():
            raise ValueError(f"{path}: a merge uses a symbol before it is made")
        key = left * self.width + right
        self.rank_of = np.argsort(key).astype(np.int32)
        self.keys = key[self.rank_of]
        pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.pieces = regex.compile(pattern).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of special strings in it."""
        if self.special is None or "<|" not in text:
            parts = [text]
        else:
            parts = self.special.split(text)
        found: list[str] = []
        for part in parts:
            # Letter by letter: str.lower alone writes a final sigma in its own way.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            found += self.pieces(part)
        return found, len(parts) - 1

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Symbols left of each pre-token (none is empty)."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out = np.ones(len(data), np.int64)
        who = np.arange(len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids = self.first[raw]
        stop = np.cumsum(size) - 1
        ids[stop] = self.last[raw[stop]]
        rank = np.full(len(ids), _NONE, np.int32)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[stop] = _NONE
        while len(who):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            on = low < _NONE
            if not on.all():
                out[who[~on]] = size[~on]
                stay = np.repeat(on, size)
                who, size, low, ids, rank = who[on], size[on], low[on], ids[stay], rank[stay]
                if not len(who):
                    break
                start = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(low, size))
            # aaa: of places that overlap, the first, the third, ...
            head = np.r_[True, np.diff(at) != 1]
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            size = size - np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(size))
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))
            last = np.zeros(len(ids), bool)
            last[np.cumsum(size) - 1] = True
            for place in (at, at[at > 0] - 1):
                place = place[~last[place]]
                rank[place] = self.ranks(ids[place], ids[place + 1])
            rank[last] = _NONE
        return out


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD and b < 256]
    plain = [b for b in plain if 0x21 <= b <= 0x7E or 0xA1 <= b]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def _counted(path: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, known = merger(path), {}

    def flush(waiting: list[tuple[list[str], int]]) -> list[int]:
        fresh = list({w for words, _ in waiting for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, table.counts(fresh).tolist(), strict=True))
        done = [sum(map(known.__getitem__, words)) + n for words, n in waiting]
        if len(known) > REMEMBERED:
            known.clear()
        return done

    for batch in batches:
        counts: list[int] = []
        waiting, held = [], 0
        for text in batch.column(1):
            waiting.append(table.split(text.as_py() or ""))
            held += len(waiting[-1][0])
            if held > CHUNK:
                counts += flush(waiting)
                waiting, held = [], 0
        counts += flush(waiting)
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), size.cast(pa.int64()), pa.array(counts, pa.int64())],
            names=schema.names,
        )


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids are
    counted each for itself, and an empty table gives an empty one. Only the two
    named columns are read, so others cannot clash. Special strings inside a
    text are one token each; none are added, nothing is cut off or filled up.
    Long texts and long pre-tokens only make the arrays of one chunk longer.
    The work is a narrow map over Arrow batches: no shuffle.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    names = pa.schema([("_id", pa.null()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    pairs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = pairs.mapInArrow(functools.partial(_counted, path, names), schema)
    return out.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
