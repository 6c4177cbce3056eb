"""Encoding with a byte-level BPE vocabulary by prefix dynamic programming (problem 7).

For every prefix of a byte string there is exactly one token that the encoding of that prefix ends with. Going
from left to right, this last token is found among the tokens that are suffixes of the prefix: it is the one
whose left neighbour (the stored last token of the shorter prefix) forms a pair that merging would leave apart.
The stored last tokens are the encoding: it is read off backwards, appending bytes continues the table exactly,
and after an edit only the entries from the edit on are made again (``PrefixTable``).

Texts are split by the vocabulary's public pattern first; each distinct piece is encoded once per worker, in a
table of bounded size.

Defined cases: null and empty texts give an empty list; whatever looks like a special token is ordinary text; very
long pieces take time in proportion to their length; one output row for each input row, in whatever order; an
empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread

#: The public split pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Vocabulary:
    """Ranks of byte strings, with the two halves that each token is merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.longest = max(map(len, ranks))
        self._apart: dict[tuple[int, int], bool] = {}
        #: Every suffix of a token: reading backwards stops as soon as no token can end so.
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge_below(token, rank)
                if len(parts) == 2:
                    self.halves[rank] = (parts[0], parts[1])
                    self.merged[parts[0], parts[1]] = rank
        self.reachable = {r for t, r in ranks.items() if len(t) == 1 or r in self.halves}

    @classmethod
    def from_bytes(cls, content: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        parts = [self.ids[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.merged.get((parts[i], parts[i + 1]), limit), i) for i in range(len(parts) - 1)))
            if best[0] >= limit:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves exactly these two."""
        known = self._apart.get((left, right))
        if known is not None:
            return known
        a, b, limit = left, right, 1 << 60
        while True:
            if self.merged.get((a, b), limit) < limit:
                ok = False
                break
            # Undo the later of the two merges; from then on only earlier merges can reach across the border.
            if a > b and a in self.halves:
                limit, a = a, self.halves[a][1]
            elif b in self.halves:
                limit, b = b + 1, self.halves[b][0]
            elif a in self.halves:
                limit, a = a, self.halves[a][1]
            else:
                ok = self.merged.get((a, b), limit) >= limit
                break
        if len(self._apart) > 2_000_000:
            self._apart.clear()
        self._apart[left, right] = ok
        return ok


class PrefixTable:
    """The last token of every prefix of a byte string; grows by append, changes by replace."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.start = vocabulary, b"", [], []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, data, begin = self.v, self.data + more, len(self.data)
        self.data = data
        last, start, ids, tails, apart = self.last, self.start, v.ids, v.tails, v.apart
        for end in range(begin + 1, len(data) + 1):
            at = end - 1
            while True:
                piece = data[at:end]
                if piece not in tails:
                    raise ValueError("the vocabulary lacks a byte")
                token = ids.get(piece)
                if token is not None and token in v.reachable and (at == 0 or apart(last[at - 1], token)):
                    break
                at -= 1
                if at < 0:
                    raise ValueError("no valid last token")
            last.append(token)
            start.append(at)

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Replaces data[begin:end]; returns how many entries were made again."""
        tail, old_last, old_start = self.data[end:], self.last[end:], self.start[end:]
        shift = begin + len(new) - end
        self.data, self.last, self.start = self.data[:begin], self.last[:begin], self.start[:begin]
        self.append(new)
        same, k = 0, 0
        # Once as many entries as the longest token agree, all later ones must agree as well.
        while k < len(tail) and same < self.v.longest:
            self.append(tail[k : k + 1])
            agree = self.last[-1] == old_last[k] and self.start[-1] == old_start[k] + shift and old_start[k] >= end
            same, k = (same + 1 if agree else 0), k + 1
        self.data += tail[k:]
        self.last += old_last[k:]
        self.start += [s + shift for s in old_start[k:]]
        return len(new) + k

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end = self.start[end - 1]
        return out[::-1]


class Encoder:
    """Pattern split and a bounded table of known pieces."""

    def __init__(self, vocabulary: Vocabulary, known_pieces: int = 400_000):
        import regex

        self.v, self.split, self.known, self.bound = vocabulary, regex.compile(PATTERN).findall, {}, known_pieces

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        whole = self.v.ids.get(raw)
        ids = [whole] if whole in self.v.reachable else PrefixTable(self.v, raw).ids()
        if len(raw) <= 64:
            if len(self.known) >= self.bound:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in self.split(text or ""):
            ids = known.get(p)
            out += self.piece(p) if ids is None else ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(content: bytes) -> Encoder:
    """One encoder a vocabulary for each Python worker."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary.from_bytes(content))
    return _ENCODERS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, path: str = DEFAULT_RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(_read(path))  # the vocabulary: under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            ids = [np.asarray(encoder.encode(t), np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=[key, "ids"])

    schema = T.StructType([documents.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(documents.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, schema)


def count_tokens(documents: DataFrame, path: str = DEFAULT_RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n): the number of tokens of each row; the ids stay in the worker."""
    shared = documents.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encoder.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())], names=[key, "n"])

    schema = T.StructType([documents.schema[key], T.StructField("n", T.IntegerType())])
    return spread(documents.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, schema)
