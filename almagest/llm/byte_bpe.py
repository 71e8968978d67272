"""Byte-level BPE encoding and decoding by longest matches with backtracking.

All token byte strings, reversed and read as Latin-1, form one Aho-Corasick
automaton.  A single scan of the reversed piece lists, for each position, the
tokens that start there, longest first.  A tokenisation is the one that merging
by rank gives exactly if each adjacent pair is *compatible*: merging the two
tokens' joined bytes gives the same two tokens back.  So the encoder takes the
longest compatible token at each position and steps back where none is left;
a position given up once is never entered again, which keeps it linear.  Pair
compatibility depends on nothing else and is memoised, and so are whole pieces.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import id_text, trim

_WHITE = r"\t-\r \x85\xa0  -     　"
#: A run without white space and one space before it, or white space: no match of a pattern crosses these.
_UNITS = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder for one vocabulary of byte tokens and their merge ranks."""

    #: Entries kept of each memo, which bound a worker's memory.
    UNITS, PIECES, PAIRS = 150_000, 200_000, 300_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        #: The longest token that is a proper prefix of each, or -1.
        self.shorter = {rank: next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1) for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation of pieces before

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging by rank, for the two tokens of a pair."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.pairs[left << 32 | right] = self._merged(a + b) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, shorter, sizes, compatible = len(piece), self.shorter, self.sizes, self._compatible
        longest = [-1] * n
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):  # the longest first at each end
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = token
        ids, pos, token, left = [], 0, longest[0], -1
        dead = None
        while True:
            while token >= 0:
                end = pos + sizes[token]
                if (dead is None or not dead[end]) and (left < 0 or compatible(left, token)):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if end == n:
                    return ids
                pos, left, token = end, token, longest[end]
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                if dead is None:
                    dead = bytearray(n + 1)
                dead[pos] = 1
                last = ids.pop()
                pos -= sizes[last]
                left = ids[-1] if ids else -1
                token = shorter[last]

    def forget(self) -> None:
        """Empty the memos of units and pieces: a worker process outlives its tasks, and idle ones must not hold memory."""
        self.units, self.pieces, self.older = {}, {}, {}

    def _unit(self, unit: str) -> bytes:
        parts = []
        for piece in self.find(unit):
            known = self.pieces.get(piece)
            if known is None and (known := self.older.get(piece)) is not None:
                self.pieces[piece] = known
            if known is None:
                ids = self.encode_piece(piece.encode())
                known = struct.pack(f"<{len(ids)}i", *ids)
                if len(piece) < 64:
                    if len(self.pieces) >= self.PIECES:
                        self.older, self.pieces = self.pieces, {}
                    self.pieces[piece] = known
            parts.append(known)
        raw = b"".join(parts)
        if len(unit) < 64:
            if len(self.units) >= self.UNITS:
                self.units.clear()
            self.units[unit] = raw
        return raw

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        known, unit = self.units.get, self._unit
        return b"".join([known(u) or unit(u) for u in _UNITS.findall(text)])

    def decode(self, ids: list[int]) -> bytes:
        return decode_ids(self.tokens, ids)


def decode_ids(tokens: dict[int, bytes], ids: list[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker process and vocabulary."""
    return ByteBPE(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def load_tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id, all that a decoder needs."""
    return {rank: token for token, rank in read_ranks(path).items()}


def _encoded(batches, path: str, pattern: str):
    bpe = load(path, pattern)
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            raw = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
            offsets = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, *part.columns[2:]], names=["doc_id", "ids", *part.schema.names[2:]])
    bpe.forget()
    trim()


def _decoded(batches, path: str):
    tokens = load_tokens(path)
    for batch in batches:
        column = batch.column("ids")
        texts = [None if ids is None else decode_ids(tokens, ids) for ids in (column[i].values.to_numpy().tolist() if column[i].is_valid else None for i in range(len(column)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])
        trim()


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ids array<int>) per input row, in the input's order within a partition.

    ``path`` is a file of base64 tokens and ranks that every executor has.  Each
    match of ``pattern`` is encoded by itself; strings of special tokens are
    ordinary text.  Null and empty texts give an empty array; other columns are
    ignored; repeated rows give repeated rows.
    """
    return id_text(docs, id_col, text_col).mapInArrow(lambda it: _encoded(it, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids; null ids give null."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, path), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ``decode`` of ``encode`` in one pass, which spares a second worker process a task; with ``place`` also that long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([] if place is None else [place.cast("long").alias("place")]))
    schema = "doc_id long, ids array<int>" + ("" if place is None else ", place long")
    return rows.mapInArrow(lambda it: _decoded(_encoded(it, path, pattern), path), schema + ", decoded binary")


def digests(docs: DataFrame, path: str, place: Column | None = None) -> DataFrame:
    """Encodes and decodes whole texts; counts and digests per document, and ``place`` if it is given."""
    both = round_trip(docs, path, place=place)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *([] if place is None else ["place"]),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
