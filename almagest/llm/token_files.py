"""Token ids as Arrow stream files of equal-length sequences.

Documents are encoded, closed with an end id, and laid end to end in ascending
doc_id order.  Each doc_id range is one file: record batches with a
fixed-size-list column ``ids`` and fixed-size-list columns ``mask`` (true for a
token, false for the padding after the range's last one) and ``last`` (true for a
document's last token).
The documents' ids are in the schema's metadata, so a file tells all about the
documents in it.  All batches but the last have one size and a fixed-size list has
no offsets, so sequence ``k`` of a memory-mapped file lies at a place that
follows from ``k``, and is read there without a copy.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.common import chunked, distinct_words, id_text, text_bytes, trim, with_blocks, words
from almagest.sources.runtime import materialise, new_path

_TAIL = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)


class _Memo(dict):
    """Ids of runs without ASCII white space: no match of the tokenizer's pattern, and no composed character, spans such white space.

    Two generations bound the memory: runs not met since the last change of
    generation are forgotten.
    """

    LIMIT = 400_000
    _MARK = " \x01 "  # a match of its own between words of letters; no letter has its byte

    def __init__(self, path: str, dtype):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = dtype
        self.older: dict[bytes, bytes] = {}
        (self.mark,) = self.tokenizer.encode("\x01", add_special_tokens=False).ids

    def _encode(self, runs: list[str]) -> None:
        """The library's ids of each run; words of letters are given to it many at a time."""
        letters, size = [r for r in runs if r.isalpha()], np.dtype(self.dtype).itemsize
        parts = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([self._MARK.join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids)
            cuts = (np.flatnonzero(ids == self.mark) * size).tolist()
            raw = ids.astype(self.dtype).tobytes()
            self.update(zip([w.encode() for w in part], [raw[lo:hi] for lo, hi in zip([0, *(c + size for c in cuts)], [*cuts, len(raw)])]))
        others = [r for r in runs if not r.isalpha()]
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            for run, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self[run.encode()] = np.array(e.ids, dtype=self.dtype).tobytes()

    def learn(self, runs: list[bytes]) -> list[bytes]:
        """The ids of all of ``runs``, which are distinct."""
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
        found = [self.get(r) for r in runs]
        new = [r for r, f in zip(runs, found) if f is None]
        known = [(r, i) for r, i in zip(new, map(self.older.get, new)) if i is not None]
        self.update(known)
        if len(known) < len(new):
            self._encode([r.decode() for r in new if r not in self] if known else [r.decode() for r in new])
        return list(map(self.__getitem__, runs)) if new else found


@lru_cache(maxsize=2)
def _memo(path: str, dtype: str) -> _Memo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Memo(path, dtype)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of runs without white space; marks that end a run after an ASCII letter are a piece of their own, as they are matched apart."""
    starts, ends, rows = words(data, offsets)
    core, open_ = ends.copy(), np.arange(len(ends))
    for _ in range(4):
        open_ = open_[(core[open_] > starts[open_])]
        open_ = open_[_TAIL[data[core[open_] - 1]]]
        core[open_] -= 1
    core = np.where((core > starts) & (core < ends) & _LETTER[data[np.maximum(core - 1, 0)]], core, ends)
    split = core < ends
    at = np.cumsum(1 + split) - 1 - split
    out = np.empty((2, len(starts) + int(split.sum())), dtype=np.int64)
    out[0, at], out[1, at] = starts, core
    out[0, at[split] + 1], out[1, at[split] + 1] = core[split], ends[split]
    return out[0], out[1], np.repeat(rows, 1 + split)


def _joined(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` from each place, end to end."""
    ends = np.cumsum(size)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - ends + size, size)]


def encode_texts(column: pa.Array, path: str, end_id: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, end to end; and the number of ids of each text.

    Equal to the library's own on every text, its special tokens included; the
    library sees each distinct run once.
    """
    memo, kind = _memo(path, dtype), np.dtype(dtype)
    data, offsets = text_bytes(column)
    out, sizes = [], []
    for lo, hi in chunked(offsets, 8 << 20):
        part, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, rows = _pieces(part, cuts)
        first, which = distinct_words(part, starts, ends)
        raw = part.tobytes()
        runs = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        found = memo.learn(runs)
        length = np.array([len(f) for f in found] + [kind.itemsize], dtype=np.int64) // kind.itemsize
        pool = np.frombuffer(b"".join(found) + np.array([end_id], kind).tobytes(), dtype=kind)
        count = np.bincount(rows, minlength=hi - lo)
        token = np.full(len(rows) + hi - lo, len(first), dtype=np.int64)  # the end id closes each text
        closing = np.cumsum(count + 1) - 1
        inside = np.ones(len(token), dtype=bool)
        inside[closing] = False
        token[inside] = which
        size = length[token]
        out.append(_joined(pool, (np.cumsum(length) - length)[token], size))
        sizes.append(np.diff(np.cumsum(size)[closing], prepend=0))
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, kind), np.zeros(0, np.int64))


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_stream(store: fs.FileSystem, path: str, ids: np.ndarray, sizes: np.ndarray, doc_ids: pa.Array, length: int, per_batch: int = 512) -> None:
    """One Arrow stream file of documents of ``sizes`` ids; the last sequence is padded with zeros.

    The file is written aside and then renamed, so a reader never sees a part of
    it; a task that runs again replaces it by an equal one.
    """
    rows, kind = -(-len(ids) // length), pa.from_numpy_dtype(ids.dtype)
    about = {"doc_ids": doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), "known": np.packbits(np.asarray(doc_ids.is_valid())).tobytes(), "n_ids": str(len(ids))}
    schema = pa.schema([(c, pa.list_(pa.field("item", k, False), length)) for c, k in (("ids", kind), ("mask", pa.bool_()), ("last", pa.bool_()))], metadata=about)
    full, mask, last = (np.zeros(rows * length, dtype=k) for k in (ids.dtype, bool, bool))
    full[: len(ids)], mask[: len(ids)], last[np.cumsum(sizes) - 1] = ids, True, True
    store.create_dir(posixpath.dirname(path), recursive=True)
    aside = f"{posixpath.dirname(path)}/_{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as sink, pa.ipc.new_stream(sink, schema) as out:
        for lo in range(0, rows * length, per_batch * length):
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[lo : lo + per_batch * length]), type=schema.field(c).type) for c, x in (("ids", full), ("mask", mask), ("last", last))]
            out.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))
    try:
        store.move(aside, path)
    except OSError:  # a store that does not replace: another run of the task has written the same
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(aside)


def read_stream(store: fs.FileSystem, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of one file: its documents' ids, their numbers of token ids, and those end to end."""
    ids, ends = [], []
    with store.open_input_file(path) as source, pa.ipc.open_stream(source) as batches:
        about = batches.schema.metadata
        kind = batches.schema.field("ids").type.value_type.to_pandas_dtype()
        for batch in batches:
            ids.append(batch.column("ids").flatten().to_numpy())
            ends.append(batch.column("last").flatten().to_numpy(zero_copy_only=False))
    ids, last = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((ids, kind), (ends, bool)))
    numbers = np.frombuffer(about[b"doc_ids"], "<i8")
    known = np.unpackbits(np.frombuffer(about[b"known"], np.uint8), count=len(numbers)).astype(bool)
    sizes = np.diff(np.flatnonzero(last) + 1, prepend=0)
    return pa.array(numbers, mask=~known), sizes, ids[: int(sizes.sum())]


def sequence(source: pa.NativeFile, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """``ids``, ``mask`` and ``last`` of sequence ``k`` of a memory-mapped or in-memory stream file: views into it, at a computed place."""
    source.seek(0)
    schema = pa.ipc.read_schema(source)
    head = source.tell()
    first = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    step = source.tell() - head  # every batch but the last is as large
    at, here = divmod(k, len(first))
    if at and head + at * step >= source.size():
        raise IndexError(k)
    source.seek(head + at * step)
    try:
        message = pa.ipc.read_message(source)
    except EOFError:
        raise IndexError(k) from None
    batch = pa.ipc.read_record_batch(message, schema)
    if here >= len(batch):
        raise IndexError(k)
    return tuple(batch.column(c).slice(here, 1).flatten() for c in ("ids", "mask", "last"))


def _write_range(table: pa.Table, folder: str, path: str, end_id: int, length: int, dtype: str) -> pa.Table:
    """Encodes one doc_id range and writes its file."""
    number = table.column("block")[0].as_py()
    ids = pc.fill_null(table.column("doc_id"), np.iinfo(np.int64).min)
    table = table.append_column("order", ids).append_column("words", pc.fill_null(table.column("text"), "")).sort_by([("order", "ascending"), ("words", "ascending")])
    ids, sizes = encode_texts(table.column("words"), path, end_id, dtype)
    store, base = _filesystem(folder)
    name = f"ids-{number:08d}.arrow"
    write_stream(store, f"{base}/{name}", ids, sizes, table.column("doc_id").combine_chunks(), length)
    return pa.table({"block": pa.array([number], pa.int32()), "file": [f"{folder}/{name}"], "n_ids": pa.array([len(ids)], pa.int64())})


_READ = {"ids": "doc_id long, start long, n_tokens long, ids binary", "crc32": "doc_id long, start long, n_tokens long, ids_crc32 long"}


def _read_files(batches, digest: bool):
    """The documents of each file; ``base`` ids lie in the files before it."""
    for batch in batches:
        for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
            numbers, sizes, ids = read_stream(*_filesystem(name))
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
            spans = list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist()))
            last = pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()) if digest else pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([numbers, pa.array(ends - sizes + base, pa.int64()), pa.array(sizes, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
            trim()


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, length: int = 2048, dtype: str = "<u2", folder: str | None = None, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Write the files; return the list of them (block, file, n_ids), whose order is that of the documents, and the folder.

    ``folder`` is one that driver and executors share (by default under
    spark.checkpoint.dir); ``dtype`` must hold every id.  Null text counts as
    empty: it gives the end id alone.  Null ids come first; rows of one id are
    ordered by their text.  An empty table writes no file.  ``block_bytes`` of
    text make a file, a longer document alone or rows of one id excepted.  Special
    tokens in a text get their ids, as the library has it.
    """
    docs = id_text(docs, id_col, text_col)
    folder = folder or new_path(docs.sparkSession, "token-files")
    blocked, blocks = with_blocks(docs, block_bytes)
    written = blocked.repartition(2 * blocks, "block").groupBy("block").applyInArrow(lambda t: trim(_write_range(t, folder, path, end_id, length, dtype)), "block int, file string, n_ids long")
    return materialise(written, "token-index"), folder


def read_token_files(files: DataFrame, digest: bool = False) -> DataFrame:
    """One row (doc_id, start, n_tokens, ids) per document, all read back from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are
    little-endian unsigned 32-bit integers, or with ``digest`` their unsigned
    crc32 as ids_crc32.  No files: no rows.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    starts = materialise(files.select("block", "file", before.alias("base")), "token-starts")
    n = starts.count()
    return starts.repartition(max(1, min(n, 4096)), "block").select("file", "base").mapInArrow(lambda it: _read_files(it, digest), _READ["crc32" if digest else "ids"])


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files, _ = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")
