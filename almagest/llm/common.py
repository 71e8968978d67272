"""Vectorised text primitives shared by the training-data operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so whole Arrow
batches are cut and hashed with numpy, without an object per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHIFT = (np.uint64(30), np.uint64(27), np.uint64(31))
_MUL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _malloc_trim = None


def trim(result=None):
    """Give freed memory back to the system, as an idle worker process keeps it else; returns its argument."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)
    return result


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> _SHIFT[0])
    x *= _MUL[0]
    x ^= x >> _SHIFT[1]
    x *= _MUL[1]
    x ^= x >> _SHIFT[2]
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FULL = np.ones(256, dtype=bool)
_FULL[_SPACE] = False
#: Masks of the first 0 to 8 bytes of a little-endian piece.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunked(offsets: np.ndarray, limit: int = 2 << 20):
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


#: Letters and digits (every byte from 0x80 is a letter).
LETTERS = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def lower_case(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _FULL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, a run of bytes that are ``inside``; a word never crosses a row."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    full = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(full)
    before[0], before[1:] = False, full[:-1]
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.empty_like(full)
    after[-1], after[:-1] = False, full[1:]
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if ``lower``); another ``salt`` gives an independent one.

    Every 8-byte piece goes through a bijection that is not linear, with a key of
    its place, before the pieces are added up, so words of a regular build don't
    meet as they do under a polynomial modulo 2**64.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    pieces = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    key = lambda k: mix(np.asarray(k).astype(np.uint64) * np.uint64(2) + np.uint64(2 * salt << 40 | 1))
    total = mix((pieces[starts] & _MASK[np.minimum(size, 8)]) ^ key(np.zeros(1)))
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) >> 3
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n) + 1
        value = pieces[np.repeat(starts[long], n) + 8 * k] & _MASK[np.minimum(np.repeat(size[long], n) - 8 * k, 8)]
        total[long] += np.add.reduceat(mix(value ^ key(k)), first)
    return mix(total + size.astype(np.uint64))


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first, which) as ``np.unique`` gives them, without its stable sort."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    order = hashes & ~low
    order |= np.arange(len(hashes), dtype=np.uint64)
    order.sort()  # the high bits and the place as one: a plain sort is faster than one of places
    order &= low
    order = order.astype(np.int64)
    values = hashes[order]
    if (values[1:] < values[:-1]).any():  # unequal ones have the same high bits
        order = np.argsort(hashes)
        values = hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    which = np.empty(len(hashes), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return values[starts], np.minimum.reduceat(order, starts) if len(starts) else order, which


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): words that stand for all equal ones, and for each word its stand-in's number; the bytes are compared."""
    hashes, salt = word_hashes(data, starts, ends), 1
    while True:
        _, first, which = numbered(hashes)
        if _same_words(data, starts, ends, first[which]):
            return first, which
        hashes, salt = mix(hashes + word_hashes(data, starts, ends, salt=salt)), salt + 1


def _same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the bytes of the word ``other`` names."""
    size = ends - starts
    if not len(size):
        return True
    if (size != size[other]).any():
        return False
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    pieces = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    if ((pieces[starts] ^ pieces[starts[other]]) & _MASK[np.minimum(size, 8)]).any():
        return False
    long = np.flatnonzero((size > 8) & (other != np.arange(len(other))))
    n = (size[long] - 1) >> 3
    k = 8 * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1)
    left = np.minimum(np.repeat(size[long], n) - k, 8)
    return not ((pieces[np.repeat(starts[long], n) + k] ^ pieces[np.repeat(starts[other[long]], n) + k]) & _MASK[left]).any()


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each run of ``width`` words inside one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        total ^= total >> _SHIFT[2]
        total *= _BASE
        total += hashes[j : j + n]
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(total[first] + np.uint64(width)), first


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their differences (the high planes compress away)."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier (as long) and the text, so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Ranges of doc_id that a first look tells apart; blocks in all, 8 MB of cuts: past 8 TB blocks of 8 MB grow.
FIRST_LOOK = 1024
MOST_BLOCKS = 1 << 20


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).head()
    return row[0], row[1] or 0


def _rank(cuts: Column, x: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= x))


def _place(cuts: list[int], x: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``x``: a look among every 32nd, then among the 32."""
    if not cuts:
        return F.lit(0)
    lines = [F.array(*(F.lit(c).cast("long") for c in part)) for part in (cuts[::32], *(cuts[i : i + 32] for i in range(0, len(cuts), 32)))]
    top = _rank(lines[0], x)
    return F.when(top == 0, 0).otherwise((top - 1) * 32 + _rank(F.get(F.array(*lines[1:]), top - 1), x))


def with_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with an int column ``block`` that ascends with doc_id, and the number of blocks.

    A block is a range of doc_id of about ``block_bytes`` of text, at any size of
    the corpus up to ``MOST_BLOCKS`` of them, and larger only for a longer document or for rows of
    one id, which share a block; null ids have block 0 to themselves.  A first
    look finds quantiles of doc_id and the bytes between them; short ranges are
    joined and long ones are cut again at quantiles of their own.  The cuts are
    fixed here, so the column is a pure function of doc_id however often it is
    computed.
    """
    steps = FIRST_LOOK
    cuts = docs.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], 20 * steps)).head()[0]
    cuts = sorted(set(cuts or []))
    looked = docs.where("doc_id is not null").select("doc_id", F.octet_length("text").cast("long").alias("size"), _place(cuts, F.col("doc_id")).alias("look"))
    sizes = {r.look: r.size or 0 for r in looked.groupBy("look").agg(F.sum("size").alias("size")).collect()}  # a row a range
    block_bytes = max(block_bytes, -(-sum(sizes.values()) // (MOST_BLOCKS // 2)))
    pieces = {look: min(-(-size // block_bytes), MOST_BLOCKS // steps) for look, size in sizes.items() if size > block_bytes}
    inner = {}
    if pieces:
        most = max(pieces.values())
        some = looked.where(F.col("look").isin(list(pieces))).groupBy("look").agg(F.percentile_approx("doc_id", [i / most for i in range(1, most)] or [0.5], 20 * most).alias("q"))
        inner = {r.look: sorted({r.q[most * i // pieces[r.look] - 1] for i in range(1, pieces[r.look])}) for r in some.collect()}
    chosen, held = [], 0
    for look, lower in enumerate([None, *cuts]):
        size = sizes.get(look, 0)
        if lower is not None and held and held + size > block_bytes:
            chosen.append(lower)
            held = 0
        held += size
        if look in inner:
            chosen += inner[look]
            held = block_bytes  # the next range starts a block
    chosen = sorted(set(chosen))
    if len(chosen) < FIRST_LOOK:
        block = _place(chosen, F.col("doc_id"))
        return docs.withColumn("block", F.when(F.col("doc_id").isNull(), 0).otherwise(block + 1).cast("int")), len(chosen) + 2
    parts = [chosen[i : i + FIRST_LOOK] for i in range(0, len(chosen), FIRST_LOOK)]
    table = docs.sparkSession.createDataFrame([(i, p) for i, p in enumerate(parts)], "_part int, _cuts array<long>")  # at most 8 MB
    docs = docs.withColumn("_part", F.greatest(_place([p[0] for p in parts], F.col("doc_id")) - 1, F.lit(0)))
    docs = docs.join(F.broadcast(table), "_part", "left")
    block = F.col("_part") * FIRST_LOOK + F.size(F.filter("_cuts", lambda c: c <= F.col("doc_id"))) + 1
    return docs.withColumn("block", F.when(F.col("doc_id").isNull(), 0).otherwise(block).cast("int")).drop("_part", "_cuts"), len(chosen) + 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, per_class: int) -> DataFrame:
    """(doc_id, text, label, share) of at most ``per_class`` training rows of each class.

    Training rows are those whose crc32(doc_id as text) mod ``folds`` is not 0.
    The sample is the rows of least hash, so it is the same in every run; its
    size is bounded, so it is broadcast.  ``share`` is the class's share of all
    training rows.  Null labels and ids are left out; of several labels for one id
    the greatest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) or 1
    chosen = None
    for value, n in sorted(counts.items()):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("share", F.lit(n / total))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return id_text(docs).where("false").select("doc_id", "text", F.lit(0).alias("label"), F.lit(0.0).alias("share"))
    return id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", "share")
