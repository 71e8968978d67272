"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row per document and a column per word n-gram; the product with
its transpose holds the overlap of every pair.  It is never formed whole:

1. Blocking.  Blocks of texts send shards of the n-grams how many of their documents
   have each; the shards answer with the number of all documents.  A document can
   reach a threshold t only if t of its set occurs elsewhere; most can't and are
   done with.  In the order of rarity, two linked documents have an n-gram in
   common among the first (1 - t) of each one's set; these, as far as they occur
   elsewhere, are a document's *signatures*.  Each one ties its documents to the
   least of them, a block of texts at a time, so no pairs of a group are listed.
   What is tied together is a *family*, outside of which no link can exist.
2. Product.  Within a family one row stands for all documents of equal set.
   Rows are cut into tiles in the order of their size, and tiles whose sizes
   exclude a link are not paired.  In a tile pair, overlap counts are
   accumulated column by column (rare columns pair by pair, common ones as dense
   blocks), pairs beyond the size bound are discarded before they are counted,
   and the exact threshold decides on the counts.
3. The links, reduced to one edge a row and tile pair, give the components.

Columns are 64-bit hashes of n-grams.  Two different n-grams of one tile pair
(some 10**6) have equal hashes with a chance of 3 in 10**8, and one such
n-gram changes a link only at the threshold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.common import chunked, corpus_size, id_text, mix, pack_sorted, text_bytes, trim, unpack_sorted, windows, with_blocks, word_hashes, words
from almagest.operators.components import connected_components
from almagest.sources.runtime import materialise

_SALT = mix(np.arange(1, 6, dtype=np.uint64))
TILE = 1024
#: Bytes of text whose sets a worker holds at a time in the product.
SLICE = 3 << 20
#: Documents with an n-gram are counted up to this.
MOST = 65535


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram hash), distinct and in order; a text of fewer words has its whole sequence."""
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    grams, first = windows(hashes, rows, n)
    where, found = [rows[first]], [grams]
    count = np.bincount(rows, minlength=len(offsets) - 1)
    at = np.cumsum(count) - count
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            pieces = np.concatenate([hashes[at[short] + j] for j in range(size)]) if size > 1 else hashes[at[short]]
            pieces = pieces.reshape(size, -1).T.ravel()
            grams, _ = windows(pieces, np.repeat(np.arange(len(short)), size), size)
            where.append(short)
            found.append(grams)
    where, found = np.concatenate(where), np.concatenate(found)
    order = np.lexsort((found, where))
    where, found = where[order], found[order]
    new = np.ones(len(where), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (found[1:] != found[:-1])
    return where[new], found[new]


def _sliced(batches, limit: int):
    """The batches in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        for lo, hi in chunked(text_bytes(batch.column("text"))[1], limit):
            yield batch.slice(lo, hi - lo)


class _Block:
    """The sets of a block of documents, and its distinct columns with their numbers of documents, in order and so by shard."""

    def __init__(self, table: pa.Table, n: int, bits: int, shards: int):
        data, offsets = text_bytes(table.column("text"))
        rows, grams = [], []
        for lo, hi in chunked(offsets):
            r, g = sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
            rows.append(r + lo)
            grams.append(g)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.sizes = np.bincount(self.rows, minlength=len(table))
        self.columns, self.which, self.counts = np.unique(self.grams >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        shard = (self.columns >> np.uint64(max(bits - 31, 0))).astype(np.uint64) * np.uint64(shards) >> np.uint64(min(bits, 31))
        at = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
        self.spans = {s: (a, b) for s, a, b in zip(shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shard)])}


def _bytes(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes(), 1)


def _from_bytes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, -1).T).view("<u2").ravel()


_COLUMNS = "shard int, block int, columns binary, counts binary"


def _send(table: pa.Table, n: int, bits: int, shards: int) -> pa.Table:
    block = _Block(table, n, bits, shards)
    number, spans = table.column("block")[0].as_py(), block.spans.values()
    counts = np.minimum(block.counts, MOST)
    return pa.table({
        "shard": pa.array(list(block.spans), pa.int32()), "block": pa.array([number] * len(spans), pa.int32()),
        "columns": pa.array([pack_sorted(block.columns[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([_bytes(counts[a:b]) for a, b in spans], pa.binary()),
    })


def _count(table: pa.Table) -> pa.Table:
    """For every block, the number of all documents with each column it sent to this shard, in its order; a sixteenth of the columns at a time."""
    buffers = [x.as_buffer() for c in table.column("columns").chunks for x in c]
    sizes = [len(x) // 8 for x in buffers]
    cuts = np.cumsum([0, *sizes])
    line, total = np.empty(cuts[-1], np.uint64), np.empty(cuts[-1], np.uint16)
    for a, b, raw, c in zip(cuts[:-1], cuts[1:], buffers, (x for k in table.column("counts").chunks for x in k)):
        line[a:b] = unpack_sorted(raw)
        total[a:b] = _from_bytes(c.as_buffer())
    part = (mix(line) >> np.uint64(60)).astype(np.uint8)
    for k in range(16):
        here = np.flatnonzero(part == k)
        _, which = np.unique(line[here], return_inverse=True)
        total[here] = np.minimum(np.bincount(which, weights=total[here]), MOST)[which]
    return pa.table({"shard": table.column("shard"), "block": table.column("block"), "counts": pa.array([_bytes(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def signatures(rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram): of each set, the rarest ones that any set linked with it must have one of; none if it is linked with no other.

    ``df`` has the number of documents with each n-gram, ``rows`` ascend.
    """
    shared = np.bincount(rows[df > 1], minlength=len(sizes))
    possible = (sizes > 0) & (100 * shared >= percent * sizes)
    keep = possible[rows]
    rows, grams, df = rows[keep], grams[keep], df[keep]
    order = np.lexsort((grams, df, rows))
    rows, grams, df = rows[order], grams[order], df[order]
    at = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = (at <= sizes[rows] * (100 - percent) // 100) & (df > 1)
    return rows[first], grams[first]


_PROFILE = "kind int, doc_id long, n long, k1 long, k2 long, shard int, keys binary, ids binary"


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (a, b), in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _profile(table: pa.Table, answers: pa.Table, n: int, percent: int, bits: int, shards: int, deal: int) -> pa.Table:
    """Of a block: a row (kind 0) per document; signatures with their least document (1); ties within the block (2)."""
    block = _Block(table, n, bits, shards)
    df = np.ones(len(block.columns), dtype=np.uint16)
    for s, raw in zip(answers.column("shard").to_pylist(), (x for k in answers.column("counts").chunks for x in k)):
        a, b = block.spans[s]
        df[a:b] = _from_bytes(raw.as_buffer())
    ids = table.column("doc_id").combine_chunks()
    known, number, size = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(), len(table)
    keys = []
    for salt in (_SALT[2], _SALT[3]):
        total = np.zeros(size, dtype=np.uint64)
        np.add.at(total, block.rows, mix(block.grams ^ salt))
        keys.append(total)
    rows, sig = signatures(block.rows, block.grams, block.sizes, df[block.which], percent)
    has = np.zeros(size, dtype=bool)
    has[rows] = True
    # of documents of one set only the first sends signatures; the others are tied to it
    some = np.flatnonzero(has & known)
    some = some[np.lexsort((number[some], keys[1][some], keys[0][some]))]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (keys[0][some[1:]] != keys[0][some[:-1]]) | (keys[1][some[1:]] != keys[1][some[:-1]])
    leader = number[some[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(some) else number[some]
    sends = np.zeros(size, dtype=bool)
    sends[some[new]] = True
    ok = sends[rows]
    doc, key = number[rows[ok]], sig[ok]
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    least = doc[at][np.cumsum(first) - 1] if len(at) else doc
    apart, copy = doc != least, number[some] != leader
    ties = _distinct(np.concatenate([doc[apart], number[some][copy]]), np.concatenate([least[apart], leader[copy]]))
    doc, key = doc[at], key[at]
    shard = (key >> np.uint64(33)) * np.uint64(deal) >> np.uint64(31)
    at = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1)).tolist()
    spans = list(zip(shard[at].tolist(), at, [*at[1:], len(shard)])) if at else []
    sent = [(1, s, pack_sorted(key[a:b]), np.ascontiguousarray(doc[a:b].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()) for s, a, b in spans]
    if len(ties[0]):
        sent.append((2, None, ties[0].astype("<i8").tobytes(), ties[1].astype("<i8").tobytes()))
    kinds, deals, firsts, others = zip(*sent) if sent else ((), (), (), ())
    none, blank = [None] * len(sent), [None] * size
    whole = lambda a, kind: pa.concat_arrays([a.cast(kind), pa.array(none, kind)])
    return pa.table({
        "kind": pa.array([0] * size + list(kinds), pa.int32()), "doc_id": whole(ids, pa.int64()), "n": whole(pa.array(block.sizes), pa.int64()),
        "k1": whole(pa.array(keys[0].view(np.int64)), pa.int64()), "k2": whole(pa.array(keys[1].view(np.int64)), pa.int64()),
        "shard": pa.array(blank + list(deals), pa.int32()), "keys": pa.array(blank + list(firsts), pa.binary()), "ids": pa.array(blank + list(others), pa.binary()),
    })


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _ties(batches):
    for batch in batches:
        for keys, ids in zip(batch.column("keys"), batch.column("ids")):
            yield from _pairs(np.frombuffer(keys.as_buffer(), "<i8"), np.frombuffer(ids.as_buffer(), "<i8")).to_batches()


def _unpacked(columns: pa.ChunkedArray, size: int, read) -> np.ndarray:
    """Numbers of all rows in one array, unpacked row by row."""
    out, at = np.empty(size, dtype=np.uint64), 0
    for chunk in columns.chunks:
        for x in chunk:
            part = read(x.as_buffer())
            out[at : at + len(part)] = part
            at += len(part)
    return out


def _shard(table: pa.Table) -> pa.Table:
    """Ties each block's least document of a signature to the least of all blocks; a sixteenth of the signatures is sorted at a time."""
    size = sum(len(x.as_buffer()) for c in table.column("keys").chunks for x in c) // 8
    keys = _unpacked(table.column("keys"), size, unpack_sorted)
    ids = _unpacked(table.column("ids"), size, lambda raw: np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()).view(np.int64)
    part, found = (mix(keys.copy()) >> np.uint64(60)).astype(np.uint8), []
    for k in range(16):
        here = np.flatnonzero(part == k)
        key, doc = keys[here], ids[here]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        some = doc != least
        found.append(_distinct(doc[some], least[some]))
    return _pairs(*_distinct(*map(np.concatenate, zip(*found))))


def _sets(batches, n: int):
    for batch in _sliced(batches, SLICE):
        data, offsets = text_bytes(batch.column("text"))
        raw = []
        for lo, hi in chunked(offsets):
            rows, grams = sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
            cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
            raw += [pack_sorted(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=[*batch.schema.names[:-1], "grams"])
        trim()


def overlaps(rows: np.ndarray, columns: np.ndarray, sizes: np.ndarray, percent: int, dense: int = 32):
    """Yield (row range, rows they may link with, overlap counts) of the product of an incidence matrix with its transpose.

    ``sizes`` ascend.  Only partners within the size bound are counted.
    """
    order = np.lexsort((rows, columns))
    rows, columns = rows[order], columns[order]
    new = np.ones(len(columns), dtype=bool)
    new[1:] = columns[1:] != columns[:-1]
    at = np.flatnonzero(new)
    df = np.diff(np.append(at, len(columns)))
    n = len(sizes)
    reach = np.searchsorted(sizes * percent, sizes * 100, side="right")  # the first row too large for each
    counts = np.zeros((n, n), dtype=np.float32)
    for d in np.unique(df[(df >= 2) & (df <= dense)]):
        lists = rows[at[df == d][:, None] + np.arange(d)]
        for i in range(d - 1):
            left = np.repeat(lists[:, i], d - 1 - i)
            right = lists[:, i + 1 :].ravel()
            ok = right < reach[left]
            np.add.at(counts.reshape(-1), left[ok] * n + right[ok], np.float32(1))
    common = np.flatnonzero(df > dense)
    for c in range(0, len(common), 2048):
        part = common[c : c + 2048]
        m = np.zeros((n, len(part)), dtype=np.float32)
        for k, col in enumerate(part):
            m[rows[at[col] : at[col] + df[col]], k] = 1
        for lo in range(0, n, 256):
            hi = min(n, lo + 256)
            end = int(reach[lo:hi].max())
            counts[lo:hi, lo:end] += m[lo:hi] @ m[lo:end].T
    return counts, reach


def _link(table: pa.Table, percent: int) -> pa.Table:
    """Links of one bin: for each row its least linked row here (or itself), and the documents it links with."""
    table = table.sort_by([("n", "ascending"), ("doc_id", "ascending")])
    doc, sizes, copies = (table.column(c).to_numpy() for c in ("doc_id", "n", "copies"))
    family, i, j, tile = (table.column(c).to_numpy() for c in ("family", "i", "j", "tile"))
    pair = np.unique(np.stack([family, i, j], axis=1), axis=0, return_inverse=True)[1].ravel()
    grams = [unpack_sorted(x.as_buffer()) for c in table.column("grams").chunks for x in c]
    rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    columns = mix(np.concatenate(grams) ^ mix(pair[rows].astype(np.uint64) + np.uint64(1)))  # a tile pair has its own columns
    counts, reach = overlaps(rows, columns, sizes, percent)
    label, degree = np.arange(len(doc)), np.zeros(len(doc), dtype=np.int64)
    found = []
    for lo in range(0, len(doc), 512):
        c = counts[lo : lo + 512].astype(np.int64)
        here = np.arange(lo, min(lo + 512, len(doc)))
        ok = (100 + percent) * c >= percent * (sizes[here][:, None] + sizes[None, :])
        ok &= np.arange(len(doc))[None, :] > here[:, None]
        ok &= (pair[here][:, None] == pair[None, :]) & ((i == j)[here][:, None] | (tile[here][:, None] != tile[None, :]))
        a, b = np.nonzero(ok)
        found.append((a + lo, b))
    a, b = (np.concatenate(x) for x in zip(*found))
    np.add.at(degree, a, copies[b])
    np.add.at(degree, b, copies[a])
    least = doc.copy()
    while True:  # least document reachable in this bin
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, least[a])
        if (least == before).all():
            break
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "least": pa.array(least, pa.int64()), "links": pa.array(degree, pa.int64())})


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, shard_bytes: int = 24 << 20) -> DataFrame:
    """One row per input row: doc_id, n_shingles, n_links, component_id.

    Two documents link when the Jaccard index of their sets of word ``n``-grams
    (A-Z as a-z) is at least ``percent`` / 100; n_links counts the other
    documents linked with this one, and component_id is the least id reachable
    by links.  A text of fewer words is one n-gram, its whole sequence; without
    words, or null, it is empty and linked with nothing.  Rows of a null id keep
    their count but take no part (component_id null, n_links 0).  Repeated rows
    of one id are one document.  Other columns are ignored.  ``block_bytes`` of
    text, a longer document excepted, and the n-grams of ``shard_bytes`` bound what
    a task of the blocking holds.
    """
    docs = id_text(docs, id_col, text_col)
    _, size = corpus_size(docs)
    shards = max(4, -(-size // shard_bytes))
    bits = min(64, max(32, size.bit_length() + 6))  # so that one column in 256 meets another by chance
    blocked, blocks = with_blocks(docs, block_bytes)
    blocked = blocked.repartition(blocks, "block")
    sent = blocked.groupBy("block").applyInArrow(lambda t: trim(_send(t, n, bits, shards)), _COLUMNS)
    answers = sent.groupBy("shard").applyInArrow(lambda t: trim(_count(t)), "shard int, block int, counts binary")
    profile = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: trim(_profile(t, a, n, percent, bits, shards, shards)), _PROFILE)
    profile = materialise(profile, "ngram-profile")
    rows = profile.where("kind = 0").select("doc_id", "n", "k1", "k2")
    ties = profile.where("kind = 2").select("keys", "ids").mapInArrow(_ties, "a long, b long")
    far = profile.where("kind = 1").select("shard", "keys", "ids").groupBy("shard").applyInArrow(lambda t: trim(_shard(t)), "a long, b long")
    family = connected_components(ties.unionByName(far), "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))

    members = materialise(rows.where("doc_id is not null and n > 0").distinct().join(family, "doc_id"), "ngram-members")
    # copies are tied to the least of their part, and those to the least of all, so no task gets all copies of a text
    same, parted = ["family", "n", "k1", "k2"], ["family", "n", "k1", "k2", "part"]
    members = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16 * shards)).cast("int"))
    parts = members.groupBy(*parted).agg(F.min("doc_id").alias("local"), F.countDistinct("doc_id").alias("copies"))
    classes = parts.groupBy(*same).agg(F.min("local").alias("first"), F.sum("copies").alias("copies"))
    parts = materialise(parts.join(classes.withColumnRenamed("copies", "all"), same), "ngram-parts")
    classes = materialise(classes, "ngram-classes")
    copies = members.join(parts.where("copies > 1").select(*parted, "local"), parted).where("doc_id != local").select("doc_id", F.col("local").alias("first"))
    copies = copies.unionByName(parts.where("local != first").select(F.col("local").alias("doc_id"), "first"))
    firsts = classes.select("family", "n", F.col("first").alias("doc_id"), "copies")

    by_size = firsts.groupBy("family", "n").agg(F.count("*").alias("here"))
    order = Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("before", F.coalesce(F.sum("here").over(order), F.lit(0)))
    total = firsts.groupBy("family").agg(F.count("*").alias("size")).where("size > 1")
    tiled = firsts.join(total, "family").join(by_size, ["family", "n"]).withColumn("tile", F.expr(f"cast(floor(before / {TILE}) + pmod(xxhash64(doc_id), cast(ceil(here / {TILE}) as long)) as long)"))
    tiles = tiled.groupBy("family", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    right = tiles.select("family", F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    # sizes must allow a link either way round
    paired = tiles.join(right, "family").where("tile <= j").where(f"100 * high >= {percent} * low_j and 100 * high_j >= {percent} * low").select("family", F.col("tile").alias("i"), "j")
    sides = paired.withColumn("tile", F.explode(F.array_distinct(F.array("i", "j"))))
    bins = max(1, -(-firsts.count() // TILE))
    placed = tiled.join(sides, ["family", "tile"]).withColumn("bin", F.when(F.col("size") <= TILE, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.xxhash64("family", "i", "j")))
    placed = placed.select("doc_id", "bin", "family", "i", "j", "tile", "n", "copies")
    wanted = placed.groupBy("doc_id").agg(F.collect_list(F.struct("bin", "family", "i", "j", "tile", "n", "copies")).alias("at"))
    grams = docs.join(wanted, "doc_id").select("doc_id", "at", "text").mapInArrow(lambda it: _sets(it, n), "doc_id long, at array<struct<bin:long,family:long,i:long,j:long,tile:long,n:long,copies:long>>, grams binary")
    grams = grams.select("doc_id", F.explode("at").alias("p"), "grams").select("doc_id", "p.*", "grams")
    linked = materialise(grams.groupBy("bin").applyInArrow(lambda t: trim(_link(t, percent)), "doc_id long, least long, links long"), "ngram-links")

    edges = linked.select("doc_id", F.col("least").alias("first")).unionByName(copies)
    component = connected_components(edges, "doc_id", "first").select(F.col("node").alias("doc_id"), "component")
    links = linked.groupBy("doc_id").agg(F.sum("links").alias("links"))
    per_part = parts.join(links.withColumnRenamed("doc_id", "first"), "first", "left").select(*parted, (F.coalesce("links", F.lit(0)) + F.col("all") - 1).alias("n_links"))
    n_links = members.join(per_part, parted).groupBy("doc_id").agg(F.max("n_links").alias("n_links"))
    out = rows.join(component, "doc_id", "left").join(n_links, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "doc_id").alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    joined = ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")
