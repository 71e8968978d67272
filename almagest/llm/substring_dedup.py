"""Substring deduplication with prefix-partitioned suffix trees over words.

Every word position starts a suffix.  Suffixes are dealt to groups by a prefix
of *variable length*: one word, and one word more wherever the prefix so far
still has more suffixes than a group may hold.  A group is the subtree below
its prefixes; only nodes at the depth ``min_words`` decide, so the subtree is
kept truncated there, as its sorted leaves: a run of equal leaves is an internal
node of that depth, a repeat.  Repeats that overlap in a text are joined, which
gives the maximal repeated spans.

The suffixes never travel as text.  Documents are cut into blocks of ascending
doc_id; a block sends each group its distinct leaves once, whatever their number
of occurrences, and the group answers with one bit a leaf: whether a block of
smaller doc_ids has it too.  So a passage that a third of all documents share
costs one leaf a block.  A leaf is 96 bits: 64 of one hash of its words, by which
leaves are sorted and difference-coded, and 32 of another.  Among the 1.6e13 runs
of 100 TB of text the expected number of different runs with equal leaves is
0.002; no other look at the words is taken.

A block sends a row a group that it has leaves for, so there are at most as many
rows as leaves; ``block_bytes`` and ``group_words`` should grow with the memory
of an executor, which makes rows fewer and longer.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.common import chunked, corpus_size, mix, pack_sorted, text_bytes, trim, unpack_sorted, windows, with_blocks, word_hashes, words

_NEXT = np.uint64(0xD6E8FEB86659FD93)
#: A prefix that starts fewer than this share of all suffixes is never extended, so the plan has at most so many a depth; leaves of an unextended prefix are dealt on by their own hash.
LEAST_SHARE = 1 / 65536


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(prefix * _NEXT + word)


def _heavy_prefixes(batches, min_words: int, share: float):
    """For each batch of texts, the prefixes (of 1 to min_words words) that start at least ``share`` of its suffixes.

    A prefix with that share of all suffixes has it in some batch, so none is missed.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        depths, keys, counts = [], [], []
        for lo, hi in chunked(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, rows = words(part, offsets[lo : hi + 1] - offsets[lo])
            hashes = word_hashes(part, starts, ends)
            _, first = windows(hashes, rows, min_words)
            prefix = hashes[first]
            for depth in range(1, min_words + 1):
                if len(prefix) <= share * len(hashes):
                    break
                found, back, n = np.unique(prefix, return_inverse=True, return_counts=True)
                heavy = n >= share * len(hashes)
                depths += [depth] * int(heavy.sum())
                keys.append(found[heavy])
                counts.append(n[heavy])
                if depth < min_words:
                    stay = heavy[back]
                    first = first[stay]
                    prefix = _extended(prefix[stay], hashes[first + depth])
        if keys:
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([pa.array(depths, pa.int32()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["depth", "prefix", "n"])


def prefix_plan(docs: DataFrame, min_words: int, capacity: int, n_words: int) -> list[np.ndarray]:
    """For each depth, the sorted prefixes with more than ``capacity`` suffixes, or ``LEAST_SHARE`` of all if that is more: at most 1 / LEAST_SHARE a depth, twice as many by chance."""
    share = max(capacity / max(n_words, 1), LEAST_SHARE)
    if share >= 1:
        return []
    found = (
        docs.select("text").mapInArrow(lambda it: _heavy_prefixes(it, min_words, share), "depth int, prefix long, n long")
        .groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= share * n_words / 2).select("depth", "prefix").toPandas()
    )
    return [np.sort(found.loc[found.depth == d, "prefix"].to_numpy(np.int64).view(np.uint64)) for d in range(1, min_words)]


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def _starts(group: np.ndarray, leaf: np.ndarray, other: np.ndarray, apart: bool = False) -> np.ndarray | None:
    """Where a run of equal leaves begins; None if the second hash differs within a run of equal first ones and they may lie mixed."""
    new, differs = np.ones(len(leaf), dtype=bool), other[1:] != other[:-1]
    new[1:] = (leaf[1:] != leaf[:-1]) | (group[1:] != group[:-1])
    if apart:
        new[1:] |= differs
    elif (differs & ~new[1:]).any():
        return None
    return new


class _Block:
    """The leaves of one block of documents, in (group, hash) order."""

    def __init__(self, table: pa.Table, min_words: int, plan: list[np.ndarray], groups: int, deal: int):
        ids = pc.fill_null(table.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).min)
        table = table.append_column("order", ids).sort_by([("order", "ascending")])
        self.table = table
        self.data, self.offsets = text_bytes(table.column("text"))
        ids = table.column("order").to_numpy()
        small = np.int32 if len(self.data) < 1 << 31 else np.int64  # of places and numbers of leaves
        self.rank = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]), dtype=small) if len(ids) else np.zeros(0, small)
        rows, leaves, others, places, dealt, seen = [], [], [], [], [], 0
        for lo, hi in chunked(self.offsets):
            part = self.data[self.offsets[lo] : self.offsets[hi]]
            starts, ends, row = words(part, self.offsets[lo : hi + 1] - self.offsets[lo])
            hashes = word_hashes(part, starts, ends)
            leaf, first = windows(hashes, row, min_words)
            other, _ = windows(word_hashes(part, starts, ends, salt=1), row, min_words)
            prefix = hashes[first]
            todo, at = np.arange(len(first)), prefix
            for depth, heavy in enumerate(plan, 1):
                if not len(heavy) or not len(todo):
                    break
                todo = todo[_member(heavy, at)]
                at = _extended(prefix[todo], hashes[first[todo] + depth])
                prefix[todo] = at
            rows.append((row + lo).astype(small))
            leaves.append(leaf)
            others.append((other >> np.uint64(32)).astype(np.uint32))
            places.append((first + seen).astype(small))
            if deal > 1:
                prefix = prefix * _NEXT + other % np.uint64(deal)
            dealt.append((mix(prefix) % np.uint64(groups)).astype(np.int32))
            seen += len(starts)

        def flat(parts, kind):  # the parts go as soon as they are joined
            out = np.concatenate(parts) if parts else np.zeros(0, kind)
            parts.clear()
            return out

        self.rows, leaf, group = flat(rows, small), flat(leaves, np.uint64), flat(dealt, np.int32)
        order = np.argsort(leaf).astype(small)
        order = order[np.argsort(group[order].astype(np.int16 if groups < 1 << 15 else np.int32), kind="stable")]
        leaf, group, other = leaf[order], group[order], flat(others, np.uint32)[order]
        self.place = flat(places, small)[order]
        del order
        new = _starts(group, leaf, other)
        if new is None:  # unequal runs of one 64-bit hash: they must lie apart
            order = np.lexsort((other, leaf, group))
            self.place, leaf, other, group = self.place[order], leaf[order], other[order], group[order]
            new = _starts(group, leaf, other, apart=True)
        self.at = np.flatnonzero(new).astype(small)
        self.which = np.cumsum(new, dtype=small)
        self.which -= 1
        self.leaf, self.other, self.group = leaf[self.at], other[self.at], group[self.at]
        self.full = self.group[np.flatnonzero(np.diff(self.group, prepend=-1))]  # the groups that have leaves
        self.cuts = np.append(np.searchsorted(self.group, self.full), len(self.group))

    def removed(self, elsewhere: np.ndarray, min_words: int) -> np.ndarray:
        """For each word, whether a window over it starts in a document of smaller doc_id too."""
        rank = self.rank[self.rows[self.place]] if len(self.place) else self.place
        least = np.minimum.reduceat(rank, self.at) if len(self.at) else rank
        hit = self.place[elsewhere[self.which] | (rank > least[self.which])] if len(rank) else self.place
        edges, hit, one = np.zeros(len(self.rows) + 1, dtype=hit.dtype), hit.astype(np.int64), hit.dtype.type(1)  # of one type, or adding is slow
        np.add.at(edges, hit, one)
        np.add.at(edges, hit + min_words, -one)
        return np.cumsum(edges, dtype=edges.dtype)[:-1] > 0


def _send(table: pa.Table, min_words: int, plan, groups: int, deal: int) -> pa.Table:
    block = _Block(table, min_words, plan, groups, deal)
    spans = list(zip(block.cuts[:-1].tolist(), block.cuts[1:].tolist()))
    return pa.table({
        "grp": pa.array(block.full, pa.int32()), "block": pa.array(np.full(len(spans), table.column("block")[0].as_py()), pa.int32()),
        "leaves": pa.array([pack_sorted(block.leaf[a:b]) for a, b in spans], pa.binary()), "others": pa.array([block.other[a:b].tobytes() for a, b in spans], pa.binary()),
    })


def _subtree(table: pa.Table) -> pa.Table:
    """Leaves of one group from all blocks: which ones hang below an inner node that a smaller block shares."""
    table = table.sort_by([("block", "ascending")])
    parts = [unpack_sorted(x.as_buffer()) for c in table.column("leaves").chunks for x in c]
    leaves = np.concatenate(parts)
    others = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for c in table.column("others").chunks for x in c])
    order = np.argsort(leaves, kind="stable")  # runs that are sorted already
    equal = leaves[order[1:]] == leaves[order[:-1]]
    if (equal & (others[order[1:]] != others[order[:-1]])).any():
        order = np.lexsort((others, leaves))
        equal = (leaves[order[1:]] == leaves[order[:-1]]) & (others[order[1:]] == others[order[:-1]])
    shared = np.zeros(len(leaves), dtype=bool)
    shared[order[1:]] = equal
    cuts = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"block": table.column("block").cast(pa.int32()), "grp": table.column("grp").cast(pa.int32()), "bits": pa.array(bits, pa.binary())})


def _remove(table: pa.Table, answers: pa.Table, min_words: int, plan, groups: int, deal: int, text: bool = False) -> pa.Table:
    block = _Block(table, min_words, plan, groups, deal)
    elsewhere = np.zeros(len(block.leaf), dtype=bool)
    for g, bits in zip(np.searchsorted(block.full, answers.column("grp").to_numpy()).tolist(), answers.column("bits").to_pylist()):
        lo, hi = block.cuts[g], block.cuts[g + 1]
        elsewhere[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
    del block.leaf, block.other, block.group  # only what they decide is needed from here
    gone = block.removed(elsewhere, min_words)
    del block.place, block.at, block.which
    cuts = np.searchsorted(block.rows, np.arange(len(table) + 1))
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[cuts[1:]] - removed[cuts[:-1]]
    kept, spans = [], []
    for i in range(len(table)):
        found = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
        if removed[i]:
            out = gone[cuts[i] : cuts[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])])
            found = compress(found, (~out).tolist())
        else:
            spans.append([])
        kept.append(b" ".join(found))
    return pa.table({
        "doc_id": block.table.column("doc_id").cast(pa.int64()),
        "rest": block.table.column("rest"),
        **({"text": block.table.column("text")} if text else {}),
        "n_words": pa.array(np.diff(cuts), pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    })


def substring_dedup(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), block_bytes: int = 8 << 20, group_words: int = 2_000_000) -> DataFrame:
    """Drop each word inside a run of ``min_words`` words that a document of smaller id has too.

    Returns one row per input row: doc_id, n_words, n_removed, kept (the words
    left, joined by one space) and spans (removed runs, as first and last word).
    Runs are judged on the input.  Null text counts as empty: zero words, empty
    ``kept``.  A null id is smaller than any other.  Rows of one id don't remove
    each other's words, so repeated rows get equal results.  The columns named in
    ``carry`` come back unchanged after these; others are ignored.  ``block_bytes``
    of text, on average, and ``group_words`` suffixes bound what one task holds,
    but for a longer single document; rows of one id are in one block.
    """
    once = [c == text_col and docs.schema[c].dataType == T.StringType() for c in carry]  # a carried text is the one that is judged, and does not travel twice
    rest = F.struct(F.lit(True).alias("row"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry) if not once[i]))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    _, size = corpus_size(docs)
    n_words = size // 6  # only sizes groups
    groups = max(4, -(-n_words // group_words))
    capacity = max(1000, n_words // (4 * groups))
    plan, deal = prefix_plan(docs, min_words, capacity, n_words), -(-int(n_words * LEAST_SHARE) // capacity)
    blocked, blocks = with_blocks(docs, block_bytes)
    blocked = blocked.repartition(blocks, "block")
    leaves = blocked.groupBy("block").applyInArrow(lambda t: trim(_send(t, min_words, plan, groups, deal)), "grp int, block int, leaves binary, others binary")
    answers = leaves.groupBy("grp").applyInArrow(lambda t: trim(_subtree(t)), "block int, grp int, bits binary")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), docs.schema["rest"], *[T.StructField("text", T.StringType())] * any(once), *T.StructType.fromDDL("n_words long, n_removed long, kept string, spans array<struct<first:int,last:int>>").fields])
    out = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: trim(_remove(t, a, min_words, plan, groups, deal, any(once))), schema)
    return out.select("doc_id", "n_words", "n_removed", "kept", "spans", *(F.col("text" if once[i] else f"rest.c{i}").alias(c) for i, c in enumerate(carry)))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
