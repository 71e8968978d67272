"""Order MinHash fingerprints, with DataFrame functions only.

A text is the sequence of its k-mers (``k`` words each; the last ones end with
end marks, so that every text has one).  Equal k-mers are numbered by
occurrence.  For each of ``components`` orders the ``tuple_size`` least numbered
k-mers are taken, put back into text order and hashed as a tuple (of the k-mers
alone), so a component agrees only where both the content and its order agree.  The
share of equal components estimates how near two texts are in edits.

An order (i, c) is that of a hash of (k-mer, occurrence number, i), begun at point c
of the ring of hash values.  Hashes of different i are independent.  Orders of one i
take their k-mers from different arcs of the ring as long as a text has some for
each, and in a short text meet those of the other hashes: a text of six k-mers has
15 pairs, nearly all of which are drawn.  Everything is an array expression on one
row: no join, no explosion into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.common import id_text, with_blocks

#: Bits that hold a k-mer's place while equal ones are numbered; longer texts take the wide ones.
_PLACE, _WIDE_PLACE = (1 << 24) - 1, (1 << 31) - 1


def _kmers(words: Column, k: int) -> Column:
    return F.transform(words, lambda h, i: F.xxhash64(h, *(F.coalesce(F.get(words, i + F.lit(d)), F.lit(0).cast("long")) for d in range(1, k))))


def _key(x: Column, j: int) -> Column:
    return x.bitwiseAND(F.bitwise_not(F.col(f"_omh_m{j}")))


def _sorted_kmers(j: int) -> Column:
    """The high bits of the k-mers' hashes with the place in the low ones, ascending: copies lie together in their order."""
    return F.sort_array(F.transform(F.col(f"_omh_h{j}"), lambda x, i: _key(x, j).bitwiseOR(i.cast("long"))))


def _firsts(j: int) -> Column:
    """Where a run of copies begins."""
    s = F.col(f"_omh_s{j}")
    return F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (_key(x, j) != _key(F.get(s, i - 1), j)), i).otherwise(-1)), lambda i: i >= 0)


def _numbered(j: int) -> Column:
    """A hash of each k-mer and its occurrence number, in no certain order, with its place: array<struct<u, p>>.

    Copies are found by the high 40 bits of the k-mers' hashes (33 in texts of more than 2**24 words).
    """
    s, h, firsts, mask = F.col(f"_omh_s{j}"), F.col(f"_omh_h{j}"), F.col(f"_omh_r{j}"), F.col(f"_omh_m{j}")

    def numbered(x: Column, n: Column) -> Column:
        p = x.bitwiseAND(mask).cast("int")
        return F.struct(F.xxhash64(F.get(h, p), n).alias("u"), p.alias("p"))

    run = lambda at, r: F.slice(s, at + 1, F.coalesce(F.get(firsts, r + 1), F.size(s)) - at)
    several = F.flatten(F.transform(firsts, lambda at, r: F.transform(run(at, r), lambda x, n: numbered(x, n))))
    return F.when(F.size(firsts) == F.size(s), F.transform(s, lambda x: numbered(x, F.lit(0)))).otherwise(several)


def fingerprints(df: DataFrame, columns: dict[str, str], k: int = 2, tuple_size: int = 2, components: int = 64, hashes: int = 4) -> DataFrame:
    """Add, for each text column, an array<long> of ``components`` hashes, from ``hashes`` independent ones, under the name it maps to.

    Null text gives null; an empty text is one empty word.  The columns must be
    plain ones; names that begin with ``_omh`` are used on the way and must not occur.
    """
    if components % hashes or components < hashes:
        raise ValueError("components must be a multiple of hashes")
    kept, names = df.columns, list(enumerate(columns))
    every = lambda *letters: [f"_omh_{x}{j}" for x in letters for j, _ in names]
    df = df.select(*kept, *(F.transform(F.split(F.col(c), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)).alias(f"_omh_w{j}") for j, c in names))
    df = df.select(*kept, *(_kmers(F.col(f"_omh_w{j}"), k).alias(f"_omh_h{j}") for j, _ in names))
    place = lambda j: F.when(F.size(f"_omh_h{j}") > _PLACE, F.lit(_WIDE_PLACE)).otherwise(F.lit(_PLACE)).cast("long")
    df = df.select(*kept, *every("h"), *(place(j).alias(f"_omh_m{j}") for j, _ in names))
    df = df.select(*kept, *every("h", "m"), *(_sorted_kmers(j).alias(f"_omh_s{j}") for j, _ in names))
    df = df.select(*kept, *every("h", "m", "s"), *(_firsts(j).alias(f"_omh_r{j}") for j, _ in names))
    df = df.select(*kept, *every("h", "m"), *(_numbered(j).alias(f"_omh_n{j}") for j, _ in names))
    df = df.select(*kept, *every("h", "m"), *(F.col(f"_omh_n{j}")[x].alias(f"_omh_{x}{j}") for x in "up" for j, _ in names))
    # for each i, one step sorts the numbered k-mers with the points among them (a k-mer's number in the low bits, none in a
    # point's), the next finds the points, and the last reads the k-mers that follow each
    points = F.array(*(F.lit(-(1 << 63) + c * ((1 << 64) * hashes // components) & ~_WIDE_PLACE).cast("long") for c in range(components // hashes)))
    lines = [(j, i) for j, _ in names for i in range(hashes)]
    number = lambda x: x.bitwiseAND(F.lit(_WIDE_PLACE))
    key = lambda x, i, at: F.xxhash64(x, F.lit(i)).bitwiseAND(F.lit(~_WIDE_PLACE)).bitwiseOR(at.cast("long") + 1)
    line = lambda j, i: F.sort_array(F.concat(F.transform(F.col(f"_omh_u{j}"), lambda x, at: key(x, i, at)), points))
    found = lambda j, i: F.filter(F.transform(F.col(f"_omh_q{j}_{i}"), lambda x, at: F.when(number(x) == 0, at).otherwise(-1)), lambda at: at >= 0)
    df = df.select(*kept, *every("h", "p"), *(line(j, i).alias(f"_omh_q{j}_{i}") for j, i in lines))
    df = df.select("*", *(found(j, i).alias(f"_omh_c{j}_{i}") for j, i in lines))

    def around(j: int, i: int, at: Column) -> Column:
        """The numbers of the ``tuple_size`` k-mers (all if there are no more) that follow the point at ``at``, over the other points and round the ring."""
        q, n = F.col(f"_omh_q{j}_{i}"), F.size(f"_omh_q{j}_{i}")
        near = F.slice(q, at + 2, tuple_size)
        alone = (F.size(near) == tuple_size) & ~F.exists(near, lambda x: number(x) == 0)
        ring = F.concat(F.slice(q, at + 2, n), F.slice(q, 1, at))
        return F.when(alone, near).otherwise(F.slice(F.filter(ring, lambda x: number(x) != 0), 1, tuple_size))

    def component(j: int, i: int, at: Column) -> Column:
        places = F.sort_array(F.transform(around(j, i, at), lambda x: F.get(F.col(f"_omh_p{j}"), (number(x) - 1).cast("int"))))
        return F.xxhash64(F.transform(places, lambda p: F.get(F.col(f"_omh_h{j}"), p)))

    of_hash = lambda j, i: F.transform(F.col(f"_omh_c{j}_{i}"), lambda at: component(j, i, at))
    signature = lambda j: F.when(F.col(f"_omh_h{j}").isNotNull(), F.flatten(F.array(*(of_hash(j, i) for i in range(hashes)))))
    return df.select(*kept, *(signature(j).alias(columns[c]) for j, c in names))


def as_text(components: Column) -> Column:
    """Eight hexadecimal digits a component."""
    return F.array_join(F.transform(components, lambda c: F.lower(F.lpad(F.hex(c.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def with_next(docs: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, text, block, ghost, next_text): each document with the text of the one before it in doc_id, the first with that of the last.

    Documents are dealt out by ranges of doc_id.  The first document of each
    range, in descending order, is added as a ghost row at the end of the range
    above it, so the windows below need no partition larger than a range; ghost
    rows are kept for the caller to drop.  Null text counts as empty; null ids
    come last, rows of one id in the order of their text.
    """
    docs = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    base, blocks = with_blocks(docs, block_bytes)
    heads = sorted(map(tuple, base.groupBy("block").agg(F.max("doc_id")).collect()))  # one row a range, of which there is a bounded number
    above = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]  # the range that continues with this document
    targets = docs.sparkSession.createDataFrame(above, "head long, target int")
    ghosts = docs.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("doc_id", "target").agg(F.min("text").alias("text"))
    rows = base.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("doc_id", "text", F.col("target").alias("block"), F.lit(True).alias("ghost")))
    return rows.repartition(blocks, "block").withColumn("next_text", F.lead("text").over(_descending()))


def _descending():
    return Window.partitionBy("block").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")


def edited(text: Column, other: Column) -> Column:
    """The last third (rounded down) of the code points replaced by the first as many of ``other``."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(other, F.lit(1), k))


def fingerprint_documents(docs: DataFrame, k: int = 2, tuple_size: int = 2, components: int = 64) -> DataFrame:
    """Per document: n_chars, edited_sha256, its fingerprint, that of its edited text, and both likenesses.

    Null text counts as empty.  Null ids come last, rows of one id are ordered by
    their text, and repeated rows are each other's next document.  One document
    alone is its own next one; an empty table gives no rows.  Other columns are ignored.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = rows.select("doc_id", "block", "ghost", "text", "edited", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    rows = fingerprints(rows, {"text": "a", "edited": "b"}, k, tuple_size, components)
    rows = rows.withColumn("c", F.lead("a").over(_descending())).where(~F.col("ghost"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def op5_order_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
