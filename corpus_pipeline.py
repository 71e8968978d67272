"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of the one before:
toxic documents go; of each group of near duplicates one document stays; passages
that an earlier document has are cut out; the rest is put in the order of a
mixture by source; and encoded by byte-level BPE.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.byte_bpe import digests
from almagest.llm.mixing import in_mixed_order
from almagest.llm.ngram_join import ngram_jaccard_join
from almagest.llm.substring_dedup import substring_dedup
from almagest.llm.toxicity import fit, score
from almagest.sources.runtime import delete, new_path, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model learns from the labelled ones of those given.

    Rows with a null or empty text have the intercept's score.  Repeated rows and
    rows without an id are scored like others.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, carry=COLUMNS[1:]).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one of least id.

    Rows without an id, and empty texts, which are linked with nothing, stay;
    repeated rows of one id stay or go together.
    """
    joined = ngram_jaccard_join(docs, n=5, percent=80)
    gone = joined.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 13 words that a document of smaller id has; a text that loses none is left as it is.

    A null id is the smallest; a null text stays null; rows of one id don't cut
    each other.  n_chars follows the text where that was cut.
    """
    kept = substring_dedup(docs, 13, carry=COLUMNS[1:])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: its ranges are the output's files, in order.

    A null source is a source.  Repeated rows of one id share a place.
    """
    return in_mixed_order(docs).select(*COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes; a null text counts as empty.

    Of rows read from files, ``place`` has the place in them (number of the file,
    then the row in it), so that of the mixture; else it is null.
    """
    place = F.lit(None)
    if docs.inputFiles():
        docs = docs.select("doc_id", "text", F.expr(r"cast(regexp_extract(_metadata.file_name, '^part-(\\d+)', 1) as long) * 1000000000000 + _metadata.row_index").alias("_place"))
        place = F.col("_place")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), place)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_each_group), ("substring_dedup", cut_repeats), ("source_mixing", mix), ("byte_bpe", encode)]

#: A classifier's and a tokenizer's results can't be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage has written on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        if name != STAGES[0][0]:
            delete(docs)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
