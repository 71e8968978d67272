"""Keys, claims and records that mean the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions import lexical
from almagest.functions.expressions import arxiv, canonical_json, doi, package_name


def claim_slot(predicate: Column, roles: Column, qualifiers: Column) -> Column:
    """A key of predicate, sorted roles and sorted qualifiers; NULL for measurements."""
    key = F.sha2(F.concat_ws("|", predicate, canonical_json(roles), canonical_json(qualifiers)), 256)
    return F.when(predicate != "measured", key)


def claim_links(claims: DataFrame) -> DataFrame:
    """(source, target, relation): each work's first claim of a side tied to the first of another work.

    ``claims`` has slot, work, side ('+' or '-'), claim, day.  Per slot and side only
    the two earliest works can be the first of another work, so no pairs are made.
    """
    first = claims.where(F.col("slot").isNotNull()).groupBy("slot", "side", "work").agg(F.min(F.struct("day", "claim")).alias("s"))
    speakers = first.select("slot", "side", "work", F.col("s.day").alias("day"), F.col("s.claim").alias("claim"))
    order = Window.partitionBy("slot", "side").orderBy("day", "claim")
    heads = speakers.withColumn("k", F.row_number().over(order)).where("k <= 2").select("slot", F.col("side").alias("_side"), F.col("work").alias("_work"), F.col("day").alias("_day"), F.col("claim").alias("_claim"))
    other = speakers.join(heads, "slot").where("work <> _work and struct(_day, _claim) < struct(day, claim)")
    best = other.groupBy("slot", "work", "claim", "_side", "side").agg(F.min_by("_claim", F.struct("_day", "_claim")).alias("target"))
    return best.select(F.col("claim").alias("source"), "target", F.when(F.col("side") == F.col("_side"), "CORROBORATES").otherwise("CONTRADICTS").alias("relation"))


def new_claim_links(claims: DataFrame, new: DataFrame) -> DataFrame:
    """Links that start from claims of ``new`` (claim): only the slots they are in are read."""
    slots = claims.join(new, "claim", "left_semi").select("slot").distinct()
    links = claim_links(claims.join(slots, "slot", "left_semi"))
    return links.join(new.withColumnRenamed("claim", "source"), "source", "left_semi")


def judge_pairs(pairs: DataFrame, semantic: float = 0.97) -> DataFrame:
    """Adds action and reason to (left_label, right_label, cosine): held as a variant, merged by the labels or by cosine, else for review."""
    held, support = variant_reason("left_label", "right_label"), lexical_support("left_label", "right_label")
    rows = pairs.withColumn("_held", held).withColumn("_support", support)
    near = F.col("cosine") >= semantic
    action = F.when(F.col("_held").isNotNull(), "held").when(F.col("_support").isNotNull() | near, "merge").otherwise("review")
    reason = F.coalesce("_held", "_support", F.when(near, F.lit(f"cosine >= {semantic}")), F.lit("similar embedding only"))
    return rows.select(*pairs.columns, action.alias("action"), reason.alias("reason"))


def identifier_keys(scheme: Column, value: Column) -> Column:
    """Keys of one external identifier, by its scheme."""
    low = F.lower(F.trim(value))
    return (
        F.when(scheme == "doi", F.concat(F.lit("doi:"), doi(value)))
        .when(scheme == "arxiv", F.concat(F.lit("arxiv:"), arxiv(value)))
        .when(scheme == "pypi", F.concat(F.lit("pypi:"), package_name(value)))
        .when(scheme == "patent", F.concat(F.lit("patent:"), F.regexp_replace(low, "[^a-z0-9]", "")))
        .otherwise(F.concat(scheme, F.lit(":"), low))
    )


@F.pandas_udf(T.StringType())
def lexical_key(values: pd.Series) -> pd.Series:
    """One key for spellings of one name, its words in their order."""
    return values.map(lexical.lexical_key)


@F.pandas_udf(T.StringType())
def variant_reason(left: pd.Series, right: pd.Series) -> pd.Series:
    """Why two similar labels may mean different things, by the first rule that holds; NULL if none does."""
    return pd.Series([lexical.variant_reason(a, b) for a, b in zip(left, right)], dtype=object)


@F.pandas_udf(T.StringType())
def lexical_support(left: pd.Series, right: pd.Series) -> pd.Series:
    """How two labels themselves confirm that they mean one thing; NULL if they don't."""
    return pd.Series([lexical.lexical_support(a, b) for a, b in zip(left, right)], dtype=object)


def identity_key(name: Column, kind: Column, codes: Column) -> Column:
    """The key of a name of a concept: a country's code if it is one of the array ``codes``, else the lexical key."""
    code = F.upper(F.trim(name))
    return F.when((kind == "Country") & F.array_contains(codes, code), F.concat(F.lit("iso:"), code)).otherwise(lexical_key(name))


# Kinds of one identity family, and their rank in it.
KIND_FAMILIES = {"Technology": "technology", "Method": "technology", "Material": "technology", "Organization": "organization", "Company": "organization", "University": "organization"}
KIND_RANKS = {"Material": 1, "Method": 2, "Technology": 3, "Organization": 1, "University": 2, "Company": 3}


def _looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), key)


def kind_family(kind: Column) -> Column:
    """The family in which kinds are one identity; other kinds are their own."""
    return F.coalesce(_looked_up(KIND_FAMILIES, kind), kind)


def settled_kinds(votes: DataFrame, concept: str, kind: str, current: str, family: Column | None = None, rank: Column | None = None, voted: tuple[str, ...] = ("technology",)) -> DataFrame:
    """(concept, kind): in a ``voted`` family the kind with most votes, else the one of highest rank; ties go to the higher rank.

    ``votes`` has a row a vote (concept, kind) and the concept's ``current`` kind,
    which stays where no vote is of its family.  ``family`` and ``rank`` are
    expressions over the kind column, by default those of concept kinds.
    """
    c = F.col(kind)
    family_of = kind_family if family is None else lambda _: family
    rank = F.coalesce(_looked_up(KIND_RANKS, c), F.lit(0)) if rank is None else rank
    own = kind_family(F.col(current)) if family is None else F.col(current)
    counted = votes.withColumn("_family", family_of(c)).withColumn("_own", own).where(c.isNotNull()).groupBy(concept, current, kind, "_family", "_own").agg(F.count("*").alias("_n"), F.max(rank).alias("_rank"))
    weight = F.struct(F.when(F.col("_family").isin(*voted), F.col("_n")).otherwise(0).alias("n"), F.col("_rank").alias("rank"), c.alias("kind"))
    best = F.max(F.when(F.col("_family") == F.col("_own"), weight))
    return counted.groupBy(concept).agg(F.coalesce(best["kind"], F.first(current)).alias(kind))


def organization_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(r"\b(univ\w*|college|institute|école|hochschule)\b"), "university").when(low.rlike(r"\b(inc|ltd|llc|gmbh|corp|ag|s\.a)\b\.?"), "company").otherwise("organization")


def company_key(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(bare, r"\b(inc|ltd|llc|gmbh|corp|corporation|company|co|ag)\b", ""))


def resolve(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """(mention, concept, state): one concept of the key accepts, several are ambiguous, none founds a new one."""
    found = mentions.join(index, "key", "left").groupBy("mention", "key").agg(F.count("concept").alias("n"), F.min("concept").alias("concept"))
    state = F.when(F.col("n") == 1, "accepted").when(F.col("n") > 1, "ambiguous").otherwise("new")
    return found.select("mention", F.when(F.col("n") == 1, F.col("concept")).when(F.col("n") == 0, F.concat(F.lit("concept:"), F.left(F.sha2("key", 256), F.lit(24)))).alias("concept"), state.alias("state"))
