"""Feature groups: (facts visible at snapshots) -> one row per technology and snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions.expressions import log_growth, months_before, ratio, window_sum, within
from almagest.sources.runtime import dealt, materialise, small, together
from almagest.sources.tables import mentions, snapshots, visible

KEY = ("technology", "snapshot")
T = F.col


def visible_view(spark, sf: str, dates) -> DataFrame:
    """Facts of the driver's tables known at each of ``dates``."""
    return visible(mentions(spark, sf), snapshots(spark, dates))


def dealt_facts(spark, sf: str, until) -> DataFrame:
    """Facts of the driver's tables up to a date, written once by technology: all groups of a technology are counted where its facts lie."""
    facts = mentions(spark, sf).drop("amount", "quantity").where(F.col("observed") <= until)
    return dealt(facts, "technology", "facts", by="document")


def documents(view: DataFrame) -> DataFrame:
    """One row per technology, snapshot and document with the day it became visible."""
    return view.groupBy(*KEY, "document").agg(F.min("observed").alias("first_visible"), F.count("*").alias("mentions"))


def activity(view: DataFrame) -> DataFrame:
    """Counts, age and yearly growth of the documents that mention a technology."""
    t, d = F.col("snapshot"), F.col("first_visible")
    return documents(view).groupBy(*KEY).agg(
        F.min(d).alias("first_seen"), F.datediff(t, F.min(d)).alias("age_days"),
        F.count("*").alias("document_count"), F.sum("mentions").alias("mention_count"),
        window_sum(d, months_before(t, 12), t).alias("documents_last_year"),
        log_growth(window_sum(d, months_before(t, 12), t), window_sum(d, months_before(t, 24), months_before(t, 12))).alias("publication_growth"),
    )


def dynamics(view: DataFrame) -> DataFrame:
    """Growth over four horizons, acceleration, burst, persistence, activity, silence."""
    t, d = F.col("snapshot"), F.col("observed")
    recent = lambda n: window_sum(d, months_before(t, n), t)
    before = lambda a, b: window_sum(d, months_before(t, b), months_before(t, a))
    quarters = [before(3 * q, 3 * q + 3) if q else recent(3) for q in range(7, -1, -1)]
    rises = sum((F.when(b > a, 1).otherwise(0) for a, b in zip(quarters, quarters[1:])), F.lit(0))
    expected = 3 * before(3, 24) / 21
    months = F.count_distinct(F.when(within(d, months_before(t, 24), t), F.floor(F.months_between(t, d))))
    age = F.floor(F.months_between(F.max(t), F.min(d)))
    return view.groupBy(*KEY).agg(
        *(log_growth(recent(n), before(n, 2 * n)).alias(f"mention_growth_{n}m") for n in (3, 6, 12, 24)),
        (log_growth(recent(6), before(6, 12)) - log_growth(before(6, 12), before(12, 18))).alias("growth_acceleration"),
        ((recent(3) - expected) / F.sqrt(expected + 1)).alias("burst_score"),
        (rises / 7).alias("growth_persistence"),
        (months / F.least(F.lit(24), age + 1)).alias("active_month_ratio"),
        F.datediff(t, F.max(d)).alias("days_since_last_signal"),
    )


def decline(view: DataFrame) -> DataFrame:
    """1 - last twelve months / the most in any twelve months that end a whole number of months before the snapshot.

    Rolling sums are largest where a window begins with an active month, so one
    range window over the active months finds the peak.
    """
    t = F.col("snapshot")
    monthly = view.withColumn("back", F.floor(F.months_between(t, F.col("observed"))).cast("int")).groupBy(*KEY, "back").agg(F.count("*").alias("n"))
    year = Window.partitionBy(*KEY).orderBy("back").rangeBetween(0, 11)
    rolled = monthly.withColumn("rolling", F.sum("n").over(year))
    last = F.coalesce(F.sum(F.when(F.col("back") < 12, F.col("n"))), F.lit(0))
    return rolled.groupBy(*KEY).agg((1 - last / F.max("rolling")).alias("decline_rate"))


def _spread(prefix: str, c: str = "c") -> list:
    """Aggregates over one row a value: distinct values, natural-log entropy, concentration (sum of squared shares) and top share."""
    n, total = F.col(c).cast("double"), F.sum(F.col(c).cast("double"))
    return [
        F.count(c).alias(f"{prefix}_count"), (F.log(total) - F.sum(n * F.log(n)) / total).alias(f"{prefix}_entropy"),
        (F.sum(n * n) / (total * total)).alias(f"{prefix}_hhi"), (F.max(n) / total).alias(f"top_{prefix}_share"),
    ]


def diversity(view: DataFrame, value: str, prefix: str, weight: str | None = None) -> DataFrame:
    """Distinct values, natural-log entropy, concentration (sum of squared shares) and top share."""
    counts = view.where(F.col(value).isNotNull()).groupBy(*KEY, value).agg((F.count("*") if weight is None else F.sum(weight)).cast("double").alias("c"))
    return counts.groupBy(*KEY).agg(*_spread(prefix))


def participants(view: DataFrame, countries: DataFrame) -> DataFrame:
    """Countries of the organizations, turnover of organizations, and the balance of organizations and users, in one chain of aggregates.

    ``countries`` is (organization, country).  Facts are counted by organization
    first, then by country, then by technology.
    """
    t, d = F.col("snapshot"), F.col("observed")
    recent, earlier = within(d, months_before(t, 12), t), d <= months_before(t, 12)
    members = view.groupBy(*KEY, "organization").agg(F.count("*").alias("n"), F.max(recent).alias("r"), F.max(earlier).alias("e"))
    by_country = members.join(small(countries), "organization", "left").groupBy(*KEY, "country").agg(
        F.sum("n").alias("n"), F.count("*").alias("o"), F.count_if("r").alias("r"), F.count_if("e").alias("e"), F.count_if(F.col("r") & F.col("e")).alias("both"),
    )
    known = by_country.withColumn("c", F.when(F.col("country").isNotNull(), F.col("n")))
    sums = known.groupBy(*KEY).agg(*_spread("country"), *(F.sum(c).alias(f"_{c}") for c in ("o", "r", "e", "both")))
    users = view.select(*KEY, "customer").distinct().groupBy(*KEY).agg(F.count("customer").alias("_u"))
    o, u, r, e, both = (F.col(f"_{c}") for c in ("o", "u", "r", "e", "both"))
    rates = [ratio(r - both, r).alias("new_organization_rate"), ratio(both, e).alias("returning_organization_rate"), ratio(o - u, o + u).alias("organization_user_balance")]
    return sums.join(users, list(KEY)).select(*KEY, "country_count", "country_entropy", "country_hhi", "top_country_share", *rates)


def turnover(view: DataFrame, value: str, prefix: str) -> DataFrame:
    """Share of last year's members not met before, and of earlier members met again."""
    t, d = F.col("snapshot"), F.col("observed")
    members = view.groupBy(*KEY, value).agg(F.max(within(d, months_before(t, 12), t)).alias("recent"), F.max(d <= months_before(t, 12)).alias("earlier"))
    count = lambda c: F.count_if(c)
    r, e = F.col("recent"), F.col("earlier")
    return members.groupBy(*KEY).agg(ratio(count(r & ~e), count(r)).alias(f"new_{prefix}_rate"), ratio(count(r & e), count(e)).alias(f"returning_{prefix}_rate"))


def convergence(view: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Diversity of sources and the days from the first document of the first kind to that of each other, counted by family first."""
    t, d = F.col("snapshot"), F.col("observed")
    families = view.groupBy(*KEY, "family").agg(F.count("*").alias("c"), F.max(within(d, months_before(t, 12), t)).alias("r"), *(F.min(F.when(F.col("kind") == k, d)).alias(f"_{k}") for k in kinds))
    first = {k: F.min(f"_{k}") for k in kinds}
    lags = [F.datediff(first[k], first[kinds[0]]).alias(f"{kinds[0]}_to_{k}_lag_days".lower()) for k in kinds[1:]]
    chain = sum((F.when(first[k] >= first[kinds[0]], 1).otherwise(0) for k in kinds), F.lit(0))
    known = F.col("family").isNotNull()
    out = families.withColumn("c", F.when(known, F.col("c"))).groupBy(*KEY).agg(*_spread("source"), F.count_if(known & F.col("r")).alias("recent_source_convergence"), *lags, chain.alias("evidence_chain_length"))
    names = [f"{kinds[0]}_to_{k}_lag_days".lower() for k in kinds[1:]]
    return out.select(*KEY, F.col("source_count").alias("source_type_diversity"), "recent_source_convergence", *names, "evidence_chain_length", "source_entropy")


def credibility(view: DataFrame, tier_max: float = 3.0) -> DataFrame:
    """Tier-weighted volume, shares of accepted, speculative and negated claims, gaps."""
    n = F.count("*")
    return view.groupBy(*KEY).agg(
        (F.sum("tier") / tier_max).alias("reliability_weighted_mentions"),
        ratio(F.count_if(F.col("status") == "F"), n).alias("accepted_mention_ratio"),
        ratio(F.count_if(F.col("kind") == "N"), n).alias("speculative_claim_ratio"),
        ratio(F.count_if(F.col("kind") == "R"), n).alias("negated_claim_ratio"),
        F.count_distinct("document").alias("independent_evidence_family_count"),
        (F.log1p(n) - F.log1p(F.count_distinct("document"))).alias("claim_to_evidence_gap"),
        F.avg("confidence").alias("mean_extraction_confidence"),
    )


def claim_slots(view: DataFrame) -> DataFrame:
    """Slot -> source -> polarities: corroborated and mixed slots, strongest conflict, share refuted.

    A source counts for a slot's positive side, its negative side, or both.
    """
    sides = view.groupBy(*KEY, "organization", "document").agg(F.max(F.col("kind") != "R").alias("pos"), F.max(F.col("kind") == "R").alias("neg"))
    slots = sides.groupBy(*KEY, "organization").agg(F.count_if("pos").alias("p"), F.count_if("neg").alias("n"), F.count_if(F.col("pos") & F.col("neg")).alias("mixed"))
    return slots.groupBy(*KEY).agg(
        F.count("*").alias("comparable_claim_slot_count"), F.count_if(F.col("p") >= 2).alias("corroborated_claim_slot_count"),
        F.sum("mixed").alias("mixed_origin_group_count"), F.max(2 * F.least("p", "n") / (F.col("p") + F.col("n"))).alias("independent_claim_conflict_strength"),
        ratio(F.sum("n"), F.sum(F.col("p") + F.col("n"))).alias("independent_refutation_share"),
    )


def maturity(view: DataFrame) -> DataFrame:
    """Highest stage now and a year before (none counts 0), first days of stages, concentration of the last."""
    t, d, rank = F.col("snapshot"), F.col("observed"), F.col("stage")
    top, before = F.max(rank), F.max(F.when(d <= months_before(t, 12), rank))
    return view.groupBy(*KEY).agg(
        top.alias("max_maturity_rank"), (top - F.coalesce(before, F.lit(0))).alias("maturity_growth"),
        F.datediff(F.min(F.when(rank >= 4, d)), F.min(d)).alias("time_to_pilot_days"),
        F.datediff(t, F.min(F.when(rank >= 3, d))).alias("time_in_prototype_stage_days"),
        F.count_if(rank >= 6).alias("implementation_count"),
    )


def quality(view: DataFrame) -> DataFrame:
    """Shares of provisional resolutions and of documents with their full record."""
    docs = view.groupBy(*KEY, "document").agg(F.max(F.col("recorded") <= F.col("snapshot")).alias("full"))
    shares = docs.groupBy(*KEY).agg(F.avg(F.col("full").cast("double")).alias("fulltext_coverage"))
    own = view.groupBy(*KEY).agg(F.avg((F.col("status") == "O").cast("double")).alias("provisional_resolution_ratio"))
    return shares.join(own, list(KEY))


def relations(view: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Distinct targets of each relation type, as columns."""
    return view.groupBy(*KEY).pivot("kind", list(types)).agg(F.count_distinct("organization")).na.fill(0)


def new_relations(view: DataFrame, edge: tuple[str, ...] = ("organization", "kind"), months: int = 12) -> DataFrame:
    """(technology, snapshot, new_relation_count): distinct relations that were not known ``months`` before."""
    first = view.groupBy(*KEY, *edge).agg(F.min("observed").alias("_d"))
    return first.where(F.col("_d") > months_before(F.col("snapshot"), months)).groupBy(*KEY).agg(F.count("*").alias("new_relation_count"))


def midrank(df: DataFrame, columns: list[str], by: str = "snapshot") -> DataFrame:
    """(rows below + half of the equal ones) / rows, among rows of a snapshot that have a value.

    Values are counted first, so windows run over distinct values, not rows; the
    input is written once and read for each column.  Rows are not shuffled where the
    distinct values are few enough to be broadcast.
    """
    with together(df.sparkSession):
        df = materialise(df, "midrank")
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(by, c).agg(F.count("*").alias("_n"))
        order, whole = Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by)
        share = (F.coalesce(F.sum("_n").over(order), F.lit(0)) + 0.5 * F.col("_n")) / F.sum("_n").over(whole)
        df = df.join(small(counts.select(by, c, share.alias(f"{c}_snapshot_pct"))), [by, c], "left")
    return df


def deltas(df: DataFrame, columns: list[str], months: int = 12) -> DataFrame:
    """Each column minus its value ``months`` earlier; no earlier row counts 0.  The grid may be uneven, so a join, not a lag; the input is written once."""
    df = materialise(df.select(*KEY, *columns), "deltas")
    prior = df.select("technology", F.add_months("snapshot", months).alias("snapshot"), *(F.col(c).alias(f"_{c}") for c in columns))
    return df.join(prior, list(KEY), "left").select(*KEY, *((F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(f"{c}_delta_{months}m") for c in columns))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in columns), F.lit(0))
    return df.withColumn("feature_missingness_count", absent).withColumn("data_completeness_score", 1 - absent / len(columns))


def covered(grid: DataFrame, crawls: DataFrame, months: int) -> DataFrame:
    """Families whose finished, exhaustive searches cover the whole period before a snapshot and were known by then."""
    start = months_before(F.col("snapshot"), months)
    ok = (F.col("finished") <= F.col("snapshot")) & (F.col("period_start") <= start) & (F.col("period_end") >= F.col("snapshot")) & F.col("exhaustive") & (F.col("state") == "done")
    return grid.join(F.broadcast(crawls), ok).select("snapshot", "family").distinct()


def outcomes(facts: DataFrame, grid: DataFrame, months: int, end) -> DataFrame:
    """What came after each snapshot, within the horizon: new documents and sources, and first of each kind."""
    t, d = F.col("snapshot"), F.col("observed")
    horizon = F.add_months(t, months)
    rows = facts.join(small(grid), d <= horizon)
    seen = rows.groupBy(*KEY).agg(
        F.count_if(d <= t).alias("known"), F.count_distinct(F.when(within(d, t, horizon), F.col("document"))).alias("future_documents"),
        F.count_distinct(F.when(within(d, t, horizon), F.col("organization"))).alias("future_sources"),
        F.count_if((F.col("kind") == "A") & (d <= t)).alias("commercial_before"),
        F.min(F.when((F.col("kind") == "A") & within(d, t, horizon), d)).alias("first_commercial"),
    ).where("known > 0")
    closed = F.add_months("snapshot", months) <= F.lit(end).cast("date")
    label = (
        F.when(F.col("commercial_before") > 0, F.lit(None).cast("int")).when(~closed, F.lit(None).cast("int"))
        .when(F.col("first_commercial").isNotNull(), 1).otherwise(0)
    )
    reason = F.when(F.col("commercial_before") > 0, "already_commercial").when(~closed, "censored").when(F.col("first_commercial").isNotNull(), "realized").otherwise("not_realized")
    return seen.select(*KEY, "future_documents", "future_sources", label.alias("label_realized"), reason.alias("label_reason"))
