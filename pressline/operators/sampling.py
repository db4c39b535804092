"""Reproducible samples. Random order is the hex digest of id and seed.

Quotas are small constants, so the per-group limit is applied before the
shuffle (window group limit); spacing is decided set-wise, not by a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.columns import bucket_of, count_where, seeded_key, strict_bool, truth
from ..session import stage
from . import keys

# Fixed value: name of the machine annotator in the data set.
MACHINE = "codex_ai_review"


def seeded_top(df: DataFrame, strata: Sequence[str], n: int, seed: int, name: str = "pick") -> DataFrame:
    """First ``n`` rows per stratum in seeded order, numbered from 1."""
    w = Window.partitionBy(*strata).orderBy(seeded_key("candidate_id", seed), "candidate_id")
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def priority(machine: str = MACHINE) -> Column:
    """Low confidence, uncertain, or labelled by the machine annotator."""
    return truth(F.col("annotation_confidence") == 1) | truth(F.col("is_gegenpressing") == -1) | truth(F.col("annotator") == machine)


def priority_cohort(annotations: DataFrame) -> DataFrame:
    return annotations.where(priority())


def stratified_controls(annotations: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    rest = annotations.where(~priority() & F.col("is_gegenpressing").isNotNull())
    return seeded_top(rest, ["match_id", "is_gegenpressing"], n, seed)


def review_cohorts(annotations: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Priority rows and stratified controls with the original label."""
    cols = ["candidate_id", "match_id", F.col("is_gegenpressing").alias("label_asal")]
    first = priority_cohort(annotations).select(*cols, F.lit("prioritas").alias("kelompok"))
    return first.unionByName(stratified_controls(annotations, n, seed).select(*cols, F.lit("sampel").alias("kelompok")))


def trial_sample(manifest: DataFrame, n: int = 6, seed: int = 42) -> DataFrame:
    return seeded_top(manifest, ["match_id", "gegenpressing_label"], n, seed)


def seeded_shuffle(df: DataFrame, seed: int = 42) -> DataFrame:
    """Presentation order: a reproducible permutation, numbered from 1."""
    keyed = df.withColumn("_digest", seeded_key("candidate_id", seed))
    return ordered.row_numbers(
        keyed, [], ["_digest", "candidate_id"], ordered.digest_slices("_digest"), "presentation_order"
    ).drop("_digest")


def spaced_rows(df: DataFrame, spacing_us: int, seed: int) -> DataFrame:
    """The rows that picking in the order of digests keeps, each at least ``spacing`` from those picked before.

    A round picks every row whose digest is the least within the spacing on both
    sides and drops the rows near a pick; rounds repeat until no row is open.
    Their number grows with the logarithm of the densest stretch.
    """
    picked, rest = None, stage(df, "open-rows")
    while not rest.isEmpty():
        now = stage(_least_rows(rest, spacing_us, seed), "spaced-rows")
        picked = now if picked is None else picked.unionByName(now)
        spots = now.select("match_id", "period_id", F.col("loss_t_us").alias("_t"))
        spots = spots.withColumn("_bucket", F.explode(F.array(*[bucket_of("_t", spacing_us) + d for d in (-1, 0, 1)])))
        open_rows = rest.withColumn("_bucket", bucket_of("loss_t_us", spacing_us)).alias("o")
        near = F.abs(F.col("o.loss_t_us") - F.col("s._t")) < spacing_us
        same = [F.col(f"o.{c}") == F.col(f"s.{c}") for c in ("match_id", "period_id", "_bucket")]
        rest = stage(open_rows.join(spots.alias("s"), [*same, near], "left_anti").drop("_bucket"), "open-rows")
    return df.limit(0) if picked is None else picked


def _least_rows(df: DataFrame, spacing_us: int, seed: int) -> DataFrame:
    """Rows whose digest is the smallest within ``spacing`` on both sides.

    Any two of them in a period are then at least ``spacing`` apart. Rows of
    one bucket (one spacing wide) all rival each other, so only the bucket's
    least digest can stay; it falls if a neighbour bucket holds a nearer rival.
    """
    place = ["match_id", "period_id", "_bucket"]
    keyed = df.withColumns(
        {
            "_digest": F.concat(seeded_key("candidate_id", seed), F.col("candidate_id")),
            "_bucket": bucket_of("loss_t_us", spacing_us),
        }
    )
    least = keyed.groupBy(*place).agg(F.min_by(F.struct(*df.columns), "_digest").alias("_row"), F.min("_digest").alias("_digest"))
    rivals = keyed.select(
        "match_id",
        "period_id",
        F.explode(F.array(F.col("_bucket") - 1, F.col("_bucket") + 1)).alias("_bucket"),
        F.col("loss_t_us").alias("_t"),
        F.col("_digest").alias("_d"),
    )
    m = least.alias("m")
    r = rivals.alias("r")
    near = F.abs(F.col("m._row.loss_t_us") - F.col("r._t")) < spacing_us
    same = [F.col(f"m.{c}") == F.col(f"r.{c}") for c in place]
    kept = m.join(r, [*same, near & (F.col("r._d") < F.col("m._digest"))], "left_anti")
    return kept.select("_row.*")


def spaced_sample(candidates: DataFrame, per_match: int, spacing_us: int, seed: int = 42, require_both: bool = True) -> DataFrame:
    """Per match the same number of both outcomes, never closer than the spacing.

    Only strict-valid rows count where that is known. The quota per outcome is
    half of ``per_match`` or the rarer outcome's count among spaced rows. An odd
    ``per_match`` is an error, and so is a match without one of the outcomes;
    without ``require_both`` such a match has the quota 0 instead.
    """
    if per_match % 2:
        raise ValueError("per_match must be even, so that outcomes can be balanced")
    half = per_match // 2
    if "strict_valid" in candidates.columns:
        candidates = candidates.where(strict_bool("strict_valid"))
    outcomes = candidates.groupBy("match_id").agg(F.min("label_regain_5s").alias("_low"), F.max("label_regain_5s").alias("_high"))
    both = F.when((F.col("_low") == 0) & (F.col("_high") == 1), F.col("match_id")).otherwise(
        F.raise_error(F.concat(F.lit("match without both outcomes: "), F.col("match_id")))
    )
    sampled = candidates.join(outcomes.select(both.alias("match_id")), "match_id") if require_both else candidates
    picked = seeded_top(
        spaced_rows(sampled.select(*candidates.columns), spacing_us, seed), ["match_id", "label_regain_5s"], half, seed, "outcome_rank"
    )
    # At most 2 * half rows per match reach this point.
    per = Window.partitionBy("match_id")
    quota = F.least(
        count_where(F.col("label_regain_5s") == 0).over(per), count_where(F.col("label_regain_5s") == 1).over(per)
    )
    return picked.withColumn("sample_target_per_outcome", quota).where(
        F.col("outcome_rank") <= F.col("sample_target_per_outcome")
    )


def pilot_selection(queue: DataFrame, target: int = 28, seed: int = 42) -> DataFrame:
    """Pilot of ``target`` rows: completed rows stay, the rest is spread over matches.

    Open slots go to the matches without completed rows (all matches if there
    are none), as evenly as possible in match order; half of all picks are
    positive, odd quotas take the extra positive first. A quota that can not be
    met, or outcomes that can not be balanced, are errors. A queue that holds a
    pilot already is returned with that pilot.
    """
    if {"pilot_selected", "pilot_order"} <= set(queue.columns):
        chosen = queue.where(strict_bool("pilot_selected"))
        if not chosen.isEmpty():
            return chosen
        queue = queue.drop("pilot_selected", "pilot_order")
    done = F.col("is_gegenpressing").isNotNull()
    completed = queue.where(done)
    totals = completed.agg(
        F.count(F.lit(1)).alias("_done"), count_where(F.col("quick_regain_success") == 1).alias("_done_pos")
    )
    matches = queue.groupBy("match_id").agg(
        F.max(done.cast("int")).alias("_has_done"),
        count_where(~done & (F.col("quick_regain_success") == 1)).alias("_pool_1"),
        count_where(~done & (F.col("quick_regain_success") == 0)).alias("_pool_0"),
    )
    free = matches.where(F.col("_has_done") == 0)
    n_free = free.agg(F.count(F.lit(1)).alias("_n_free"))
    n_all = matches.agg(F.count(F.lit(1)).alias("_n_all"))
    joined = ordered.with_scalars(matches, keys.one_row(totals, n_free, n_all))
    joined = joined.where((F.col("_has_done") == 0) | (F.col("_n_free") == 0))
    slots = F.when(F.col("_done") <= target, F.lit(target) - F.col("_done")).otherwise(
        F.raise_error(F.lit("more completed rows than the pilot holds"))
    )
    n = F.when(F.col("_n_free") > 0, F.col("_n_free")).otherwise(F.col("_n_all"))
    # Only the first ``target`` matches can get one of the extra slots.
    placed = ordered.row_numbers(joined, [], ["match_id"], ordered.text_slices("match_id"), "_pos")
    quota = F.floor(slots / n) + (F.col("_pos") <= slots % n).cast("int")
    quotas = placed.withColumn("_quota", quota).where(F.col("_quota") > 0)
    # At most ``target`` matches hold a quota.
    run = Window.partitionBy(F.lit(0)).orderBy("match_id").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    odd = F.col("_quota") % 2
    extra = F.floor(F.lit(target) / 2) - F.col("_done_pos") - F.sum(F.floor(F.col("_quota") / 2)).over(every)
    quotas = quotas.withColumns({"_extra": extra, "_odd": F.sum(odd).over(run), "_odds": F.sum(odd).over(every)})
    balanced = (F.col("_extra") >= 0) & (F.col("_extra") <= F.col("_odds"))
    positive = F.floor(F.col("_quota") / 2) + ((odd == 1) & (F.col("_odd") <= F.col("_extra"))).cast("int")
    quotas = quotas.withColumn(
        "_q1", F.when(balanced, positive).otherwise(F.raise_error(F.lit("outcomes can not be balanced in the pilot")))
    ).withColumn("_q0", F.col("_quota") - F.col("_q1"))
    enough = (F.col("_pool_1") >= F.col("_q1")) & (F.col("_pool_0") >= F.col("_q0"))
    quotas = quotas.select(
        F.when(enough, F.col("match_id")).otherwise(
            F.raise_error(F.concat(F.lit("too few rows for the pilot: "), F.col("match_id")))
        ).alias("match_id"),
        "_q1",
        "_q0",
    )
    pool = seeded_top(queue.where(~done), ["match_id", "quick_regain_success"], target, seed, "_rank")
    fresh = pool.join(quotas, "match_id").where(
        F.col("_rank") <= F.when(F.col("quick_regain_success") == 1, F.col("_q1")).otherwise(F.col("_q0"))
    )
    cols = queue.columns
    picked = completed.select(*cols, F.lit(0).alias("_new")).unionByName(fresh.select(*cols, F.lit(1).alias("_new")))
    # The pilot holds ``target`` rows, so its order fits one task.
    by = Window.partitionBy(F.lit(0)).orderBy("_new", F.when(F.col("_new") == 1, F.col("match_id")), seeded_key("candidate_id", seed))
    return picked.withColumn("pilot_order", F.row_number().over(by)).drop("_new")
