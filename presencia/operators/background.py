"""Empirical backgrounds of unique counts, stratified by opportunity.

Leave-one-out values come from running counts of the background's histogram,
never from lists of genomes: leaving out one copy of a value shifts places by one.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presencia.functions import stats as S
from presencia.operators import decide
from presencia.operators.ranking import at_place, counted, quantiles, with_rank
from presencia.params import ScoreParams
from presencia.tables import written

U, A, UNIT = "n_unique", "opportunity", "analysis_unit_id"
#: What a genome's background statistics depend on.
GROUP = [UNIT, U, "in_background", "bin"]
QUANTILES = {f"background_unique_q{n}": n / 100 for n in (50, 90, 95, 99)}


def require_opportunity(rows: DataFrame) -> DataFrame:
    if A not in rows.columns:
        raise ValueError("an empirical background needs the panel-unique opportunity; total counts do not stand in for it")
    return rows


def without_opportunity(rows: DataFrame) -> DataFrame:
    """Genomes with a match whose panel-unique opportunity is not known: an
    empirical background can't place them."""
    return require_opportunity(rows).where((F.col("n_matched") >= 1) & F.col(A).isNull()).select(UNIT, "genome_id")


STRENGTH = ["_strength_rank", "_active"]


def by_strength(active: DataFrame) -> DataFrame:
    """``active`` with each genome's place by strength in its unit and the
    unit's size. The order does not depend on the share that is left out, so a
    calibration ranks once."""
    order = [F.desc(U), F.desc("unique_weighted_evidence"), F.desc("weighted_evidence"), F.asc("genome_id")]
    ranked = with_rank(active, UNIT, order, STRENGTH[0], "strength")
    # the last place is the unit's size
    return written(ranked.join(ranked.groupBy(UNIT).agg(F.max(STRENGTH[0]).cast("long").alias(STRENGTH[1])), UNIT), "by-strength")


def split_background(active: DataFrame, fraction: Column) -> DataFrame:
    """in_background: all but the strongest ceil(n * fraction), never none."""
    ranked = active if STRENGTH[0] in active.columns else by_strength(active)
    n = F.col(STRENGTH[1])
    drop = F.least(F.ceil(n * F.greatest(F.least(fraction, F.lit(1.0)), F.lit(0.0))), n - 1)
    out = ranked.withColumn("in_background", F.col(STRENGTH[0]) > drop)
    return out if ranked is active else out.drop(*STRENGTH)


def _edges(k: int) -> list[float]:
    return [i / k for i in range(k + 1)]


def bin_edges(rows: DataFrame, keys: list[str], bins: Column, max_bins: int) -> DataFrame:
    """keys, interior: the distinct quantile edges without the outer ones."""
    every = sorted({q for k in range(1, max_bins + 1) for q in _edges(k)})
    at = {q: i for i, q in enumerate(every)}
    sizes = rows.groupBy(*keys, A).agg(F.count("*").alias("k")).groupBy(*keys).agg(F.sum("k").alias("n"), F.count("*").alias("distinct"))
    found = quantiles(rows, keys, A, {f"q{i}": q for i, q in enumerate(every)}, "edges").drop("n")
    out = sizes.join(found, keys).withColumn("v", F.array(*[F.col(f"q{i}").cast("double") for i in range(len(every))]))
    out = out.withColumn("bins", F.greatest(F.lit(1), F.least(bins, F.col("distinct"))))
    picked = F.array(F.lit(0.0)).cast("array<double>")
    for k in range(2, max_bins + 1):
        own = F.array(*[F.round(F.col("v")[at[q]], 9) for q in _edges(k)])
        picked = F.when(F.col("bins") == k, own).otherwise(picked)
    edges = F.array_distinct(picked)
    interior = F.filter(edges, lambda e: (e > F.array_min(edges)) & (e < F.array_max(edges)))
    return out.select(*keys, F.col("n").alias("n_rows"), interior.alias("interior"))


def with_bins(active: DataFrame, n_bins: int, params: ScoreParams) -> DataFrame:
    """bin: quantile bins of opportunity whose edges are the background's."""
    n = F.floor(F.col("n") / F.lit(params.min_bin_size))
    bins = F.least(F.lit(n_bins), F.greatest(F.lit(1), n))
    edges = bin_edges(active.where("in_background"), [UNIT], bins, max(1, n_bins)).select(UNIT, "interior")
    out = active.join(edges, UNIT)
    return out.withColumn("bin", F.size(F.filter("interior", lambda e: e < F.col(A)))).drop("interior")


def _leave_one_out(active: DataFrame, keys: list[str], q: float, tag: str) -> DataFrame:
    """Per (keys, U, membership): size, ge, le, mean and quantile of the
    background without one own copy. ``active``: counts ``k`` by bin, U and
    membership.

    Counts below and up to each U are running counts of the background. Without
    one copy of a value the places behind it move down by one, and all members
    ask for the same two places, as all others do; so five values of the whole
    background, found by their places, are all that a group's rows can ask for.
    """
    hist = counted(active, keys, U, F.sum(F.when(F.col("in_background"), F.col("k")).otherwise(0)), "background")
    total = F.col("total")

    def places(size: Column) -> tuple[Column, Column]:
        place = (size - 1) * F.lit(q)
        return F.greatest(F.floor(place), F.lit(0)), place

    inside, outside = places(total - 1)[0], places(total)[0]
    wanted = {"i0": inside, "i1": F.least(inside + 1, total - 2), "o0": outside, "o1": F.least(outside + 1, total - 1)}
    wanted |= {"j0": wanted["i0"] + 1, "j1": wanted["i1"] + 1}
    of_key = hist.groupBy(*keys).agg(F.max("total").alias("total"), F.sum(F.col("n") * F.col(U)).alias("sum"), *[at_place(p, U).cast("double").alias(k) for k, p in wanted.items()])
    asked = active.select(*keys, U, "in_background").distinct().join(hist.select(*keys, U, "n", "upto"), [*keys, U]).join(of_key, keys)
    own = F.col("in_background").cast("int")
    size, below = F.col("total") - own, F.col("upto") - F.col("n")
    low, place = places(size)

    def element(at: Column, kept: str, moved: str, other: str) -> Column:
        return F.when(~F.col("in_background"), F.col(other)).when(at >= below, F.col(moved)).otherwise(F.col(kept))

    a, b = element(low, "i0", "j0", "o0"), element(F.least(low + 1, size - 1), "i1", "j1", "o1")
    quantile = F.when(size > 0, a + (b - a) * (place - low)).otherwise(0.0)
    mean = F.when(size > 0, (F.col("sum") - own * F.col(U)) / size).otherwise(0.0)
    named = {"size": size, "ge": F.col("total") - below - own, "le": F.col("upto") - own, "mean": mean, "threshold": quantile}
    return asked.select(*keys, U, "in_background", *[F.coalesce(c, F.lit(0)).alias(f"{tag}_{k}") for k, c in named.items()])


def background_stats(active: DataFrame, fraction: Column, n_bins: int, params: ScoreParams) -> DataFrame:
    """``active`` (genomes with a match) with bin, background membership and
    the leave-one-out statistics of its bin, or of the unit where that is empty.
    They take the place of columns of ``active`` with their names."""
    require_opportunity(active)
    rows = written(with_bins(split_background(active, fraction), n_bins, params), "binned")
    groups = written(rows.groupBy(*GROUP).agg(F.count("*").alias("k")), "background-groups")
    stats = group_stats(groups, params)
    return rows.drop(*[c for c in stats.columns if c not in GROUP]).join(stats, GROUP)


def group_stats(groups: DataFrame, params: ScoreParams) -> DataFrame:
    """The statistics of each bin, U and membership. ``groups``: these with
    counts ``k``; several rows of one are added up."""
    in_bin = _leave_one_out(groups, [UNIT, "bin"], params.threshold_quantile, "b")
    in_unit = _leave_one_out(groups, [UNIT], params.threshold_quantile, "u")
    out = in_bin.join(in_unit, [UNIT, U, "in_background"])
    pick = {k: F.when(F.col("b_size") > 0, F.col(f"b_{k}")).otherwise(F.col(f"u_{k}")) for k in ("size", "ge", "le", "mean", "threshold")}
    size, excess = pick["size"], F.greatest(F.lit(0.0), F.col(U) - pick["threshold"])
    tail = (1.0 + pick["ge"]) / (1.0 + size)
    index = S.clip_p(F.when(excess > 0, F.pow(F.lit(params.alpha), excess)).otherwise(1.0))
    out = out.withColumns(
        {
            "background_size": size,
            "background_threshold": pick["threshold"],
            "excess_count": excess,
            "alpha_excess_index": index,
            "p_tail": S.clip_p(tail),
            "tail_percentile": F.when(size > 0, pick["le"] / size).otherwise(0.0),
            "min_attainable_p": 1.0 / (1.0 + size),
            "expected_unique_null": pick["mean"],
            "unique_depth_fold": F.col(U) / F.greatest(pick["mean"], F.lit(1e-12)),
        }
    )
    formal = F.col("p_tail") if params.empirical_method == "empirical-tail" else F.col("alpha_excess_index")
    return out.withColumn("pvalue_unique", formal).drop(*[f"{t}_{k}" for t in "bu" for k in ("size", "ge", "le", "mean", "threshold")])


def eligibility(genomes: DataFrame, params: ScoreParams, least_comparable: int = 100, least_tail: float = 5.0, least_share: float = 0.9) -> DataFrame:
    """One row: whether the panel can carry an empirical background, from its
    structure alone; all candidates are binned by opportunity."""
    above = 1.0 - params.threshold_quantile
    target = F.greatest(F.lit(params.min_bin_size), F.lit(least_comparable + 1), F.ceil(F.lit(least_tail) / F.lit(max(above, 1e-12)) - 1e-9) + 1)
    bins = F.greatest(F.lit(1), F.least(F.lit(params.max_bins), F.floor(F.col("n") / target)))
    edges = bin_edges(genomes.withColumn("_one", F.lit(1)), ["_one"], bins, params.max_bins)
    rows = genomes.crossJoin(F.broadcast(edges.select("interior")))  # one row of at most eight edges
    sizes = rows.groupBy(F.size(F.filter("interior", lambda e: e < F.col(A))).alias("bin")).agg(F.count("*").alias("k"))
    comparable = F.col("k") - 1
    fine = (comparable >= least_comparable) & (comparable * above + 1e-12 >= least_tail) & (F.col("k") >= params.min_bin_size)
    out = sizes.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("candidates"), F.count("*").alias("effective_bins"),
        F.coalesce(F.sum(F.when(fine, F.col("k"))), F.lit(0)).alias("adequate"),
        F.coalesce(F.min(comparable), F.lit(0)).alias("min_comparable"), F.coalesce(F.max(comparable), F.lit(0)).alias("max_comparable"),
    )
    share = F.when(F.col("candidates") > 0, F.col("adequate") / F.col("candidates")).otherwise(0.0)
    return out.withColumn("adequate_fraction", share).withColumn("eligible", (F.col("candidates") > 0) & (share + 1e-12 >= least_share))


def calibrate(active: DataFrame, n_bins: int, params: ScoreParams) -> tuple[DataFrame, DataFrame]:
    """Find each unit's excluded share; all units go through the passes
    together and a settled one keeps its share.

    ``active``: genomes with a match, with pvalue_shared and is_target.
    Returns (final statistics, trace: unit, iteration, exclude_fraction,
    candidate_fraction, new_fraction; the last pass has iteration null).
    """
    c = params.calibration
    active = active if STRENGTH[0] in active.columns else by_strength(active)
    require_opportunity(active)
    # what a share depends on; all columns go through the last pass alone
    slim = active.select(UNIT, U, A, *STRENGTH, "pvalue_shared", "is_target")
    start = min(max(c.initial, c.least), c.most)
    state = active.select(UNIT).distinct().withColumns({"fraction": F.lit(start), "done": F.lit(False)})
    trace = None

    def split(rows: DataFrame, state: DataFrame) -> DataFrame:
        return rows.join(state.select(UNIT, "fraction"), UNIT)

    def tested(state: DataFrame) -> DataFrame:
        """A row for all genomes that share a p-value's makings, and their number k."""
        binned = with_bins(split_background(split(slim, state), F.col("fraction")), n_bins, params)
        groups = written(binned.groupBy(*GROUP, "pvalue_shared", "is_target").agg(F.count("*").alias("k")), "binned")
        return decide.combined(groups.join(group_stats(groups, params), GROUP), params)

    def share_of(rows: DataFrame, n: Column) -> DataFrame:
        candidates = F.sum(F.when(F.col("qvalue") <= c.candidate_q, n).otherwise(0))
        return rows.groupBy(UNIT).agg((candidates / F.sum(n)).alias("candidate_fraction"))

    for i in range(1, c.max_iterations + 1):
        # equal p share a q: a row a distinct p tells the share
        share = share_of(decide.q_values(tested(state), n=F.sum("k")), F.col("n"))
        new = F.greatest(F.least("candidate_fraction", F.lit(c.most)), F.lit(c.least))
        step = written(state.join(share, UNIT).withColumn("new_fraction", new), f"calibration-{i}")
        row = step.where("NOT done").select(UNIT, F.lit(i).alias("iteration"), F.col("fraction").alias("exclude_fraction"), "candidate_fraction", "new_fraction")
        trace = row if trace is None else trace.union(row)
        settled = F.abs(F.col("new_fraction") - F.col("fraction")) < c.settled
        state = step.select(UNIT, F.when(F.col("done"), F.col("fraction")).otherwise(F.col("new_fraction")).alias("fraction"), (F.col("done") | settled).alias("done"))
        if state.where("NOT done").isEmpty():
            break
    stats = background_stats(split(active, state), F.col("fraction"), n_bins, params)
    judged = written(decide.bh(decide.combined(stats, params)).drop(*STRENGTH), "calibrated")
    last = share_of(judged, F.lit(1)).join(state, UNIT).select(UNIT, F.lit(None).cast("int").alias("iteration"), F.col("fraction").alias("exclude_fraction"), "candidate_fraction", F.col("fraction").alias("new_fraction"))
    return judged, trace.union(last)


def calibration_report(judged: DataFrame, trace: DataFrame, params: ScoreParams, least_share: float = 0.9) -> DataFrame:
    """One row a unit: shares, sizes, quantiles of the background, whether the
    cap was reached, convergence, the trace as JSON, and a verdict with its
    reason that never changes the mode."""
    c = params.calibration
    passes = F.col("iteration").isNotNull()
    step = F.struct("iteration", "exclude_fraction", "candidate_fraction", "new_fraction")
    t = trace.groupBy(UNIT).agg(
        F.count_if(passes).alias("iteration_count"),
        F.max(F.when(F.col("iteration") == 1, F.col("exclude_fraction"))).alias("initial_exclusion_fraction"),
        F.max(F.when(~passes, F.col("exclude_fraction"))).alias("final_exclusion_fraction"),
        F.max(F.when(~passes, F.col("candidate_fraction"))).alias("next_requested_fraction"),
        F.max_by(F.abs(F.col("new_fraction") - F.col("exclude_fraction")), F.when(passes, F.col("iteration"))).alias("last_change"),
        F.to_json(F.sort_array(F.collect_list(F.when(passes, step)))).alias("iteration_trace"),
    )
    b = judged.groupBy(UNIT).agg(
        F.count("*").alias("active_genomes"), F.count_if("in_background").alias("background_size"), F.count_distinct("bin").alias("bin_count"),
        F.min("min_attainable_p").alias("min_p_resolution"),
    )
    b = b.join(quantiles(judged.where("in_background"), [UNIT], U, QUANTILES, "unit-quantiles").drop("n"), UNIT, "left")
    kept = F.col("active_genomes") - F.least(F.ceil(F.col("active_genomes") * F.col("initial_exclusion_fraction")), F.col("active_genomes") - 1)
    out = t.join(b, UNIT).withColumn("initial_background_size", kept).withColumn("exclusion_fraction_cap", F.lit(c.most))
    cap = F.col("final_exclusion_fraction") >= c.most - 1e-12
    above, settled = F.col("next_requested_fraction") > c.most + 1e-12, F.col("last_change") < c.settled
    out = out.withColumns({"cap_reached": cap, "update_above_cap": above, "converged": settled})
    pressed = bin_report(judged, params, units=out).groupBy(UNIT).agg((F.sum(F.when(F.col("cap_pressure"), F.col("active_genomes")).otherwise(0)) / F.sum("active_genomes")).alias("affected_fraction"))
    out = out.join(pressed, UNIT).withColumn("adequate_fraction", 1.0 - F.col("affected_fraction"))
    strained = F.col("cap_reached") & (F.col("update_above_cap") | ~F.col("converged"))
    bad = strained & (F.col("affected_fraction") + 1e-12 >= least_share)
    share = F.format_string("%.3f", "affected_fraction")
    reason = (
        F.when(bad, F.concat(F.lit("the cap binds for "), share, F.lit(" of the candidates over all bins")))
        .when(~F.col("cap_reached"), "the share stayed below the cap")
        .when(~strained, "the share settled at the cap and asked for no more")
        .otherwise(F.concat(F.lit("the cap binds for only "), share, F.lit(f" of the candidates, under {least_share:.3f}")))
    )
    return out.withColumns({"suitable": ~bad, "reason": reason}).drop("last_change")


def first_bins(active: DataFrame, n_bins: int, params: ScoreParams) -> DataFrame:
    """Background size per unit and bin of the first pass."""
    c = params.calibration
    rows = with_bins(split_background(active, F.lit(min(max(c.initial, c.least), c.most))), n_bins, params)
    return rows.groupBy(UNIT, "bin").agg(F.count_if("in_background").alias("initial_background_genomes"))


def bin_report(judged: DataFrame, params: ScoreParams, initial: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """One row a unit and bin of the last pass, beside the first pass's sizes
    if ``initial`` has them. With ``units`` (the calibration's report): a bin
    presses on the cap when its unit has reached it and either the bin's
    candidates exceed it or the unit has not settled."""
    c = params.calibration
    out = judged.groupBy(UNIT, "bin").agg(
        F.count("*").alias("active_genomes"), F.count_if("in_background").alias("background_genomes"),
        F.min("min_attainable_p").alias("min_p_resolution"), F.min(U).alias("min_unique"), F.max(U).alias("max_unique"),
        F.count_if(F.col("qvalue") <= c.candidate_q).alias("candidates"),
    )
    found = quantiles(judged.where("in_background"), [UNIT, "bin"], U, QUANTILES, "bin-quantiles").drop("n")
    out = out.join(found, [UNIT, "bin"], "left").fillna(0.0, list(QUANTILES))
    if initial is not None:
        out = out.join(initial, [UNIT, "bin"], "left").fillna(0, ["initial_background_genomes"])
    out = out.withColumn("candidate_fraction", F.col("candidates") / F.col("active_genomes"))
    if units is None:
        return out
    out = out.join(units.select(UNIT, "cap_reached", "converged"), UNIT)
    return out.withColumn("cap_pressure", F.col("cap_reached") & ((F.col("candidate_fraction") > c.most + 1e-12) | ~F.col("converged")))


def alpha_mode_diagnostics(judged: DataFrame, n_bins: int, params: ScoreParams) -> DataFrame:
    """One pass for a run in alpha mode: the excluded share is that of its own
    candidates, tails count; fills diagnostic columns only. ``judged``: genomes
    with a match."""
    c, params = params.calibration, replace(params, empirical_method="empirical-tail")
    share = judged.groupBy(UNIT).agg(F.avg((F.col("qvalue") <= c.candidate_q).cast("double")).alias("share"))
    fraction = F.greatest(F.least("share", F.lit(c.most)), F.lit(c.least))
    keep = ["genome_id", UNIT, U, A, "unique_weighted_evidence", "weighted_evidence"]
    stats = background_stats(judged.select(*keep).join(share.withColumn("fraction", fraction), UNIT), F.col("fraction"), n_bins, params)
    return stats.drop("pvalue_unique", "share", "fraction")
