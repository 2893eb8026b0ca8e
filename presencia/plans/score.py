"""The scoring program: observed table and panel in, result tables out."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.functions import stats as S
from presencia.operators import background, decide, diagnostics, evidence, observed, panel, shared, summary, unique, units
from presencia.params import ScoreParams
from presencia.session import ship_package
from presencia.sources import readers, reuse as stored, sinks
from presencia.tables import written

KEYS = ["analysis_unit_id", "genome_id"]
#: Columns of the full table that the plain one leaves out.
DETAIL = ("log_error_sum", "n_unique_without_error", "null_q95", "null_q99", "alpha_excess_index", "min_attainable_p", "tail_percentile", "unique_depth_fold")


@dataclass
class Prepared:
    """What every mode of scoring starts from; built once."""

    params: ScoreParams
    rows: DataFrame
    valid: DataFrame
    pairs: DataFrame
    mapping: DataFrame
    unit_peptides: DataFrame
    panel: DataFrame
    matches: DataFrame
    degeneracy: DataFrame
    genomes: DataFrame
    peptides: DataFrame
    unit_matches: DataFrame
    metrics: DataFrame
    #: Genomes whose matches came from the store, and others; None without one.
    reused: dict[str, int] | None = None


@dataclass
class ScoreResult:
    prepared: Prepared
    unit_genome: DataFrame
    mode: str
    calibration: DataFrame | None = None
    bins: DataFrame | None = None
    trace: DataFrame | None = None
    seconds: dict | None = None

    def tables(self, derived: bool = False) -> dict[str, DataFrame]:
        """The result tables by name; ``derived`` adds the full table, the
        lists and unions of called genomes and the three matrices."""
        p, rows = self.prepared, self.unit_genome
        # read by its own table, both unions and the test that they are nested
        cohort = summary.ordered_summary(written(summary.cohort_summary(rows), "cohort"))
        out = {
            "unit_genome_results": rows.select(*[c for c in rows.columns if c not in DETAIL]),
            "cohort_genome_summary": cohort,
            "sample_unit_mapping": p.mapping,
            "unit_call_counts": summary.call_counts(rows, units.unit_samples(p.mapping)),
            "unit_threshold_summary": summary.threshold_summary(rows),
            "unit_genome_list_q001": summary.compact_list(rows, "pass_q_0_01"),
            "unit_genome_list_q005": summary.compact_list(rows, "pass_q_0_05"),
            "coverage": summary.coverage(rows, p.unit_matches),
        }
        if self.calibration is not None:
            out |= {"calibration": self.calibration, "bin_diagnostics": self.bins}
        if derived:
            wide = summary.union_of_calls(cohort, "0_05")
            out |= {
                "unit_genome_results_full": rows,
                "unit_q001_genomes": summary.significant(rows, "pass_q_0_01"),
                "unit_q005_genomes": summary.significant(rows, "pass_q_0_05"),
                "genome_union_q001": summary.require_nested(summary.union_of_calls(cohort, "0_01"), wide),
                "genome_union_q005": wide,
            } | {f"genome_by_unit_{v}_matrix": summary.presence_matrix(rows, v) for v in ("q001", "q005", "qvalue")}
        return out

    def run_document(self) -> DataFrame:
        """One row: the run as JSON, for ``write_manifest`` to write."""
        return diagnostics.run_document(self.unit_genome, self.prepared.params, {"mode": self.mode} | (self.prepared.reused or {}), self.seconds)


def prepare(
    raw: DataFrame, panel_rows: DataFrame, params: ScoreParams = ScoreParams(), metadata: DataFrame | None = None, lineage: DataFrame | None = None,
    keep: bool = False, reuse: str | None = None, digestion: dict | None = None,
) -> Prepared:
    """Observed rows to matches and metrics. ``keep`` writes what is used more
    than once to the shared folder: the observed rows, the distinct panel, the
    matches and the panel's counts. ``reuse``: a folder in which counts and
    matches outlive the run. The counts are taken from there if the whole panel is
    the same, the matches of each genome that is, if policy, observed peptides
    and ``digestion`` (how the panel was cut) are too."""
    save = written if keep else (lambda df, _: df)

    def of_panel() -> tuple[DataFrame, DataFrame, DataFrame | None]:
        rows, marks = save(panel_rows, "panel"), None
        if reuse is None:
            genomes = panel.opportunity(rows)
        else:
            marks = written(stored.genome_marks(rows), "genome-marks")
            made_of = {"table": "opportunity"} | stored.provenance(params.peptide_policy, digestion, marks=marks)
            genomes, _ = sinks.materialise(lambda: panel.opportunity(rows), raw.sparkSession, reuse, made_of)
        if lineage is not None:
            genomes = genomes.join(lineage, "genome_id", "left")
        return rows, save(genomes, "genomes"), marks

    # the panel and the observed rows do not need each other until they match
    with ThreadPoolExecutor(1) as side:
        panel_tables = side.submit(of_panel)
        o = _observed_tables(raw, params, metadata, save)
        panel_rows, genomes, marks = panel_tables.result()
    if reuse is None:
        matches, reused = save(panel.match(panel_rows, o.unit_peptides), "matches"), None
    else:
        matches, reused = stored.matched(panel_rows, o.unit_peptides, reuse, params.peptide_policy, digestion, marks)
    degeneracy = panel.degeneracy(matches)
    peptides = save(evidence.peptide_table(degeneracy, observed.peptide_scores(o.seen), observed.peptide_errors(o.seen), params), "peptides")
    unit_matches = save(evidence.unit_matches(o.unit_peptides, peptides, matches), "unit-matches")
    metrics = save(evidence.unit_metrics(unit_matches, params), "metrics")
    return Prepared(params, o.rows, o.valid, o.pairs, o.mapping, o.unit_peptides, panel_rows, matches, degeneracy, genomes, peptides, unit_matches, metrics, reused)


@dataclass
class _Observed:
    rows: DataFrame
    valid: DataFrame
    pairs: DataFrame
    mapping: DataFrame
    unit_peptides: DataFrame
    seen: DataFrame


def _observed_tables(raw: DataFrame, params: ScoreParams, metadata: DataFrame | None, save) -> _Observed:
    canonical = save(readers.observed_columns(raw, params.unit_mode, needs_intensity=params.intensity_quantile > 0 or params.min_intensity > 0), "observed")
    rows = observed.targets(canonical, params)
    valid = observed.valid(rows, params)
    pairs = save(observed.sample_pairs(valid), "pairs")
    per_sample = observed.sample_rows(rows)
    assigned = units.assign_units(per_sample.select("sample_id"), params.unit_mode, metadata)
    mapping = save(units.sample_mapping(assigned, per_sample, pairs), "mapping")
    included = mapping.where("included").select("sample_id")
    used = valid.join(included, "sample_id", "left_semi")
    # the best score and largest error of a peptide: all that is asked of its rows
    seen = save(used.groupBy("peptide").agg(F.max("score").alias("score"), F.max("error").alias("error")), "peptide-seen")
    unit_peptides = save(units.unit_peptides(pairs, mapping), "unit-peptides")
    return _Observed(rows, valid, pairs, mapping, unit_peptides, seen)


def observed_peptides(raw: DataFrame, params: ScoreParams, metadata: DataFrame | None = None) -> DataFrame:
    """peptide: the distinct valid peptides of included samples."""
    return _observed_tables(raw, params, metadata, lambda df, _: df).unit_peptides.select("peptide").distinct()


def full_grid(p: Prepared) -> DataFrame:
    used = p.mapping.where("included").select("analysis_unit_id").distinct()
    return evidence.grid(used, p.genomes, p.metrics)


def decided(rows: DataFrame, params: ScoreParams) -> DataFrame:
    return decide.ranked(decide.bh(decide.combined(rows, params)))


def score_alpha(p: Prepared) -> DataFrame:
    """Unique evidence by error bounds alone, shared evidence left at 1."""
    rows = decide.with_targets(unique.alpha_bound(full_grid(p), p.params), p.params.knockoff_top_n)
    # read by the p-values' counts, the sample of the ranks' ranges and the ranks
    return decided(written(rows.withColumn("pvalue_shared", F.lit(1.0)), "grid"), p.params)


def resolved_mode(p: Prepared) -> tuple[str, int]:
    """(mode, bins): ``auto`` follows the panel's structure."""
    found = background.eligibility(p.genomes, p.params).first()
    mode = p.params.unique_mode
    if mode == "auto":
        mode = "empirical-background" if found.eligible else "alpha-upper-bound"
    return mode, max(1, found.effective_bins)


def _p_unique(rows: DataFrame, mode: str, p: Prepared) -> DataFrame:
    out = unique.hypergeometric(unique.alpha_bound(rows, p.params), evidence.observed_pool_sizes(p.metrics), panel.universe(p.panel))
    return out.withColumn("pvalue_unique", F.col("pvalue_hypergeometric")) if mode == "hypergeometric-opportunity" else out


def score(
    raw: DataFrame, panel_rows: DataFrame, params: ScoreParams = ScoreParams(), metadata: DataFrame | None = None, lineage: DataFrame | None = None, reuse: str | None = None,
    digestion: dict | None = None,
) -> ScoreResult:
    """The whole program, both kinds of evidence and both Monte Carlo stages."""
    ship_package(raw.sparkSession)
    seconds, since = {}, [time.monotonic()]

    def done(step: str) -> None:
        seconds[step] = round(time.monotonic() - since[0], 3)
        since[0] = time.monotonic()

    p = prepare(raw, panel_rows, params, metadata, lineage, keep=True, reuse=reuse, digestion=digestion)
    observed.require_rows(p.unit_peptides, "valid peptide of an included sample")
    mode, bins = resolved_mode(p)
    done("prepare")
    base = written(decide.with_targets(_p_unique(full_grid(p), mode, p), params.knockoff_top_n), "grid")
    targets = base.where("is_target")
    strata = written(evidence.strata_counts(p.unit_matches), "strata")
    pages = shared.pool_pages(evidence.knockoff_pools(p.unit_peptides, p.peptides))
    k1, k2 = (max(shared.LEAST_ITERATIONS, k) for k in (params.iterations_stage1, params.iterations_stage2))
    stage1 = written(shared.nulls(targets, strata, pages, k1, params.seed), "knockoff-1")
    done("stage1")

    def with_shared(rows: DataFrame, null: DataFrame) -> DataFrame:
        return rows.join(null, KEYS, "left").fillna(1.0, ["pvalue_shared"]).fillna(0.0, ["null_mean", "null_sd", "null_q95", "null_q99", "z_shared"])

    rows = with_shared(base, stage1)
    calibration = bin_table = trace = None
    if mode == "empirical-background":
        active = background.by_strength(rows.where("n_matched >= 1"))
        judged, trace = background.calibrate(active, bins, params)
        calibration = written(background.calibration_report(judged, trace, params), "calibration")
        bin_table = background.bin_report(judged, params, background.first_bins(active, bins, params), calibration)
        extra = [c for c in judged.columns if c not in rows.columns and not c.startswith("pvalue") and c not in ("qvalue", "fraction")]
        found = judged.select(*KEYS, F.col("pvalue_unique").alias("_pu"), *extra)
        base = written(base.join(found, KEYS, "left").withColumn("pvalue_unique", F.coalesce("_pu", F.lit(1.0))).drop("_pu"), "grid-empirical")
        rows = with_shared(base, stage1)
        done("calibration")
    first = decide.combined(rows, params)
    again = first.where(F.col("is_target") & S.in_any_range(F.col("pvalue"), params.stage2_ranges))
    null = stage1
    if k2 > k1:
        # the first stage's draws and those that go on where it ended
        again = written(again.select(*KEYS, "weighted_evidence_shared"), "refine")
        null = written(shared.refined(stage1, shared.nulls(again, strata, pages, k2, params.seed)).drop("refined"), "knockoff")
    done("stage2")
    result = decided(with_shared(base, null), params)
    if mode == "alpha-upper-bound":
        # the background only describes such a run; it decides nothing
        judged = written(result, "judged")
        found = background.alpha_mode_diagnostics(judged.where("n_matched >= 1"), bins, params)
        extra = [c for c in found.columns if c not in judged.columns]
        result = judged.join(found.select(*KEYS, *extra), KEYS, "left")
    result = result.join(units.unit_samples(p.mapping), "analysis_unit_id", "left")
    result = written(result, "unit-genome")
    done("decide")
    return ScoreResult(p, result, mode, calibration, bin_table, trace, seconds)


def with_mode(params: ScoreParams, **changes) -> ScoreParams:
    return replace(params, **changes)
