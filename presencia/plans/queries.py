"""Registered queries of the presence engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.functions import stats as S
from presencia.functions import text as T
from presencia.operators import background, decide, diagnostics, digestion, evidence, observed, panel, summary, unique, units
from presencia.params import ScoreParams
from presencia.plans import fixture, score
from presencia.plans.sql import CALLING_ALPHA, calibration, diagnosed, digits, empirical, statement, whole_run
from presencia.session import ship_package
from presencia.sources import manifest, readers, reuse, sinks
from presencia.tables import new_path, written

ALPHA = ScoreParams(unit_mode="metadata", unique_mode="alpha-upper-bound")
#: A bound so small that genomes are called, at both levels and not at both.
CALLING = ScoreParams(unit_mode="metadata", unique_mode="alpha-upper-bound", alpha=float(CALLING_ALPHA))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return run

    return register


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _rows(spark, d) -> DataFrame:
    return observed.targets(readers.observed_columns(fixture.observed(spark, d), "metadata"), ALPHA)


def _valid(spark, d) -> DataFrame:
    return observed.valid(_rows(spark, d), ALPHA)


def _meta(spark, d) -> DataFrame:
    return units.check_metadata(readers.metadata_columns(fixture.metadata(spark, d)))


def _prepared(spark, d, params: ScoreParams = ALPHA, keep: bool = True) -> score.Prepared:
    return score.prepare(fixture.observed(spark, d), fixture.panel(spark, d), params, _meta(spark, d), keep=keep)


def _scored(spark, d, params: ScoreParams = ALPHA) -> tuple[score.Prepared, DataFrame]:
    p = _prepared(spark, d, params)
    return p, written(score.score_alpha(p), "scored")


def calls(body: str) -> str:
    """SQL over the scores in which genomes are called."""
    return statement("scored", body, CALLING_ALPHA)


def _calls(spark, d) -> tuple[score.Prepared, DataFrame]:
    return _scored(spark, d, CALLING)


# ---- observed ------------------------------------------------------------------


@query(statement("clean", "SELECT sample_id, peptide, intensity, score, error FROM clean"))
def observed_clean(spark, d):
    return _valid(spark, d).select("sample_id", "peptide", "intensity", "score", "error")


@query(statement("pairs", "SELECT * FROM pairs"))
def sample_pairs(spark, d):
    return observed.sample_pairs(_valid(spark, d))


@query(
    statement(
        "clean",
        """SELECT t.sample_id, count(*) AS n_total_rows, coalesce(max(v.n), 0) AS n_valid_peptides, coalesce(max(v.n), 0) > 0 AS included FROM target t
        LEFT JOIN (SELECT sample_id, count(DISTINCT raw) AS n FROM clean GROUP BY sample_id) v USING (sample_id) GROUP BY t.sample_id""",
    )
)
def sample_preview(spark, d):
    return observed.sample_preview(_rows(spark, d), _valid(spark, d))


@query(
    statement(
        "clean",
        """SELECT c.sample_id, c.peptide, c.intensity FROM clean c JOIN (SELECT sample_id, quantile_cont(intensity, 0.25) AS b FROM clean GROUP BY sample_id) USING (sample_id) WHERE c.intensity >= b""",
    )
)
def intensity_quantile(spark, d):
    return observed.above_quantile(_valid(spark, d), 0.25).select("sample_id", "peptide", "intensity")


@query(statement("target", "SELECT count(DISTINCT raw) AS n_before, count(DISTINCT peptide) AS n_after, count(DISTINCT raw) - count(DISTINCT peptide) AS n_merged FROM target"))
def normalisation_collisions(spark, d):
    return observed.collisions(_rows(spark, d))


@query(statement("scores", "SELECT peptide, round(score, 6) AS score, round(error, 6) AS error FROM scores"))
def peptide_scores(spark, d):
    keep = units.sample_mapping(units.assign_units(observed.sample_rows(_rows(spark, d)).select("sample_id"), "metadata", _meta(spark, d)), observed.sample_rows(_rows(spark, d)), observed.sample_pairs(_valid(spark, d))).where("included")
    used = _valid(spark, d).join(keep.select("sample_id"), "sample_id", "left_semi")
    return _rounded(observed.peptide_scores(used).join(observed.peptide_errors(used), "peptide"), "score", "error")


@query(
    statement(
        "scores",
        "SELECT round(quantile_cont(score, 0.05), 6) AS q05, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75, round(quantile_cont(score, 0.95), 6) AS q95 FROM scores",
    )
)
def score_quantiles(spark, d):
    p = _prepared(spark, d)
    used = p.valid.join(p.mapping.where("included"), "sample_id", "left_semi")
    return _rounded(observed.score_quantiles(observed.peptide_scores(used)), "q05", "q25", "q50", "q75", "q95")


# ---- units ---------------------------------------------------------------------


@query(statement("mapping", "SELECT * FROM mapping"))
def sample_unit_mapping(spark, d):
    return _prepared(spark, d, keep=False).mapping


@query(statement("pairs", "SELECT 'all-samples' AS analysis_unit_id, count(DISTINCT peptide) AS n_peptides FROM pairs"))
def units_all(spark, d):
    p = _prepared(spark, d, score.with_mode(ALPHA, unit_mode="all-samples"), keep=False)
    return p.unit_peptides.groupBy("analysis_unit_id").agg(F.count("*").alias("n_peptides"))


@query(statement("pairs", "SELECT sample_id AS analysis_unit_id, count(*) AS n_peptides FROM pairs GROUP BY 1"))
def units_per_sample(spark, d):
    p = _prepared(spark, d, score.with_mode(ALPHA, unit_mode="per-sample"), keep=False)
    return p.unit_peptides.groupBy("analysis_unit_id").agg(F.count("*").alias("n_peptides"))


@query(statement("unit_peptides", "SELECT u.analysis_unit_id, count(*) AS n_peptides, (SELECT count(*) FROM mapping m WHERE m.included AND m.analysis_unit_id = u.analysis_unit_id) AS n_samples_in_unit FROM unit_peptides u GROUP BY 1"))
def units_metadata(spark, d):
    p = _prepared(spark, d, keep=False)
    return p.unit_peptides.groupBy("analysis_unit_id").agg(F.count("*").alias("n_peptides")).join(units.unit_samples(p.mapping), "analysis_unit_id")


@query(statement("mapping", "SELECT sample_id, analysis_unit_id, site = 'site1' AS included FROM mapping"))
def inclusion_by_group(spark, d):
    return units.set_included(_prepared(spark, d, keep=False).mapping, "site", "site1", "only").select("sample_id", "analysis_unit_id", "included")


@query(
    statement(
        "mapping",
        """SELECT sample_id, CASE WHEN CAST(substr(sample_id, 2) AS BIGINT) % 5 = 0 THEN 'w' || (CAST(substr(sample_id, 2) AS BIGINT) % 3) ELSE analysis_unit_id END AS analysis_unit_id FROM mapping""",
    )
)
def unit_override(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct()
    unit = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit(" w"), (F.col("conv_id") % 3).cast("string"))).otherwise(" ")
    table = turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".RAW")).alias("sample_id"), unit.alias("analysis_unit_id"))
    return units.override_units(_prepared(spark, d, keep=False).mapping, table).select("sample_id", "analysis_unit_id")


@query(
    statement(
        "per_sample",
        """SELECT sample_id, side FROM (SELECT coalesce(s.sample_id, m.sample_id) AS sample_id, CASE WHEN m.sample_id IS NULL THEN 'missing' WHEN s.sample_id IS NULL THEN 'extra' END AS side
        FROM per_sample s FULL JOIN (SELECT DISTINCT 'c' || conv_id AS sample_id FROM conversations WHERE conv_id % 3 <> 0) m USING (sample_id)) WHERE side IS NOT NULL""",
    )
)
def sample_differences(spark, d):
    table = _meta(spark, d).where(F.substring("sample_id", 2, 20).cast("long") % 3 != 0)
    return units.sample_differences(observed.sample_rows(_rows(spark, d)).select("sample_id"), table)


# ---- panel ---------------------------------------------------------------------

_PROTEIN = "CASE WHEN doc_id % 5 = 0 THEN '**' WHEN doc_id % 7 = 0 THEN '*AK' ELSE '' END"
_BODY = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
_CUT2 = "regexp_replace(regexp_replace({0}, '([KR])([^P|])', '\\1|\\2', 'g'), '([KR])([^P|])', '\\1|\\2', 'g')"
_DIGEST = f"""WITH p AS (SELECT 'g' || (doc_id % 50) AS genome_id, 'p' || doc_id AS protein, {_BODY} || {_PROTEIN} AS bare FROM documents),
c AS (SELECT *, regexp_replace(bare, '\\*+$', '') AS clean FROM p),
f AS (SELECT *, list_filter(string_split({_CUT2.format('clean')}, '|'), lambda x: x <> '') AS parts FROM c) """


@query(_DIGEST + "SELECT genome_id, protein, peptide FROM (SELECT genome_id, protein, unnest(parts) AS peptide FROM f) WHERE length(peptide) BETWEEN 7 AND 30")
def digest_fragments(spark, d):
    return digestion.digest(fixture.proteins(spark, d))


@query(
    _DIGEST
    + """SELECT genome_id, count(*) AS n, count(DISTINCT peptide) AS n_distinct, sum(length(peptide)) AS n_letters FROM (
    SELECT genome_id, unnest(list_transform(range(i, i + least(3, len(parts) - i + 1)), lambda j: array_to_string(parts[i:j], ''))) AS peptide
    FROM (SELECT genome_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM f)) WHERE length(peptide) BETWEEN 7 AND 30 GROUP BY genome_id"""
)
def missed_cleavages(spark, d):
    rows = digestion.digest(fixture.proteins(spark, d), missed=2)
    return rows.groupBy("genome_id").agg(F.count("*").alias("n"), F.count_distinct("peptide").alias("n_distinct"), F.sum(F.length("peptide")).alias("n_letters"))


@query(
    _DIGEST
    + """SELECT genome_id, count(*) AS n_records, count(*) FILTER (bare LIKE '%*') AS n_terminal_stop_records, sum(length(bare) - length(clean)) AS n_terminal_stop_marks,
    count(*) FILTER (contains(clean, '*')) AS n_inner_stop_records, count(*) FILTER (clean = '') AS n_emptied_records, sum(len(parts)) AS n_fragments,
    sum(len(list_filter(parts, lambda x: length(x) BETWEEN 7 AND 30))) AS n_kept,
    array_to_string(list_sort(list(DISTINCT protein) FILTER (contains(clean, '*')))[1:5], ',') AS inner_stop_examples,
    round(CASE WHEN sum(len(parts)) > 0 THEN 100.0 * sum(len(list_filter(parts, lambda x: length(x) BETWEEN 7 AND 30))) / sum(len(parts)) ELSE 0 END, 6) AS retention_pct
    FROM f GROUP BY genome_id"""
)
def digest_qc(spark, d):
    out = digestion.digest_qc(fixture.proteins(spark, d))
    some = F.when(F.size("inner_stop_examples") > 0, F.array_join("inner_stop_examples", ","))
    return _rounded(out.withColumn("inner_stop_examples", some), "retention_pct")


@query(statement("genomes", "SELECT * FROM genomes"))
def panel_opportunity(spark, d):
    return panel.opportunity(fixture.panel(spark, d))


@query(statement("panel", "SELECT count(*) AS n_peptides, sum(n) AS n_pairs, count(*) FILTER (n = 1) AS n_unique FROM (SELECT peptide, count(*) AS n FROM panel GROUP BY peptide)"))
def panel_universe(spark, d):
    return panel.universe(fixture.panel(spark, d))


@query(statement("genomes", "SELECT quantile_cont(opportunity, 0.0) AS q000, quantile_cont(opportunity, 0.25) AS q025, quantile_cont(opportunity, 0.5) AS q050, quantile_cont(opportunity, 0.75) AS q075, quantile_cont(opportunity, 1.0) AS q100 FROM (SELECT CAST(opportunity AS DOUBLE) AS opportunity FROM genomes)"))
def opportunity_quantiles(spark, d):
    return panel.opportunity_quantiles(panel.opportunity(fixture.panel(spark, d)))


@query(statement("panel", "SELECT genome_id, count(*) AS n FROM panel WHERE CAST(genome_id AS BIGINT) % 3 = 0 AND CAST(genome_id AS BIGINT) % 2 <> 0 GROUP BY genome_id"))
def genome_selection(spark, d):
    ids = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("genome_id"))
    some = panel.select_genomes(fixture.panel(spark, d), ids.where("genome_id % 3 = 0"), ids.where("genome_id % 2 = 0"))
    return some.groupBy("genome_id").agg(F.count("*").alias("n"))


@query(statement("panel", "SELECT genome_id, count(*) AS n FROM panel WHERE genome_id IN (SELECT genome_id FROM (SELECT DISTINCT genome_id FROM panel) ORDER BY md5('42|' || genome_id), genome_id LIMIT 100) GROUP BY genome_id"))
def trial_subset(spark, d):
    """A sampling operator: a hundred genomes by a seeded hash."""
    return panel.sample_genomes(written(fixture.panel(spark, d), "panel"), 100).groupBy("genome_id").agg(F.count("*").alias("n"))


@query(statement("matches", "SELECT * FROM matches"))
def panel_matches(spark, d):
    return _prepared(spark, d, keep=False).matches


@query(statement("deg", "SELECT * FROM deg"))
def degeneracy(spark, d):
    return _prepared(spark, d, keep=False).degeneracy


@query(
    statement(
        "deg",
        """SELECT label, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM deg), 6) AS fraction FROM (SELECT unnest(['1', '2-5', '6-20', '21-100', '101-500', '>500']) AS label, unnest(range(6)) AS b)
        LEFT JOIN (SELECT CASE WHEN d <= 1 THEN 0 WHEN d <= 5 THEN 1 WHEN d <= 20 THEN 2 WHEN d <= 100 THEN 3 WHEN d <= 500 THEN 4 ELSE 5 END AS b, count(*) AS n FROM deg GROUP BY 1) USING (b)""",
    )
)
def degeneracy_histogram(spark, d):
    return _rounded(diagnostics.degeneracy_histogram(_prepared(spark, d, keep=False).degeneracy), "fraction")


# ---- evidence ------------------------------------------------------------------

_METRICS = ("average_score", "effective_count", "weighted_evidence", "unique_weighted_evidence", "effective_count_shared", "weighted_evidence_shared")


@query(statement("metrics", f"SELECT analysis_unit_id, genome_id, n_matched, n_unique, n_shared, {digits(*_METRICS)} FROM metrics"))
def unit_metrics(spark, d):
    return _rounded(_prepared(spark, d).metrics, *_METRICS).select("analysis_unit_id", "genome_id", "n_matched", "n_unique", "n_shared", *_METRICS)


@query(statement("um", "SELECT analysis_unit_id, genome_id, deg_bin, count(*) AS c FROM um WHERE d >= 2 GROUP BY 1, 2, 3"))
def strata_counts(spark, d):
    return evidence.strata_counts(_prepared(spark, d).unit_matches).select("analysis_unit_id", "genome_id", F.col("stratum.deg_bin").alias("deg_bin"), "c")


@query(statement("peptides", "SELECT analysis_unit_id, deg_bin, round(contribution, 6) AS contribution, count(*) AS n FROM unit_peptides JOIN peptides USING (peptide) WHERE d >= 2 GROUP BY 1, 2, 3"))
def knockoff_pools(spark, d):
    p = _prepared(spark, d)
    out = evidence.knockoff_pools(p.unit_peptides, p.peptides).select("analysis_unit_id", F.col("stratum.deg_bin").alias("deg_bin"), F.round("contribution", 6).alias("contribution"), "n")
    return out.groupBy("analysis_unit_id", "deg_bin", "contribution").agg(F.sum("n").alias("n"))


@query(
    statement(
        "um",
        """SELECT s.analysis_unit_id, s.genome_id, round(sum(s.c * p.m), 6) AS null_mean, round(sum(s.c * p.v), 6) AS null_var FROM
        (SELECT analysis_unit_id, genome_id, deg_bin, count(*) AS c FROM um WHERE d >= 2 GROUP BY 1, 2, 3) s JOIN
        (SELECT analysis_unit_id, deg_bin, avg(contribution) AS m, var_pop(contribution) AS v FROM unit_peptides JOIN peptides USING (peptide) WHERE d >= 2 GROUP BY 1, 2) p
        ON p.analysis_unit_id = s.analysis_unit_id AND p.deg_bin = s.deg_bin GROUP BY 1, 2""",
    )
)
def shared_null_moments(spark, d):
    p = _prepared(spark, d)
    return _rounded(evidence.null_moments(evidence.strata_counts(p.unit_matches), evidence.knockoff_pools(p.unit_peptides, p.peptides)), "null_mean", "null_var")


@query(statement("metrics", "SELECT analysis_unit_id, sum(n_unique) AS observed_panel_unique FROM metrics GROUP BY 1"))
def observed_pool_sizes(spark, d):
    return evidence.observed_pool_sizes(_prepared(spark, d).metrics)


@query(
    statement(
        "grid",
        """SELECT g.analysis_unit_id, g.genome_id, g.n_unique, round(log10(greatest(1e-300, least(1.0, CASE WHEN g.n_unique = 0 THEN 1.0 WHEN g.n_unique > least(g.opportunity, s.n) THEN 1e-300 ELSE (SELECT sum(exp(
        lgamma(g.opportunity + 1) - lgamma(x + 1) - lgamma(g.opportunity - x + 1) + lgamma(t.n - g.opportunity + 1) - lgamma(s.n - x + 1) - lgamma(t.n - g.opportunity - s.n + x + 1)
        - lgamma(t.n + 1) + lgamma(s.n + 1) + lgamma(t.n - s.n + 1))) FROM range(g.n_unique, CAST(least(g.opportunity, s.n) + 1 AS BIGINT)) r(x) WHERE t.n - g.opportunity - s.n + x >= 0) END))), 4) AS log_p,
        round(s.n * g.opportunity / t.n, 6) AS expected_unique
        FROM grid g JOIN (SELECT analysis_unit_id, sum(n_unique) AS n FROM metrics GROUP BY 1) s USING (analysis_unit_id), (SELECT sum(opportunity) AS n FROM genomes) t WHERE g.n_matched >= 1""",
    )
)
def hypergeom_p(spark, d):
    p = _prepared(spark, d)
    rows = unique.hypergeometric(score.full_grid(p).where("n_matched >= 1"), evidence.observed_pool_sizes(p.metrics), panel.universe(p.panel))
    return rows.select("analysis_unit_id", "genome_id", "n_unique", F.round(F.log10("pvalue_hypergeometric"), 4).alias("log_p"), F.round("expected_unique", 6).alias("expected_unique"))


@query(statement("alpha", "SELECT analysis_unit_id, genome_id, n_unique, round(log10(pvalue_unique), 6) AS log_p FROM alpha WHERE n_matched >= 1"))
def alpha_unique_p(spark, d):
    rows = unique.alpha_bound(score.full_grid(_prepared(spark, d)).where("n_matched >= 1"), ALPHA)
    return rows.select("analysis_unit_id", "genome_id", "n_unique", F.round(F.log10("pvalue_unique"), 6).alias("log_p"))


_PS = "(0.02 + (n_shared % 40) / 41.0)"


@query(
    statement(
        "alpha",
        f"""SELECT analysis_unit_id, genome_id, {digits('pvalue_simes_closed', 'pvalue_simes_intersection', 'pvalue_combined_harmonic_calibrated', 'pvalue_combined_harmonic', 'pvalue_combined_bonferroni', 'pvalue_combined_fisher', 'pvalue_unique_only')} FROM (
        SELECT analysis_unit_id, genome_id, CASE WHEN n_unique = 0 THEN 1 ELSE least(1, 2 * a, greatest(a, b)) END AS pvalue_simes_closed, least(1, 2 * least(a, b), greatest(a, b)) AS pvalue_simes_intersection,
        CASE WHEN n_unique = 0 THEN 1 ELSE least(1, 4 * a * b / (a + b)) END AS pvalue_combined_harmonic_calibrated, CASE WHEN n_unique = 0 THEN 1 ELSE least(1, 2 * a * b / (a + b)) END AS pvalue_combined_harmonic,
        CASE WHEN n_unique = 0 THEN 1 ELSE least(1, 2 * least(a, b)) END AS pvalue_combined_bonferroni, a * b * (1 - ln(a * b)) AS pvalue_combined_fisher, a AS pvalue_unique_only
        FROM (SELECT *, pvalue_unique AS a, {_PS} AS b FROM alpha WHERE n_matched >= 1))""",
    )
)
def combiners(spark, d):
    rows = unique.alpha_bound(score.full_grid(_prepared(spark, d)).where("n_matched >= 1"), ALPHA)
    cols = S.all_combined(F.col("pvalue_unique"), 0.02 + (F.col("n_shared") % 40) / 41.0, F.col("n_unique"))
    return rows.select("analysis_unit_id", "genome_id", *[F.round(c, 6).alias(k) for k, c in cols.items()])


_RESULT = "analysis_unit_id, genome_id, n_matched, n_unique, n_shared, round(pvalue, 6) AS pvalue, round(qvalue, 6) AS qvalue, presence_rank, pass_q_0_01, pass_q_0_05"


@query(statement("q", "SELECT analysis_unit_id, genome_id, round(pvalue, 6) AS pvalue, round(qvalue, 6) AS qvalue FROM q"))
def bh_q(spark, d):
    p = _prepared(spark, d)
    rows = decide.with_targets(unique.alpha_bound(score.full_grid(p), p.params)).withColumn("pvalue_shared", F.lit(1.0))
    return _rounded(decide.bh(decide.combined(rows, p.params)).select("analysis_unit_id", "genome_id", "pvalue", "qvalue"), "pvalue", "qvalue")


@query(statement("scored", f"SELECT {_RESULT} FROM scored"))
def presence_rank(spark, d):
    _, rows = _scored(spark, d)
    return _rounded(rows.select("analysis_unit_id", "genome_id", "n_matched", "n_unique", "n_shared", "pvalue", "qvalue", "presence_rank", "pass_q_0_01", "pass_q_0_05"), "pvalue", "qvalue")


@query(
    statement(
        "scored",
        """SELECT analysis_unit_id, genome_id FROM (SELECT *, row_number() OVER (PARTITION BY analysis_unit_id ORDER BY n_unique DESC, round(unique_weighted_evidence, 9) DESC, round(weighted_evidence, 9) DESC,
        round(effective_count, 9) DESC, round(n_matched / total_peptide_count, 12) DESC, n_matched DESC, genome_id) AS r FROM grid WHERE n_matched >= 1) WHERE r <= 25""",
    )
)
def knockoff_targets(spark, d):
    rows = score.full_grid(_prepared(spark, d)).withColumns({c: F.round(c, 9) for c in ("unique_weighted_evidence", "weighted_evidence", "effective_count")}).withColumn("match_ratio", F.round("match_ratio", 12))
    return decide.with_targets(rows, 25).where("is_target").select("analysis_unit_id", "genome_id")


# ---- summaries -----------------------------------------------------------------


@query(
    calls("""SELECT genome_id, count(*) AS n_units_tested, count(*) FILTER (n_matched >= 1) AS n_units_matched_ge_1, count(*) FILTER (n_unique > 0) AS n_units_with_unique_evidence,
        count(*) FILTER (qvalue <= 0.05) AS n_units_q_le_0_05, count(*) FILTER (qvalue <= 0.01) AS n_units_q_le_0_01, round(min(qvalue), 6) AS best_qvalue, round(median(qvalue), 6) AS median_qvalue,
        min(presence_rank) AS best_presence_rank, median(presence_rank) AS median_presence_rank, sum(n_unique) AS total_unique_peptides, max(n_unique) AS max_unique_peptides, sum(n_matched) AS total_matched_peptides,
        max(n_matched) AS max_matched_peptides, round(count(*) FILTER (qvalue <= 0.05) / count(*), 6) AS fraction_units_q_le_0_05, round(count(*) FILTER (qvalue <= 0.01) / count(*), 6) AS fraction_units_q_le_0_01,
        max(n_unique * 0.5)::DOUBLE AS max_excess, sum(n_unique * 0.5)::DOUBLE AS total_excess, count(*) FILTER (n_unique * 0.5 >= 3) AS n_units_excess_ge_3
        FROM scored GROUP BY genome_id""",
    )
)
def cohort_summary(spark, d):
    rows = _calls(spark, d)[1].withColumn("excess_count", F.col("n_unique") * 0.5)
    out = summary.cohort_summary(rows)
    return _rounded(out, "best_qvalue", "median_qvalue", "fraction_units_q_le_0_05", "fraction_units_q_le_0_01")


@query(
    calls("""SELECT s.*, (SELECT count(*) FROM mapping m WHERE m.included AND m.analysis_unit_id = s.analysis_unit_id) AS n_samples_in_unit FROM (SELECT analysis_unit_id, count(*) FILTER (pass_q_0_01) AS n_genomes_q_le_0_01, count(*) FILTER (pass_q_0_05) AS n_genomes_q_le_0_05,
        count(*) FILTER (n_matched >= 1) AS n_genomes_matched_ge_1, count(*) FILTER (n_unique >= 3) AS n_genomes_unique_ge_3, round(median(qvalue), 6) AS median_qvalue, round(min(qvalue), 6) AS best_qvalue FROM scored GROUP BY 1) s""",
    )
)
def call_counts(spark, d):
    p, rows = _calls(spark, d)
    return _rounded(summary.call_counts(rows, units.unit_samples(p.mapping)), "median_qvalue", "best_qvalue")


@query(calls("SELECT analysis_unit_id, count(*) FILTER (pass_q_0_01) AS q001_genomes, count(*) FILTER (pass_q_0_05) AS q005_genomes FROM scored GROUP BY 1"))
def threshold_summary(spark, d):
    return summary.threshold_summary(_calls(spark, d)[1])


@query(statement("scored", "SELECT genome_id, " + ", ".join(f"round(max(qvalue) FILTER (analysis_unit_id = 'u{i}'), 6) AS u{i}" for i in range(4)) + " FROM scored GROUP BY genome_id"))
def presence_matrix(spark, d):
    wide = summary.presence_matrix(_scored(spark, d)[1], "qvalue")
    return wide.select("genome_id", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


@query(calls("SELECT genome_id, analysis_unit_id, CAST(pass_q_0_01 AS INT) AS q001, CAST(pass_q_0_05 AS INT) AS q005, round(qvalue, 6) AS qvalue FROM scored"))
def presence_long(spark, d):
    return _rounded(summary.presence_long(_calls(spark, d)[1]), "qvalue")


@query(
    statement(
        "scored",
        """SELECT s.analysis_unit_id, s.genome_id, s.presence_rank, coalesce(n, 0) AS n_new, sum(coalesce(n, 0)) OVER w AS n_covered, sum(coalesce(n, 0)) OVER (PARTITION BY s.analysis_unit_id) AS n_matchable,
        round(100.0 * sum(coalesce(n, 0)) OVER w / sum(coalesce(n, 0)) OVER (PARTITION BY s.analysis_unit_id), 6) AS covered_pct FROM scored s LEFT JOIN (SELECT analysis_unit_id, r, count(*) AS n FROM (
        SELECT um.analysis_unit_id, peptide, min(presence_rank) AS r FROM um JOIN scored x ON x.analysis_unit_id = um.analysis_unit_id AND x.genome_id = um.genome_id GROUP BY 1, 2) GROUP BY 1, 2) c
        ON c.analysis_unit_id = s.analysis_unit_id AND c.r = s.presence_rank WINDOW w AS (PARTITION BY s.analysis_unit_id ORDER BY s.presence_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    )
)
def coverage(spark, d):
    p, rows = _scored(spark, d)
    return _rounded(summary.coverage(rows, p.unit_matches), "covered_pct")


@query(calls("SELECT analysis_unit_id, genome_id, lang || '/' || source AS \"Lineage\", presence_rank, round(qvalue, 6) AS qvalue FROM scored JOIN (SELECT CAST(doc_id AS VARCHAR) AS genome_id, lang, source FROM documents) USING (genome_id) WHERE pass_q_0_05"))
def significant_lists(spark, d):
    return _rounded(summary.compact_list(_calls(spark, d)[1], "pass_q_0_05", readers.lineage_columns(fixture.lineage(spark, d))), "qvalue")


@query(calls("SELECT genome_id, count(*) FILTER (pass_q_0_05) AS n_called, count(*) FILTER (pass_q_0_01) AS n_q001, round(min(qvalue), 6) AS best_qvalue, sum(n_unique) AS total_unique FROM scored GROUP BY 1 HAVING count(*) FILTER (pass_q_0_05) > 0"))
def called_anywhere(spark, d):
    return _rounded(summary.called_anywhere(_calls(spark, d)[1]), "best_qvalue")


@query(statement("scored", "SELECT count(*) FILTER (n_matched < 0 OR n_unique < 0 OR n_shared < 0) AS negative_counts, count(*) FILTER (n_unique > n_matched) AS unique_above_matched, count(*) FILTER (pass_q_0_01 AND NOT pass_q_0_05) AS q001_not_in_q005, count(*) FILTER (qvalue < 0 OR qvalue > 1) AS q_outside FROM scored"))
def result_violations(spark, d):
    return summary.violations(_scored(spark, d)[1])


@query(
    calls("""SELECT m.analysis_unit_id, string_agg(DISTINCT m.sample_id, ',' ORDER BY m.sample_id) AS samples, count(DISTINCT m.sample_id) AS n_samples,
        coalesce((SELECT string_agg(s.genome_id, ',' ORDER BY s.genome_id) FROM scored s WHERE s.analysis_unit_id = m.analysis_unit_id AND s.pass_q_0_05), '') AS genomes_q005,
        coalesce((SELECT string_agg(s.genome_id, ',' ORDER BY s.genome_id) FROM scored s WHERE s.analysis_unit_id = m.analysis_unit_id AND s.pass_q_0_01), '') AS genomes_q001
        FROM mapping m WHERE m.included GROUP BY m.analysis_unit_id""",
    )
)
def manifest_units(spark, d):
    p, rows = _calls(spark, d)
    found = written(manifest.members(p.mapping, rows), "selection")
    return _by_unit(manifest.check(found, manifest.declared(found)), manifest.declared(found))


def _by_unit(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Members as one row a unit, for comparison with SQL."""
    def listed(kind):
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("id")))), ",")

    lists = rows.groupBy("analysis_unit_id").agg(listed("sample").alias("samples"), listed("q005").alias("genomes_q005"), listed("q001").alias("genomes_q001"))
    return lists.join(selected.select("analysis_unit_id", "n_samples"), "analysis_unit_id")


@query(
    calls("""SELECT count(DISTINCT analysis_unit_id) AS n_units, count(DISTINCT genome_id) AS n_genomes, count(*) AS n_tests, count(*) FILTER (n_matched >= 1) AS n_matched_tests, count(*) FILTER (pass_q_0_01) AS n_calls_q001,
        count(*) FILTER (pass_q_0_05) AS n_calls_q005, count(DISTINCT genome_id) FILTER (pass_q_0_01) AS n_union_q001, count(DISTINCT genome_id) FILTER (pass_q_0_05) AS n_union_q005 FROM scored""",
    )
)
def run_summary(spark, d):
    return diagnostics.run_summary(_calls(spark, d)[1])


@query(calls("SELECT t AS threshold, (SELECT count(*) FROM scored WHERE n_matched >= 1 AND qvalue <= t) AS n_calls FROM (SELECT unnest([0.001::DOUBLE, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]) AS t)"))
def calling_curve(spark, d):
    return diagnostics.calling_curve(_calls(spark, d)[1])


@query(
    statement(
        "scored",
        """SELECT um.analysis_unit_id, um.genome_id, presence_rank, peptide, d, deg_bin, round(score, 6) AS score, round(weight, 6) AS weight, round(contribution, 6) AS contribution, d = 1 AS is_unique
        FROM um JOIN scored s ON s.analysis_unit_id = um.analysis_unit_id AND s.genome_id = um.genome_id WHERE presence_rank <= 20 AND s.n_matched >= 1""",
    )
)
def peptide_contributions(spark, d):
    p, rows = _scored(spark, d)
    return _rounded(diagnostics.contributions(rows, p.unit_matches), "score", "weight", "contribution")


# ---- empirical background ------------------------------------------------------


def _active(p: score.Prepared) -> DataFrame:
    rows = score.full_grid(p).where("n_matched >= 1")
    return written(rows.withColumns({c: F.round(c, 9) for c in ("unique_weighted_evidence", "weighted_evidence")}), "active")


@query(statement("binned", "SELECT analysis_unit_id, genome_id, in_background, CAST(bin AS INT) AS bin FROM binned"))
def opportunity_bins(spark, d):
    rows = background.split_background(_active(_prepared(spark, d)), F.lit(0.05))
    return background.with_bins(rows, 4, ALPHA).select("analysis_unit_id", "genome_id", "in_background", "bin")


@query(
    statement(
        "loo_unit",
        """SELECT a.analysis_unit_id, a.genome_id, CAST(a.bin AS INT) AS bin, x.size AS background_size, round((1.0 + x.ge) / (1.0 + x.size), 6) AS p_tail,
        round(CASE WHEN x.size > 0 THEN x.le / x.size ELSE 0 END, 6) AS tail_percentile, round(CASE WHEN x.size > 0 THEN x.sum / x.size ELSE 0 END, 6) AS expected_unique_null,
        round(coalesce((SELECT quantile_cont(u, 0.95) FROM (SELECT CAST(n_unique AS DOUBLE) AS u FROM binned b WHERE b.in_background AND b.analysis_unit_id = a.analysis_unit_id AND (b.bin = a.bin OR l.size <= 0) AND b.genome_id <> a.genome_id)), 0), 6) AS background_threshold
        FROM binned a JOIN loo_bin l ON l.analysis_unit_id = a.analysis_unit_id AND l.bin = a.bin AND l.n_unique = a.n_unique AND l.in_background = a.in_background
        JOIN loo_unit w ON w.analysis_unit_id = a.analysis_unit_id AND w.n_unique = a.n_unique AND w.in_background = a.in_background
        CROSS JOIN LATERAL (SELECT CASE WHEN l.size > 0 THEN l.size ELSE w.size END AS size, CASE WHEN l.size > 0 THEN l.ge ELSE w.ge END AS ge, CASE WHEN l.size > 0 THEN l.le ELSE w.le END AS le, CASE WHEN l.size > 0 THEN l.sum ELSE w.sum END AS sum) x""",
    )
)
def background_loo(spark, d):
    out = background.background_stats(_active(_prepared(spark, d)), F.lit(0.05), 4, ALPHA)
    cols = ("p_tail", "tail_percentile", "expected_unique_null", "background_threshold")
    return _rounded(out.select("analysis_unit_id", "genome_id", "bin", "background_size", *cols), *cols)


@query(
    empirical(
        """SELECT analysis_unit_id, genome_id, in_background, round(p_tail, 6) AS empirical_tail, round(ln(CASE WHEN excess > 0 THEN greatest(pow(0.05, excess), 1e-300) ELSE 1.0 END), 5) AS log_alpha_excess,
        round(resolution, 6) AS min_attainable_p FROM testedx"""
    )
)
def empirical_p(spark, d):
    """The formal p of both methods, and the least that tails can reach."""
    found = background.background_stats(_active(_prepared(spark, d)), F.lit(0.05), 4, ALPHA)
    # one pass carries the p of either method; clipped as pvalue_unique is
    picked = found.select("analysis_unit_id", "genome_id", "in_background", F.col("p_tail").alias("empirical_tail"), "min_attainable_p", F.round(F.ln("alpha_excess_index"), 5).alias("log_alpha_excess"))
    return _rounded(picked, "empirical_tail", "min_attainable_p")


_EDGES = ", ".join(f"quantile_cont(CAST(opportunity AS DOUBLE), [{', '.join(str(i / k) for i in range(k + 1))}]) AS q{k}" for k in range(2, 9))


@query(
    statement(
        "genomes",
        f"""SELECT sum(n) AS candidates, count(*) AS effective_bins, coalesce(sum(n) FILTER (n >= 101), 0) AS adequate, min(n) - 1 AS min_comparable, max(n) - 1 AS max_comparable,
        round(coalesce(sum(n) FILTER (n >= 101), 0) / sum(n), 6) AS adequate_fraction, coalesce(sum(n) FILTER (n >= 101), 0) / sum(n) >= 0.9 AS eligible FROM (
        SELECT len(list_filter(e, lambda x: x > list_min(e) AND x < list_max(e) AND x < opportunity)) AS bin, count(*) AS n FROM genomes,
        (SELECT list_distinct(list_transform(CASE k {' '.join(f'WHEN {k} THEN q{k}' for k in range(2, 9))} ELSE [0.0] END, lambda x: round(x, 9))) AS e FROM
        (SELECT {_EDGES}, least(greatest(1, least(8, count(*) // 101)), count(DISTINCT opportunity)) AS k FROM genomes)) GROUP BY 1)""",
    )
)
def auto_eligibility(spark, d):
    genomes = panel.opportunity(fixture.panel(spark, d))
    return _rounded(background.eligibility(genomes, ScoreParams()), "adequate_fraction")


def _calibrated(spark, d):
    p = _prepared(spark, d)
    rows = background.by_strength(decide.with_targets(_active(p)).withColumn("pvalue_shared", F.lit(1.0)))
    judged, trace = background.calibrate(rows, 4, p.params)
    return rows, judged, trace, written(background.calibration_report(judged, trace, p.params), "calibration")


_STEPS = " UNION ALL ".join(f"SELECT analysis_unit_id, {i} AS iteration, f, share, new FROM step{i} WHERE NOT done" for i in (1, 2, 3))
_UNITS = f"""(SELECT t.*, j.*, s.f AS final, s.share AS next, s.f >= 0.2 - 1e-12 AS cap_reached, s.share > 0.2 + 1e-12 AS update_above_cap FROM
(SELECT analysis_unit_id AS unit, count(*) AS iteration_count, max(f) FILTER (iteration = 1) AS initial, arg_max(abs(new - f), iteration) < 0.01 AS converged FROM ({_STEPS}) GROUP BY 1) t
JOIN (SELECT analysis_unit_id, count(*) AS active, count(*) FILTER (in_background) AS background, count(DISTINCT bin) AS bins, min(resolution) AS resolution,
  quantile_cont(n_unique, [0.5, 0.9, 0.95, 0.99]) FILTER (in_background) AS qs FROM judged9 GROUP BY 1) j ON j.analysis_unit_id = t.unit JOIN share9 s ON s.analysis_unit_id = t.unit)"""
_BINS = f"""(SELECT b.*, u.cap_reached AND (b.candidate_fraction > 0.2 + 1e-12 OR NOT u.converged) AS cap_pressure FROM (SELECT analysis_unit_id, bin, count(*) AS active_genomes,
count(*) FILTER (in_background) AS background_genomes, quantile_cont(n_unique, [0.5, 0.9, 0.95, 0.99]) FILTER (in_background) AS qs, min(resolution) AS min_p_resolution,
min(n_unique) AS min_unique, max(n_unique) AS max_unique, count(*) FILTER (q <= 0.2) AS candidates, count(*) FILTER (q <= 0.2) / count(*) AS candidate_fraction FROM judged9 GROUP BY 1, 2) b
JOIN {_UNITS} u ON u.unit = b.analysis_unit_id)"""
_QS = ", ".join(f"round(coalesce(qs[{i}], 0), 6) AS background_unique_q{n}" for i, n in enumerate((50, 90, 95, 99), 1))
_FRACTIONS = ("initial_exclusion_fraction", "final_exclusion_fraction", "next_requested_fraction", "min_p_resolution", "affected_fraction", "adequate_fraction")


_REPORT = f"""SELECT unit AS analysis_unit_id, iteration_count, round(initial, 6) AS initial_exclusion_fraction, round(final, 6) AS final_exclusion_fraction, round(next, 6) AS next_requested_fraction,
    active AS active_genomes, background AS background_size, bins AS bin_count, round(resolution, 6) AS min_p_resolution, {_QS},
    CAST(active - least(ceil(active * initial), active - 1) AS BIGINT) AS initial_background_size, 0.2::DOUBLE AS exclusion_fraction_cap, cap_reached, update_above_cap, converged,
    round(affected, 6) AS affected_fraction, round(1 - affected, 6) AS adequate_fraction, NOT (cap_reached AND (update_above_cap OR NOT converged) AND affected + 1e-12 >= 0.9) AS suitable
    FROM {_UNITS} JOIN (SELECT analysis_unit_id AS u, coalesce(sum(active_genomes) FILTER (cap_pressure), 0) / sum(active_genomes) AS affected FROM {_BINS} GROUP BY 1) ON u = unit"""


@query(calibration(_REPORT))
def calibration_trace(spark, d):
    report = _calibrated(spark, d)[3].drop("iteration_trace", "reason").withColumn("initial_background_size", F.col("initial_background_size").cast("long"))
    return _rounded(report, *_FRACTIONS, *[f"background_unique_q{n}" for n in (50, 90, 95, 99)])


@query(calibration(f"SELECT analysis_unit_id, CAST(iteration AS INT) AS iteration, round(f, 6) AS exclude_fraction, round(share, 6) AS candidate_fraction, round(new, 6) AS new_fraction FROM ({_STEPS} UNION ALL SELECT analysis_unit_id, NULL, f, share, f FROM share9)"))
def calibration_steps(spark, d):
    """Each pass of the calibration and, without a number, the last one."""
    return _rounded(_calibrated(spark, d)[2], "exclude_fraction", "candidate_fraction", "new_fraction")


_BIN_ROWS = f"""SELECT b.analysis_unit_id, CAST(b.bin AS INT) AS bin, active_genomes, background_genomes, round(min_p_resolution, 6) AS min_p_resolution, min_unique, max_unique, candidates, {_QS},
    coalesce(i.n, 0) AS initial_background_genomes, round(candidate_fraction, 6) AS candidate_fraction, u.cap_reached, u.converged, cap_pressure
    FROM {_BINS} b JOIN (SELECT unit, cap_reached, converged FROM {_UNITS}) u ON u.unit = b.analysis_unit_id
    LEFT JOIN (SELECT analysis_unit_id, bin, count(*) FILTER (in_background) AS n FROM binned1 GROUP BY 1, 2) i ON i.analysis_unit_id = b.analysis_unit_id AND i.bin = b.bin"""


@query(calibration(_BIN_ROWS))
def bin_diagnostics(spark, d):
    rows, judged, _, report = _calibrated(spark, d)
    out = background.bin_report(judged, ALPHA, background.first_bins(rows, 4, ALPHA), report)
    return _rounded(out, "min_p_resolution", "candidate_fraction", *[f"background_unique_q{n}" for n in (50, 90, 95, 99)])


@query(
    calibration(
        f"""SELECT 'calibration' AS name, analysis_unit_id, NULL::INT AS bin, iteration_count AS passes, active_genomes AS active, background_size AS background, suitable AS flag FROM ({_REPORT})
        UNION ALL SELECT 'bin_diagnostics', analysis_unit_id, bin, NULL, active_genomes, background_genomes, cap_pressure FROM ({_BIN_ROWS})"""
    )
)
def calibration_files(spark, d):
    """The tables of a calibration, written as text and read again; the passes
    are those of the trace in the file."""
    rows, judged, _, report = _calibrated(spark, d)
    path = new_path(spark, "calibration-files")
    sinks.write_tables({"calibration": report, "bin_diagnostics": background.bin_report(judged, ALPHA, background.first_bins(rows, 4, ALPHA), report)}, path, "tsv")
    of_units, of_bins = (spark.read.csv(f"{path}/{t}", sep="\t", header=True) for t in ("calibration", "bin_diagnostics"))
    passes = F.size(F.from_json("iteration_trace", "array<string>"))

    def picked(table, name, bin_of, n, background_of, flag):
        fixed = [F.lit(name).alias("name"), "analysis_unit_id", bin_of.cast("int").alias("bin"), n.cast("int").alias("passes")]
        return table.select(*fixed, *[F.col(c).cast("long").alias(k) for c, k in (("active_genomes", "active"), (background_of, "background"))], F.col(flag).cast("boolean").alias("flag"))

    none = F.lit(None)
    return picked(of_units, "calibration", none, passes, "background_size", "suitable").union(picked(of_bins, "bin_diagnostics", F.col("bin"), none, "background_genomes", "cap_pressure"))


@query(diagnosed("SELECT analysis_unit_id, genome_id, CAST(bin AS INT) AS bin, size AS background_size, round(threshold::DOUBLE, 6) AS background_threshold, round(excess::DOUBLE, 6) AS excess_count, round(p_tail, 6) AS p_tail FROM testedd"))
def alpha_background_diagnostics(spark, d):
    p, rows = _scored(spark, d)
    out = background.alpha_mode_diagnostics(rows.withColumns({c: F.round(c, 9) for c in ("unique_weighted_evidence", "weighted_evidence")}).where("n_matched >= 1"), 4, p.params)
    return _rounded(out.select("analysis_unit_id", "genome_id", "bin", "background_size", "background_threshold", "excess_count", "p_tail"), "background_threshold", "excess_count", "p_tail")


# ---- shared evidence and the whole program -------------------------------------


def _whole(spark, d, params: ScoreParams = ALPHA) -> score.ScoreResult:
    return score.score(fixture.observed(spark, d), fixture.panel(spark, d), params, _meta(spark, d))


_P_EDGES = "[0.0, 1e-6, 1e-4, 1e-3, 1e-2, 5e-2, 0.1, 0.2, 0.5, 1.0]::DOUBLE[]"
_NULL = ("pvalue_shared", "null_mean", "null_sd", "null_q95", "null_q99", "z_shared")


@query(
    whole_run(
        f"""SELECT g.analysis_unit_id, g.genome_id, g.n_shared, round(coalesce(pvalue_shared, 1.0), 6) AS pvalue_shared, {', '.join(f'round(coalesce({c}, 0.0), 5) AS {c}' for c in _NULL[1:5])},
        CASE WHEN null_sd > 1e-9 THEN round(z_shared, 5) + 0.0 ELSE 0.0 END AS z_shared
        FROM grid g LEFT JOIN null2 k ON k.analysis_unit_id = g.analysis_unit_id AND k.genome_id = g.genome_id WHERE n_matched >= 1"""
    )
)
def knockoff_p(spark, d):
    """Both Monte Carlo stages: the second's draws go on after the first's. The
    distance from a null without spread is rounding only, so 0 is given."""
    rows = _whole(spark, d).unit_genome.where("n_matched >= 1")
    z = F.when(F.col("null_sd") > 1e-9, F.round("z_shared", 5) + 0.0).otherwise(0.0)
    return _rounded(rows, "pvalue_shared").select("analysis_unit_id", "genome_id", "n_shared", "pvalue_shared", *[F.round(c, 5).alias(c) for c in _NULL[1:5]], z.alias("z_shared"))


@query(
    whole_run(
        f"""SELECT pool, CAST(bin AS INT) AS bin, e[bin + 1] AS above, e[bin + 2] AS upto, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY pool), 6) AS fraction
        FROM (SELECT * FROM (SELECT unnest(['all', 'unique_0']) AS pool) CROSS JOIN (SELECT unnest(range(9)) AS bin, {_P_EDGES} AS e)) LEFT JOIN
        (SELECT pool, greatest(len(list_filter({_P_EDGES}, lambda x: x < p)) - 1, 0) AS bin, count(*) AS n FROM
        (SELECT unnest(CASE WHEN n_unique = 0 THEN ['all', 'unique_0'] ELSE ['all'] END) AS pool, pvalue_shared AS p FROM scored WHERE n_matched >= 1) GROUP BY 1, 2) h USING (pool, bin)"""
    )
)
def shared_p_histogram(spark, d):
    """Of the p-values that the draws gave."""
    return _rounded(diagnostics.shared_p_histogram(_whole(spark, d).unit_genome), "fraction")


@query()
def presence_full(spark, d):
    """The whole program in its default mode, over one cohort-wide unit."""
    lineage = readers.lineage_columns(fixture.lineage(spark, d))
    return score.score(fixture.observed(spark, d), fixture.panel(spark, d), ScoreParams(), lineage=lineage).unit_genome


_FULL = ("pvalue_shared", "pvalue", "qvalue")


@query(whole_run(f"SELECT analysis_unit_id, genome_id, n_matched, n_unique, n_shared, round(log10(pvalue_unique), 6) AS log_p_unique, {digits(*_FULL)}, presence_rank, pass_q_0_01, pass_q_0_05 FROM scored"))
def full_presence_rank(spark, d):
    """Both kinds of evidence, both Monte Carlo stages, units of the metadata."""
    rows = _rounded(_whole(spark, d).unit_genome, *_FULL).withColumn("log_p_unique", F.round(F.log10("pvalue_unique"), 6))
    return rows.select("analysis_unit_id", "genome_id", "n_matched", "n_unique", "n_shared", "log_p_unique", *_FULL, "presence_rank", "pass_q_0_01", "pass_q_0_05")


@query(
    whole_run(
        """SELECT genome_id, count(*) AS n_units_tested, count(*) FILTER (n_matched >= 1) AS n_units_matched_ge_1, count(*) FILTER (n_unique > 0) AS n_units_with_unique_evidence,
        count(*) FILTER (qvalue <= 0.05) AS n_units_q_le_0_05, count(*) FILTER (qvalue <= 0.01) AS n_units_q_le_0_01, round(min(qvalue), 6) AS best_qvalue, round(median(qvalue), 6) AS median_qvalue,
        min(presence_rank) AS best_presence_rank, median(presence_rank) AS median_presence_rank, sum(n_unique) AS total_unique_peptides, max(n_unique) AS max_unique_peptides, sum(n_matched) AS total_matched_peptides,
        max(n_matched) AS max_matched_peptides, round(count(*) FILTER (qvalue <= 0.05) / count(*), 6) AS fraction_units_q_le_0_05, round(count(*) FILTER (qvalue <= 0.01) / count(*), 6) AS fraction_units_q_le_0_01
        FROM scored GROUP BY genome_id""",
        CALLING_ALPHA,
    )
)
def full_cohort_summary(spark, d):
    """The cohort summary of a whole run."""
    out = _whole(spark, d, CALLING).tables()["cohort_genome_summary"].drop("max_excess", "total_excess", "n_units_excess_ge_3")
    return _rounded(out, "best_qvalue", "median_qvalue", "fraction_units_q_le_0_05", "fraction_units_q_le_0_01")


# ---- further parts of the evidence and the results -----------------------------


@query(statement("scored", "SELECT analysis_unit_id, genome_id, round(greatest(0, -log10(greatest(least(qvalue, 1.0), 1e-300))), 6) AS presence_score FROM scored"))
def presence_scores(spark, d):
    return _rounded(_scored(spark, d)[1].select("analysis_unit_id", "genome_id", "presence_score"), "presence_score")


@query(
    statement(
        "grid",
        """SELECT analysis_unit_id, genome_id, round(CASE WHEN n_unique > 0 THEN least(n_unique, pow(n_unique, 0.5)) ELSE 0 END, 6) AS unique_effective_count,
        round(CASE WHEN n_unique > 0 THEN greatest(ln(0.05) * least(n_unique, pow(n_unique, 0.5)), ln(1e-300)) ELSE 0 END, 6) AS log_p FROM grid WHERE n_matched >= 1""",
    )
)
def tempered_counts(spark, d):
    rows = unique.alpha_bound(score.full_grid(_prepared(spark, d)).where("n_matched >= 1"), score.with_mode(ALPHA, unique_count_power=0.5))
    return _rounded(rows.select("analysis_unit_id", "genome_id", "unique_effective_count", F.ln("pvalue_unique").alias("log_p")), "unique_effective_count", "log_p")


@query(
    statement(
        "um",
        """SELECT g.analysis_unit_id, g.genome_id, g.n_unique, round(greatest(coalesce(e.s, 0), ln(1e-300)), 4) AS log_p FROM
        (SELECT analysis_unit_id, genome_id, count(*) FILTER (d = 1) AS n_unique FROM um GROUP BY 1, 2) g LEFT JOIN
        (SELECT analysis_unit_id, genome_id, sum(ln(error)) AS s FROM um JOIN (SELECT peptide, error FROM scores) USING (peptide) WHERE d = 1 GROUP BY 1, 2) e
        ON e.analysis_unit_id = g.analysis_unit_id AND e.genome_id = g.genome_id""",
    )
)
def error_bound_p(spark, d):
    params = score.with_mode(ALPHA, error_source="peptide-error-column")
    rows = unique.alpha_bound(score.full_grid(_prepared(spark, d, params)).where("n_matched >= 1"), params)
    return rows.select("analysis_unit_id", "genome_id", "n_unique", F.round(F.ln("pvalue_unique"), 4).alias("log_p"))


@query(statement("scored", "SELECT analysis_unit_id, genome_id FROM scored WHERE n_matched >= 1 AND (pvalue BETWEEN 0.01 AND 0.1 OR pvalue BETWEEN 0.0001 AND 0.006)"))
def refined_targets(spark, d):
    """Ranges may be given in any order of their ends."""
    rows = _scored(spark, d)[1]
    return rows.where("n_matched >= 1").where(S.in_any_range(F.col("pvalue"), ((0.1, 0.01), (0.0001, 0.006)))).select("analysis_unit_id", "genome_id")


@query(
    statement(
        "um",
        """SELECT analysis_unit_id, genome_id, deg_bin, CASE WHEN length(peptide) <= 7 THEN 0 WHEN length(peptide) <= 10 THEN 1 WHEN length(peptide) <= 14 THEN 2 WHEN length(peptide) <= 20 THEN 3 WHEN length(peptide) <= 30 THEN 4 ELSE 5 END AS len_bin,
        count(*) AS c FROM um WHERE d >= 2 GROUP BY 1, 2, 3, 4""",
    )
)
def length_strata(spark, d):
    p = _prepared(spark, d, score.with_mode(ALPHA, use_length_strata=True))
    return evidence.strata_counts(p.unit_matches).select("analysis_unit_id", "genome_id", "stratum.deg_bin", "stratum.len_bin", "c")


@query(
    statement(
        "grid",
        f"""SELECT pool, CAST(bin AS INT) AS bin, e[bin + 1] AS above, e[bin + 2] AS upto, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY pool), 6) AS fraction
        FROM (SELECT * FROM (SELECT unnest(['all', 'unique_0']) AS pool) CROSS JOIN (SELECT unnest(range(9)) AS bin, {_P_EDGES} AS e)) LEFT JOIN
        (SELECT pool, greatest(len(list_filter({_P_EDGES}, lambda x: x < p)) - 1, 0) AS bin, count(*) AS n FROM
        (SELECT unnest(CASE WHEN n_unique = 0 THEN ['all', 'unique_0'] ELSE ['all'] END) AS pool, pow(0.3, n_shared) AS p FROM grid WHERE n_matched >= 1) GROUP BY 1, 2) h USING (pool, bin)""",
    )
)
def p_histogram(spark, d):
    rows = score.full_grid(_prepared(spark, d)).withColumn("pvalue_shared", F.pow(F.lit(0.3), F.col("n_shared")))
    return _rounded(diagnostics.shared_p_histogram(rows), "fraction")


@query(calls("SELECT genome_id, " + ", ".join(f"CAST(coalesce(max(CAST(pass_q_0_05 AS INT)) FILTER (analysis_unit_id = 'u{i}'), 0) AS INT) AS u{i}" for i in range(4)) + " FROM scored GROUP BY genome_id HAVING bool_or(pass_q_0_05)"))
def presence_flags(spark, d):
    return summary.presence_matrix(_calls(spark, d)[1], "q005")


_UNION = "SELECT genome_id, count(*) FILTER (qvalue <= 0.05) AS n_units_q_le_0_05, count(*) FILTER (qvalue <= 0.01) AS n_units_q_le_0_01, round(min(qvalue), 6) AS best_qvalue, sum(n_unique) AS total_unique_peptides FROM scored GROUP BY 1"


@query(calls(f"SELECT 'q001' AS level, * FROM ({_UNION}) WHERE n_units_q_le_0_01 >= 1 UNION ALL SELECT 'q005', * FROM ({_UNION}) WHERE n_units_q_le_0_05 >= 1"))
def genome_unions(spark, d):
    cohort = summary.cohort_summary(_calls(spark, d)[1])
    wide = summary.union_of_calls(cohort, "0_05")
    narrow = summary.require_nested(summary.union_of_calls(cohort, "0_01"), wide)
    both = narrow.withColumn("level", F.lit("q001")).union(wide.withColumn("level", F.lit("q005")))
    return _rounded(both.select("level", "genome_id", "n_units_q_le_0_05", "n_units_q_le_0_01", "best_qvalue", "total_unique_peptides"), "best_qvalue")


_COUNTS = {
    "unit_genome_results": "scored", "unit_genome_results_full": "scored", "coverage": "scored", "cohort_genome_summary": "genomes", "sample_unit_mapping": "mapping",
    "unit_call_counts": "(SELECT DISTINCT analysis_unit_id FROM scored)", "unit_threshold_summary": "(SELECT DISTINCT analysis_unit_id FROM scored)",
    **{f"{t}_q{l}": f"(SELECT * FROM scored WHERE pass_q_0_{l[1:]})" for t in ("unit_genome_list",) for l in ("001", "005")},
    **{f"unit_q{l}_genomes": f"(SELECT * FROM scored WHERE pass_q_0_{l[1:]})" for l in ("001", "005")},
    **{f"genome_union_q{l}": f"(SELECT DISTINCT genome_id FROM scored WHERE pass_q_0_{l[1:]})" for l in ("001", "005")},
    **{f"genome_by_unit_q{l}_matrix": f"(SELECT DISTINCT genome_id FROM scored WHERE pass_q_0_{l[1:]})" for l in ("001", "005")},
    "genome_by_unit_qvalue_matrix": "genomes",
}


@query(calls(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {t}" for k, t in _COUNTS.items())))
def result_files(spark, d):
    """All tables of a run, written as text and read again."""
    p, rows = _calls(spark, d)
    path = new_path(spark, "results")
    sinks.write_tables(score.ScoreResult(p, rows, "alpha-upper-bound").tables(derived=True), path, "tsv")
    found = [spark.read.csv(f"{path}/{name}", sep="\t", header=True).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in _COUNTS]
    return reduce(DataFrame.union, found)


@query(calls("SELECT 0.003::DOUBLE AS alpha, 'metadata' AS unit_mode, count(*) AS n_tests, count(*) FILTER (pass_q_0_05) AS n_calls_q005, count(DISTINCT genome_id) FILTER (pass_q_0_05) AS n_union_q005 FROM scored"))
def run_document(spark, d):
    """The run as JSON, written and read again."""
    p, rows = _calls(spark, d)
    path = new_path(spark, "run-summary")
    sinks.write_manifest(score.ScoreResult(p, rows, "alpha-upper-bound").run_document(), path)
    shape = "struct<parameters:struct<alpha:double,unit_mode:string>,results:struct<n_tests:bigint,n_calls_q005:bigint,n_union_q005:bigint>>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j")).select("j.parameters.*", "j.results.*")


# ---- sources and sinks, written and read again ---------------------------------

_OBSERVED = "'c' || conv_id || '.raw' AS sample, CASE WHEN f NOT IN ('NA', 'NULL') THEN f END AS sequence"
_MARKED = "(length(f) % 8) / 8.0 AS score, ((conv_id * 7 + turn * 13) % 100) / 1000.0 AS error, CASE WHEN role = 'system' THEN 'true' ELSE 'false' END AS decoy"


def _as_text(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.write.csv(path, sep="\t", header=True)
    return path


@query(statement("frag_o", f"SELECT {_OBSERVED}, CASE WHEN length(f) % 5 > 0 AND length(f) % 7 > 0 THEN CAST(length(f) * (turn + 1) AS DOUBLE) END AS intensity, {_MARKED} FROM frag_o WHERE f <> ''"))
def delimited_scan(spark, d):
    """Other column names, marks of missing values, numbers that are none."""
    n = F.length("`Stripped.Sequence`")
    raw = fixture.observed(spark, d)
    odd = F.when(n % 5 == 0, F.lit("#N/A")).when(n % 7 == 0, F.lit("1e")).otherwise(F.col("`Precursor.Quantity`").cast("string"))
    renamed = {"Run": "file_name", "Stripped.Sequence": "peptide sequence", "Evidence": "CSCORE", "Q.Value": "fdr", "Decoy": "target_decoy"}
    table = raw.select(*[F.col(f"`{a}`").alias(b) for a, b in renamed.items()], odd.alias("INTENSITY"), F.lit("x").alias("Other"))
    return readers.observed_columns(readers.read_table(spark, _as_text(table, "observed-text")), "metadata")


@query(statement("frag_o", "SELECT 'c' || conv_id || '.raw' AS sample, f AS sequence, CAST(length(f) * (turn + 1) AS DOUBLE) AS intensity, (length(f) % 8) / 8.0 AS score, ((conv_id * 7 + turn * 13) % 100) / 1000.0 AS error, CASE WHEN role = 'system' THEN 'True' ELSE 'False' END AS decoy FROM frag_o WHERE f <> ''"))
def parquet_scan(spark, d):
    """A report as Parquet, decoys as truth values, with columns of no use."""
    path = new_path(spark, "observed") + ".parquet"
    fixture.observed(spark, d).withColumns({"Decoy": F.col("Decoy") == "true", "Protein.Ids": F.lit("x")}).write.parquet(path)
    return readers.observed_columns(readers.read_table(spark, path), "metadata")


@query("SELECT 'g' || (doc_id % 50) AS genome_id, doc_id % 50 % 7 <> 0 AS fasta, CASE WHEN doc_id % 50 % 7 <> 0 THEN count(*) ELSE 0 END AS n_records FROM documents GROUP BY doc_id % 50")
def fasta_directory(spark, d):
    """A file a genome, of which some are no FASTA: all are listed."""
    rows = fixture.proteins(spark, d).withColumn("plain", F.substring("genome_id", 2, 9).cast("int") % 7 == 0)
    line = F.when(F.col("plain"), F.concat(F.lit("notes on "), "header")).otherwise(F.concat(F.lit(">"), "header", F.lit("\n"), "sequence"))
    path = new_path(spark, "fasta-directory")
    rows.select("genome_id", line.alias("value")).repartition(8, "genome_id").write.partitionBy("genome_id").text(path)
    return readers.fasta_files(spark, path).select(F.regexp_extract("file", "genome_id=([^/]+)/", 1).alias("genome_id"), "fasta", "n_records")


@query(
    _DIGEST
    + """, g AS (SELECT genome_id, CAST(substr(genome_id, 2) AS INT) AS k, count(*) AS n FROM (SELECT genome_id, unnest(parts) AS peptide FROM f) WHERE length(peptide) BETWEEN 7 AND 30 GROUP BY 1)
    SELECT genome_id, 'no peptides' AS problem, least(n, 200) AS n FROM g WHERE k % 7 = 1 UNION ALL SELECT genome_id, 'two places', 2 FROM g WHERE k % 5 = 0"""
)
def panel_problems(spark, d):
    """Digests in two folders: genomes in both, and files by position whose
    first column holds something else."""
    rows = written(digestion.digest(fixture.proteins(spark, d)), "digest").withColumn("k", F.substring("genome_id", 2, 9).cast("int"))
    one, two = new_path(spark, "panel-one"), new_path(spark, "panel-two")
    digestion.write_digest(rows.where("k % 7 <> 1").repartition(4, "genome_id"), one)
    digestion.write_digest(rows.where("k % 5 = 0 AND k % 7 <> 1").repartition(4, "genome_id"), two)
    odd = rows.where("k % 7 = 1").select("genome_id", "k", F.concat(F.lit("no "), "peptide").alias("Name")).repartition(4, "genome_id")
    odd.drop("k").write.mode("append").partitionBy("genome_id").csv(two, sep="\t", header=True)
    # the other copy has a named column
    digestion.write_digest(rows.where("k % 7 = 1 AND k % 5 = 0").repartition(4, "genome_id"), one)
    return readers.panel_problems(readers.panel_lines(spark, [one, two]))


@query(statement("target", " UNION ALL ".join(f"SELECT {c}::DOUBLE AS cutoff, count(*) AS n_rows, count(*) FILTER (error <= {c}) AS n_valid, count(DISTINCT sample_id) FILTER (error <= {c}) AS n_samples, count(*) FILTER (error <= {c}) = 0 AS empty FROM target" for c in (-0.5, 0.0, 0.02))))
def left_after_filters(spark, d):
    """What error cutoffs leave: nothing to score is reported as such."""
    rows = _rows(spark, d)
    found = [observed.left_after_filters(rows, score.with_mode(ALPHA, error_cutoff=c)).withColumn("cutoff", F.lit(c)) for c in (-0.5, 0.0, 0.02)]
    return reduce(DataFrame.unionByName, found)


_BAD_META = "CASE WHEN conv_id % 11 = 0 THEN '' ELSE 'c' || conv_id END AS sample_id, CASE WHEN conv_id % 7 = 0 THEN '' ELSE 'u' || (conv_id % 4) END AS unit, conv_id % 17 <> 0 AS included"


@query(
    f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations), m AS (SELECT {_BAD_META} FROM c UNION ALL SELECT {_BAD_META} FROM c WHERE conv_id % 13 = 0)
    SELECT * FROM (SELECT sample_id, sample_id = '' AS blank_sample, count(*) > 1 AS repeated, bool_or(included AND unit = '') AS no_unit FROM m GROUP BY sample_id) WHERE blank_sample OR repeated OR no_unit"""
)
def metadata_violations(spark, d):
    """Metadata with blank and repeated samples and without some units."""
    n = F.regexp_extract("sample_id", "[0-9]+", 0).cast("long")
    rows = fixture.metadata(spark, d).withColumn("n", n)
    rows = rows.withColumns({"sample_id": F.when(F.col("n") % 11 == 0, " ").otherwise(F.col("sample_id")), "analysis_unit_id": F.when(F.col("n") % 7 == 0, "").otherwise(F.col("analysis_unit_id"))})
    return units.metadata_violations(readers.metadata_columns(rows.union(rows.where("n % 13 = 0")).drop("n")))


@query(statement("grid", "SELECT analysis_unit_id, genome_id FROM grid WHERE n_matched >= 1 AND CAST(genome_id AS BIGINT) % 3 = 0"))
def without_opportunity(spark, d):
    """Matched genomes that an empirical background could not place, where the
    opportunity of every third genome is not known."""
    p = _prepared(spark, d)
    known = F.when(F.col("genome_id").cast("long") % 3 != 0, F.col("opportunity"))
    return background.without_opportunity(score.full_grid(p).withColumn("opportunity", known))


@query(statement("frag_o", f"SELECT '__global__' AS sample, f AS sequence, 1.0::DOUBLE AS intensity, {_MARKED} FROM frag_o WHERE f <> '' AND f NOT IN ('NA', 'NULL')"))
def pooled_scan(spark, d):
    """One sequence column; one sample and intensity 1 stand in."""
    table = fixture.observed(spark, d).select(F.col("`Stripped.Sequence`").alias("Base Sequence"), F.col("Evidence").alias("S"), F.col("`Q.Value`").alias("FDR"), F.col("Decoy").alias("Reverse"))
    return readers.pooled_columns(readers.read_table(spark, _as_text(table, "pooled-text")), score="S", decoy="Reverse")


@query(_DIGEST + "SELECT DISTINCT genome_id, translate(peptide, 'IL', 'JJ') AS peptide FROM (SELECT genome_id, unnest(parts) AS peptide FROM f) WHERE length(peptide) BETWEEN 7 AND 30")
def digest_files(spark, d):
    """Digests a folder a genome, written twice without a second copy."""
    path = new_path(spark, "digests")
    rows = digestion.digest(fixture.proteins(spark, d))
    for _ in range(2):
        # as many tasks as the text has, however few the genomes
        digestion.write_digest(rows, path)
    return readers.read_panel(spark, [path])


@query(f"SELECT 'p' || doc_id AS header, {_BODY} || {_PROTEIN} AS sequence FROM documents")
def fasta_records(spark, d):
    """Records of wrapped lines, headers cut at the first space."""
    lines = F.regexp_replace("sequence", "(.{60})", "$1\n")
    text = fixture.proteins(spark, d).select(F.concat(F.lit(">"), "header", F.lit(" of "), "genome_id", F.lit("\n"), lines))
    path = new_path(spark, "fasta")
    text.write.text(path)
    return readers.read_fasta(spark, path, shorten=True).select("header", "sequence")


@query("SELECT DISTINCT 'c' || conv_id AS sample_id, 'u' || (conv_id % 4) AS analysis_unit_id, CASE WHEN conv_id % 17 = 0 THEN 'no' ELSE 'yes' END AS included, 'site' || (conv_id % 3) AS site FROM conversations")
def metadata_scan(spark, d):
    table = fixture.metadata(spark, d).withColumnsRenamed({"sample_id": "File", "analysis_unit_id": "Patient"})
    return readers.read_metadata(spark, _as_text(table, "metadata"), "File", "Patient")


@query("SELECT CAST(doc_id AS VARCHAR) AS genome_id, CASE WHEN doc_id % 4 = 0 THEN least(lang || '/' || source, 'en/zzz') ELSE lang || '/' || source END AS \"Lineage\" FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def lineage_scan(spark, d):
    """Blank rows are dropped and one lineage a genome stays."""
    rows = fixture.lineage(spark, d).where("Lineage IS NOT NULL")
    again = rows.where("CAST(genome_id AS BIGINT) % 4 = 0").withColumn("Lineage", F.lit(" en/zzz "))
    blank = rows.where("CAST(genome_id AS BIGINT) % 6 = 0").withColumn("Lineage", F.lit("  "))
    return readers.read_lineage(spark, _as_text(rows.union(again).union(blank), "lineage"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language FROM documents")
def column_extract(spark, d):
    path = new_path(spark, "extract")
    sinks.extract_columns(spark, f"{d}/documents.parquet", path, ["doc_id", "lang"], ["id", "language"])
    return spark.read.csv(path, sep="\t", header=True)


@query(ORACLES["manifest_units"])
def manifest_file(spark, d):
    """The document of lines, written and read again."""
    p, rows = _calls(spark, d)
    path = new_path(spark, "manifest")
    manifest.write(manifest.lines(written(manifest.members(p.mapping, rows), "selection"), "2024-01-01T00:00:00Z"), path)
    return _by_unit(*manifest.read(spark, path))


@query(
    calls(
        """SELECT count(*) FILTER (u = 'u0') AS empty_samples, count(*) FILTER (u = 'u1') AS wrong_n_samples, count(*) FILTER (u = 'u2') AS repeated_samples, count(*) FILTER (u = 'u3' AND n5 > 0) AS repeated_genomes,
        count(*) FILTER (u = 'u1') AS q001_not_in_q005, 0::BIGINT AS samples_in_units FROM (SELECT m.u, coalesce(n5, 0) AS n5 FROM (SELECT DISTINCT analysis_unit_id AS u FROM mapping WHERE included) m
        LEFT JOIN (SELECT analysis_unit_id AS u, count(*) AS n5 FROM scored WHERE pass_q_0_05 GROUP BY 1) c USING (u))"""
    )
)
def selection_rules(spark, d):
    """A selection in which each unit breaks a rule of its own."""
    p, rows = _calls(spark, d)
    unit, samples, wide, narrow = (F.col(c) for c in ("analysis_unit_id", "sample_ids", "genome_ids_q005", "genome_ids_q001"))
    broken = sinks.selection(p.mapping, rows).withColumns(
        {
            "sample_ids": F.when(unit == "u0", F.expr("cast(array() as array<string>)")).when(unit == "u2", F.concat(samples, samples)).otherwise(samples),
            "genome_ids_q005": F.when(unit == "u3", F.concat(wide, wide)).otherwise(wide),
            "genome_ids_q001": F.when(unit == "u1", F.array(F.lit("none such"))).otherwise(narrow),
        }
    )
    n = F.when(unit == "u1", F.size("sample_ids") + 1).otherwise(F.size("sample_ids"))
    return sinks.selection_violations(broken.withColumn("n_samples", n.cast("long")))


@query(statement("genomes", "SELECT false AS first, true AS second, false AS other, count(*) AS n_genomes, sum(opportunity) AS n_unique FROM genomes"))
def reused_tables(spark, d):
    """A table is made once for a panel and again for another one."""
    rows, path = written(fixture.panel(spark, d), "panel"), new_path(spark, "reuse")
    seen = []
    for table in (rows, rows.repartition(3), rows.where("peptide > 'M'"), rows):
        mark = {"panel": sinks.content_hash(table, "genome_id", "peptide")}
        out, reused = sinks.materialise(lambda t=table: panel.opportunity(t), spark, path, mark)
        seen.append(reused)
    n = out.agg(F.count("*").alias("n_genomes"), F.sum("opportunity").alias("n_unique"))
    return n.select(F.lit(seen[0]).alias("first"), F.lit(seen[1]).alias("second"), F.lit(seen[2] or seen[3]).alias("other"), "n_genomes", "n_unique")


_GIVEN = "(SELECT peptide FROM unit_peptides)"


def _reuse_case(name: str, genomes: str, again: str, peptides: str = _GIVEN) -> str:
    """``genomes``: the case's (genome_id, peptide); ``again``: which are matched now."""
    return f"""SELECT '{name}' AS changed, count(DISTINCT genome_id) AS n_genomes, count(DISTINCT genome_id) FILTER ({again}) AS n_again,
    count(*) FILTER (peptide IN {peptides}) AS n_matches, count(DISTINCT peptide) FILTER (peptide IN {peptides}) AS n_matched FROM ({genomes})"""


@query(
    statement(
        "matches",
        " UNION ALL ".join(
            [
                _reuse_case("nothing stored", "SELECT * FROM panel", "true"),
                _reuse_case("order", "SELECT * FROM panel", "false"),
                _reuse_case("genome list", "SELECT * FROM panel WHERE genome_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang IS DISTINCT FROM 'en')", "false"),
                _reuse_case("bundle", "SELECT * FROM panel WHERE length(peptide) < 30", "genome_id IN (SELECT genome_id FROM panel WHERE length(peptide) >= 30)"),
                _reuse_case("observed", "SELECT * FROM panel", "true", "(SELECT peptide FROM unit_peptides WHERE length(peptide) > 7)"),
                _reuse_case(
                    "policy", "SELECT DISTINCT genome_id, f AS peptide FROM frag_p WHERE length(f) BETWEEN 7 AND 30", "true",
                    "(SELECT raw FROM clean JOIN mapping USING (sample_id) WHERE included)",
                ),
                _reuse_case("digestion", "SELECT * FROM panel WHERE length(peptide) >= 8", "true"),
                _reuse_case("nothing", "SELECT * FROM panel", "false"),
            ]
        ),
    )
)
def reused_matches(spark, d):
    """Matches out of a store, while each thing they depend on changes in turn."""
    digest, exact = {"least": 7, "most": 30}, "exact"
    rows = written(fixture.panel(spark, d), "panel")
    raw, meta = fixture.observed(spark, d), _meta(spark, d)
    seen = written(score.observed_peptides(raw, ALPHA, meta), "seen")
    as_read = written(score.observed_peptides(raw, score.with_mode(ALPHA, peptide_policy=exact), meta), "seen-exact")
    english = spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("genome_id"))
    n, half = F.length("peptide"), F.pmod(F.xxhash64("genome_id", "peptide"), F.lit(2))
    cases = {
        "nothing stored": (rows, seen, ALPHA.peptide_policy, digest),
        # one half after the other: another order without dealing the panel anew
        "order": (rows.where(half == 1).union(rows.where(half == 0)), seen.repartition(3), ALPHA.peptide_policy, digest),
        "genome list": (panel.select_genomes(rows, exclude=english), seen, ALPHA.peptide_policy, digest),
        "bundle": (rows.where(n < 30), seen, ALPHA.peptide_policy, digest),
        "observed": (rows, seen.where(n > 7), ALPHA.peptide_policy, digest),
        "policy": (written(fixture.panel(spark, d, exact), "panel-exact"), as_read, exact, digest),
        "digestion": (rows.where(n >= 8), seen, ALPHA.peptide_policy, digest | {"least": 8}),
        "nothing": (rows, seen, ALPHA.peptide_policy, digest),
    }
    path, out = new_path(spark, "reuse"), []
    for name, (genomes, peptides, policy, cut) in cases.items():
        found, counts = reuse.matched(genomes, peptides, path, policy, cut)
        fixed = [F.lit(name).alias("changed"), F.lit(sum(counts.values())).cast("long").alias("n_genomes"), F.lit(counts["genomes_matched"]).cast("long").alias("n_again")]
        out.append(found.agg(F.count("*").alias("n_matches"), F.count_distinct("peptide").alias("n_matched")).select(*fixed, "n_matches", "n_matched"))
    return reduce(DataFrame.unionByName, out)


@query(statement("frag_o", "SELECT 'c' || conv_id AS sample_id, count(*) AS n_rows FROM frag_o WHERE f <> '' AND role IS DISTINCT FROM 'user' GROUP BY 1"))
def decoy_configured(spark, d):
    """A mark that is given counts, also where known marks are there."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    rows = turns.select("conv_id", "role", F.explode(T.fragments(fixture.letters("text"))).alias("f"))
    mark = F.when(F.col("role") == "user", " user ").when(F.col("role") == "system", "true").otherwise(F.col("role"))
    raw = rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("Run"), F.col("f").alias("Sequence"), F.lit(1.0).alias("Intensity"), mark.alias("Target/Decoy"))
    kept = observed.targets(readers.observed_columns(raw, "metadata"), score.with_mode(ALPHA, decoy_marker="user"))
    return kept.groupBy("sample_id").agg(F.count("*").alias("n_rows"))


@query(statement("frag_o", "SELECT 'c' || conv_id AS sample_id, count(*) AS n_rows FROM frag_o WHERE f <> '' AND role IS DISTINCT FROM 'system' GROUP BY 1"))
def decoy_truth_values(spark, d):
    """A column of truth values, whose mark is found."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    rows = turns.select("conv_id", "role", F.explode(T.fragments(fixture.letters("text"))).alias("f"))
    raw = rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("Run"), F.col("f").alias("Sequence"), F.lit(1.0).alias("Intensity"), (F.col("role") == "system").alias("Decoy"))
    return observed.targets(readers.observed_columns(raw, "metadata"), ALPHA).groupBy("sample_id").agg(F.count("*").alias("n_rows"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked table of all candidates over one cohort-wide unit."""
    ship_package(spark)
    p = score.prepare(fixture.observed(spark, sf_dir), fixture.panel(spark, sf_dir), score.with_mode(ALPHA, unit_mode="all-samples"))
    out = score.score_alpha(p)
    return out.select("analysis_unit_id", "genome_id", "n_matched", "n_unique", "n_shared", "pvalue_unique", "pvalue", "qvalue", "presence_score", "presence_rank", "pass_q_0_01", "pass_q_0_05")
