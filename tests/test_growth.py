"""What grows with the tables must not meet in few tasks or be made anew."""

from pyspark.sql import functions as F

from presencia.operators import background, decide, digestion
from presencia.params import ScoreParams
from presencia.plans import queries, score
from presencia.sources import readers
from tests.duck import SF


def test_digests_are_written_by_as_many_tasks_as_the_text_has(spark, monkeypatch):
    seen, write = [], digestion.write_digest
    monkeypatch.setattr(digestion, "write_digest", lambda rows, path: seen.append(rows) or write(rows, path))
    queries.QUERIES["digest_files"](spark, SF)
    assert len(seen) == 2 and all("Exchange hashpartitioning(genome_id" not in x._jdf.queryExecution().executedPlan().toString() for x in seen)


def test_no_panel_line_is_dealt_by_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"g{i % 3}", "p", "AAAAAAK") for i in range(60)], "genome_id string, protein string, peptide string")
    digestion.write_digest(rows, str(tmp_path / "d"))
    plan = readers.panel_lines(spark, [str(tmp_path / "d")])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(file" not in plan


def test_share_of_candidates_needs_no_row_of_a_genome(spark):
    """Counts of distinct p tell what the genomes' own q-values tell."""
    rows = spark.createDataFrame([("u", i, 1, p) for i, p in enumerate([0.01, 0.01, 0.2, 0.9, 0.04, 1.0, 1.0])] + [("v", 1, 1, 0.5)], "analysis_unit_id string, genome_id long, n_matched long, pvalue double")
    got = {(r.analysis_unit_id, r.pvalue): (r.n, r.qvalue) for r in decide.q_values(rows).collect()}
    own = decide.bh(rows).groupBy("analysis_unit_id", "pvalue").agg(F.count("*").alias("n"), F.max("qvalue").alias("q"), F.min("qvalue").alias("least")).collect()
    assert got == {(r.analysis_unit_id, r.pvalue): (r.n, r.q) for r in own} and all(r.q == r.least for r in own)


def test_calibration_passes_carry_only_what_a_share_depends_on(spark, monkeypatch):
    """The passes before the last one write no column of the result beside it."""
    seen, of = [], background.written
    monkeypatch.setattr(background, "written", lambda df, label: seen.append((label, set(df.columns))) or of(df, label))
    rows = [("u", f"g{i}", 1, i % 5, 3 + i % 4, 0.1, 0.2, 1.0, True, "x") for i in range(40)]
    names = "analysis_unit_id string, genome_id string, n_matched long, n_unique long, opportunity long, unique_weighted_evidence double, weighted_evidence double, pvalue_shared double, is_target boolean, other string"
    judged, _ = background.calibrate(spark.createDataFrame(rows, names), 2, ScoreParams(unit_mode="metadata"))
    binned = [c for label, c in seen if label == "binned"]
    assert len(binned) > 1 and all("other" not in c and "genome_id" not in c for c in binned[:-1])
    assert "other" in binned[-1] and judged.count() == 40


def test_metrics_and_grid_are_written_once(spark, monkeypatch):
    seen, of = [], score.written
    monkeypatch.setattr(score, "written", lambda df, label: seen.append(label) or of(df, label))
    queries.QUERIES["presence_matrix"](spark, SF)
    assert seen.count("metrics") == 1 and seen.count("grid") == 1


def test_calibration_passes_write_counts_and_rank_once(spark, monkeypatch):
    """A pass before the last writes a row for all genomes alike, with their
    number; the places by strength are written and not joined anew."""
    seen, of = [], background.written
    monkeypatch.setattr(background, "written", lambda df, label: seen.append((label, of(df, label))) or seen[-1][1])
    rows = [("u", f"g{i}", 1, i % 5, 3, 0.1, 0.2, 1.0, True) for i in range(400)]
    names = "analysis_unit_id string, genome_id string, n_matched long, n_unique long, opportunity long, unique_weighted_evidence double, weighted_evidence double, pvalue_shared double, is_target boolean"
    judged, _ = background.calibrate(spark.createDataFrame(rows, names), 2, ScoreParams(unit_mode="metadata"))
    passes = [df for label, df in seen if label == "binned"][:-1]
    assert passes and all(df.count() <= 10 and df.agg(F.sum("k")).first()[0] == 400 for df in passes)
    assert [label for label, _ in seen].count("by-strength") == 1 and judged.count() == 400


def test_both_empirical_p_come_from_one_pass(spark, monkeypatch):
    seen, of = [], background.written
    monkeypatch.setattr(background, "written", lambda df, label: seen.append(label) or of(df, label))
    queries.QUERIES["empirical_p"](spark, SF)
    assert seen.count("binned") == 1


def test_result_tables_share_one_cohort_summary(spark, monkeypatch):
    seen, of = [], score.written
    monkeypatch.setattr(score, "written", lambda df, label: seen.append(label) or of(df, label))
    queries.QUERIES["result_files"](spark, SF)
    assert seen.count("cohort") == 1
