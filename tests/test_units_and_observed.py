import pytest
from pyspark.sql import functions as F

from presencia.functions import text as T
from presencia.operators import observed, units
from presencia.params import ScoreParams
from presencia.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_aliases_match_loosely():
    assert readers.resolve(["file_name", "Stripped.Sequence"], "sample") == "file_name"
    assert readers.resolve(["x", "PEPTIDE.SEQUENCE"], "sequence") == "PEPTIDE.SEQUENCE"
    assert readers.resolve(["Mine", "Run"], "sample", "Mine") == "Mine"
    assert readers.resolve(["a"], "score") is None
    with pytest.raises(ValueError):
        readers.resolve(["a"], "sequence", required=True)


def test_peptides_and_samples_are_normalised(spark):
    rows = frame(spark, [(" ail ", " s1.RAW ")], "p string, s string")
    got = rows.select(T.peptide(F.col("p")), T.peptide(F.col("p"), "exact"), T.sample_id(F.col("s"))).first()
    assert tuple(got) == ("AJJ", "AIL", "s1")


def test_parquet_report_with_boolean_decoys(spark, tmp_path):
    rows = [("a.raw", "PEPK", 5.0, 0.5, 0.01, False), ("a.raw", "DECK", 5.0, 0.5, 0.01, True)]
    path = str(tmp_path / "report.parquet")
    frame(spark, rows, "Run string, `Stripped.Sequence` string, `Precursor.Quantity` double, Evidence double, `Q.Value` double, Decoy boolean").write.parquet(path)
    raw = readers.observed_columns(readers.read_table(spark, path), "per-sample")
    got = observed.valid(observed.targets(raw), ScoreParams()).collect()
    assert [(r.sample_id, r.peptide) for r in got] == [("a", "PEPK")]


def test_delimited_tables_and_missing_marks(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("Run\tSequence\tIntensity\tEvidence\tQ.Value\ns1\tAAK\t1\tNA\t0.01\ns1\tCCK\tnone\t0.5\t0.01\ns1\tDDK\t2\t0.25\tnan\n")
    raw = readers.observed_columns(readers.read_table(spark, str(path)), "per-sample")
    got = {r.sequence: (r.intensity, r.score, r.error) for r in raw.collect()}
    assert got == {"AAK": (1.0, None, 0.01), "CCK": (None, 0.5, 0.01), "DDK": (2.0, 0.25, None)}


def test_peptide_only_input_needs_the_cohort_mode(spark):
    raw = frame(spark, [("AAK",)], "Sequence string")
    got = readers.observed_columns(raw, "all-samples").first()
    assert (got["sample"], got.intensity) == ("__global__", 1.0)
    with pytest.raises(ValueError):
        readers.observed_columns(raw, "per-sample")
    with pytest.raises(ValueError):
        readers.observed_columns(raw, "all-samples", needs_intensity=True)


def test_pooled_reader_picks_its_error_column(spark):
    raw = frame(spark, [("AAK", 0.2, 0.01), (None, 0.3, 0.02)], "`Base Sequence` string, `Q.Value` double, PEP double")
    assert [(r.sequence, r.error) for r in readers.pooled_columns(raw).collect()] == [("AAK", 0.01)]


def test_decoy_marker_is_inferred_only_when_absent(spark):
    assert observed.decoy_marker(frame(spark, [("true",), ("false",)], "decoy string")) == "true"
    assert observed.decoy_marker(frame(spark, [("+",), ("true",)], "decoy string")) == "+"
    assert observed.decoy_marker(frame(spark, [(None,)], "decoy string")) == "+"
    # a mark that was chosen is not second-guessed, and marks are trimmed
    assert observed.decoy_marker(frame(spark, [("True",), ("false",)], "decoy string"), "D") == "D"
    assert observed.decoy_marker(frame(spark, [("True",)], "decoy string"), "") == ""
    assert observed.decoy_marker(frame(spark, [(" True ",), ("z",)] + [(f"a{i}",) for i in range(80)], "decoy string")) == "True"


def test_decoys_are_trimmed_and_truth_values_are_marks(spark):
    raw = frame(spark, [("s", "AAAK", True), ("s", "CCCK", False), ("s", "DDDK", None)], "Run string, Sequence string, Decoy boolean")
    kept = observed.targets(readers.observed_columns(raw, "all-samples"))
    assert sorted(r.raw for r in kept.collect()) == ["CCCK", "DDDK"]
    raw = frame(spark, [("s", "AAAK", " + "), ("s", "CCCK", "-")], "Run string, Sequence string, Reverse string")
    assert [r.raw for r in observed.targets(readers.observed_columns(raw, "all-samples")).collect()] == ["CCCK"]
    raw = frame(spark, [("s", "AAAK", "True"), ("s", "CCCK", "D")], "Run string, Sequence string, Reverse string")
    kept = observed.targets(readers.observed_columns(raw, "all-samples"), ScoreParams(decoy_marker="D"))
    assert [r.raw for r in kept.collect()] == ["AAAK"]


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_intensity_quantile_is_linear(spark, q):
    import numpy as np

    values = [1.0, 2.0, 2.0, 5.0, 9.0]
    got = observed.above_quantile(frame(spark, [("s", v) for v in values], "sample_id string, intensity double"), q)
    assert sorted(r.intensity for r in got.collect()) == sorted(v for v in values if v >= np.quantile(values, q))


def test_scores_scale_and_constant_scores_are_one(spark):
    rows = frame(spark, [("A", 1.0), ("A", 3.0), ("B", 2.0), ("C", None)], "peptide string, score double")
    assert {r.peptide: r.score for r in observed.peptide_scores(rows).collect()} == {"A": 1.0, "B": 0.0, "C": 1.0}
    same = frame(spark, [("A", 2.0), ("B", 2.0)], "peptide string, score double")
    assert {r.score for r in observed.peptide_scores(same).collect()} == {1.0}


def test_empty_input_is_reported(spark):
    with pytest.raises(ValueError):
        observed.require_rows(frame(spark, [], "a int"), "rows")


META = "sample_id string, analysis_unit_id string, included string"


@pytest.mark.parametrize("rows", [[("", "u", "yes")], [("s", "u", "yes"), ("s", "v", "yes")], [("s", "", "yes")]])
def test_bad_metadata_raises(spark, rows):
    with pytest.raises(ValueError):
        units.check_metadata(frame(spark, rows, META))


def test_excluded_samples_may_lack_a_unit(spark):
    units.check_metadata(frame(spark, [("s", "", "No"), ("t", "u", "x")], META))


def test_missing_metadata_raises_and_extra_is_ignored(spark):
    samples = frame(spark, [("a",), ("b",)], "sample_id string")
    full = frame(spark, [("a", "u", "0"), ("b", "u", "1"), ("c", "u", "1")], META)
    got = {r.sample_id: r.included for r in units.assign_units(samples, "metadata", full).collect()}
    assert got == {"a": False, "b": True}
    with pytest.raises(ValueError):
        units.assign_units(samples, "metadata", full.where("sample_id <> 'b'"))


def test_metadata_and_lineage_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("sample_id,analysis_unit_id,site\ns1.raw, u1 ,x\n")
    got = readers.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert (got.sample_id, got.analysis_unit_id, got.site) == ("s1", "u1", "x")
    (tmp_path / "l.tsv").write_text("genome_id\tLineage\ng1\tb\ng1\ta\ng2\t\n")
    assert [tuple(r) for r in readers.read_lineage(spark, str(tmp_path / "l.tsv")).collect()] == [("g1", "a")]
    (tmp_path / "e.tsv").write_text("genome_id\tLineage\ng2\t\n")
    with pytest.raises(ValueError):
        readers.read_lineage(spark, str(tmp_path / "e.tsv"))


def test_inclusion_modes(spark):
    rows = frame(spark, [("a", "x", True), ("b", "y", False)], "sample_id string, g string, included boolean")

    def after(mode):
        return {r.sample_id: r.included for r in units.set_included(rows, "g", "y", mode).collect()}

    assert after("include") == {"a": True, "b": True}
    assert after("only") == {"a": False, "b": True}
    assert after("exclude") == {"a": True, "b": False}
    with pytest.raises(ValueError):
        after("other")
