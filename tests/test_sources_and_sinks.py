import json

import pytest
from pyspark.sql import functions as F

from presencia.functions import text as T
from presencia.operators import digestion, panel
from presencia.sources import manifest, readers, sinks


def test_fasta_files(spark, tmp_path):
    (tmp_path / "g1.fasta").write_text(">p1 first one\nAAAK\nCCR\n\n>p2\nDDDD*\n")
    (tmp_path / "notes.txt").write_text("nothing\n>here\nAAA\n")
    got = sorted(tuple(r) for r in readers.read_fasta(spark, str(tmp_path), shorten=True).collect())
    assert got == [("g1", "p1", "AAAKCCR"), ("g1", "p2", "DDDD*")]
    assert [r.file.rsplit("/", 1)[1] for r in readers.not_fasta(spark, str(tmp_path)).collect()] == ["notes.txt"]


def test_cuts_and_missed_cleavages(spark):
    rows = spark.createDataFrame([("AAKPCCRDDKKEE",), ("",), ("KKKK",)], "s string")
    plain = [r[0] for r in rows.select(T.fragments(F.col("s"))).collect()]
    assert plain == [["AAKPCCR", "DDK", "K", "EE"], [], ["K", "K", "K", "K"]]
    runs = [r[0] for r in rows.select(T.fragments(F.col("s"), missed=1)).collect()]
    assert runs[0] == ["AAKPCCR", "AAKPCCRDDK", "DDK", "DDKK", "K", "KEE", "EE"] and runs[1] == []


def test_digest_limits(spark):
    rows = spark.createDataFrame([("g", "h", "AAAAAAK CCCCCCCR**")], "genome_id string, header string, sequence string")
    assert sorted(r.peptide for r in digestion.digest(rows).collect()) == ["AAAAAAK", "CCCCCCCR"]
    with pytest.raises(ValueError):
        digestion.digest(rows, least=9, most=3)


def test_digest_sink_skips_what_is_there(spark, tmp_path):
    path = str(tmp_path / "digest")
    rows = spark.createDataFrame([("g1", "p", "AAK"), ("g1", "p", "AAK")], "genome_id string, protein string, peptide string")
    digestion.write_digest(rows, path)
    digestion.write_digest(rows.union(spark.createDataFrame([("g2", "q", "CCK")], rows.schema)), path)
    got = spark.read.csv(path, sep="\t", header=True).groupBy("genome_id").count().collect()
    assert {r.genome_id: r["count"] for r in got} == {"g1": 2, "g2": 1}


def panel_dir(tmp_path, name, files):
    folder = tmp_path / name
    folder.mkdir()
    for stem, body in files.items():
        (folder / f"{stem}.tsv").write_text(body)
    return str(folder)


def test_panel_by_name_and_by_position(spark, tmp_path):
    named, placed = "Protein\tPeptide\np\tAIL\np\tall\np\n", "Sequence\nCCK\n \n"
    for a, b in (("g1", "g2"), ("g2", "g1")):
        path = panel_dir(tmp_path, a, {a: named, b: placed})
        assert sorted(tuple(r) for r in readers.read_panel(spark, [path]).collect()) == sorted([(a, "AJJ"), (b, "CCK")])


def test_panel_errors(spark, tmp_path):
    bad = panel_dir(tmp_path, "b", {"g1": "Anything\n12.5\n"})
    with pytest.raises(ValueError, match="no peptides"):
        readers.read_panel(spark, [bad])
    one = panel_dir(tmp_path, "c", {"g1": "Peptide\nAAK\n"})
    two = panel_dir(tmp_path, "d", {"g1": "Peptide\nCCK\n"})
    with pytest.raises(ValueError, match="more than one place"):
        readers.read_panel(spark, [one, two])


def test_genome_selection(spark):
    rows = spark.createDataFrame([("g1", "A"), ("g2", "B"), ("g3", "C")], "genome_id string, peptide string")
    ids = spark.createDataFrame([("g1",), ("g9",)], "genome_id string")
    assert [r.genome_id for r in panel.select_genomes(rows, ids).collect()] == ["g1"]
    assert [r.genome_id for r in panel.unknown_genomes(rows, ids).collect()] == ["g9"]
    assert panel.sample_genomes(rows, 2).select("genome_id").distinct().count() == 2
    with pytest.raises(ValueError):
        panel.select_genomes(rows, ids, ids)


SELECTION = "analysis_unit_id string, sample_ids array<string>, n_samples long, genome_ids_q005 array<string>, genome_ids_q001 array<string>"


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("u1", ["a", "b"], 2, ["g1", "g2"], ["g1"]), ("u2", ["c"], 1, [], [])], SELECTION)
    path = str(tmp_path / "m")
    sinks.write_manifest(sinks.manifest(rows, "2024-01-01T00:00:00Z", {"x": "y"}), path)
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert json.loads(text)["n_units"] == 2 and json.loads(text)["inputs"] == {"x": "y"}
    got = sorted(tuple(r) for r in sinks.read_manifest(spark, path).select("analysis_unit_id", "sample_ids", "n_samples", "genome_ids_q005", "genome_ids_q001").collect())
    assert got == sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("row", [("u", [], 0, [], []), ("u", ["a"], 2, [], []), ("u", ["a"], 1, ["g", "g"], []), ("u", ["a"], 1, [], ["g"])])
def test_bad_selections(spark, row):
    with pytest.raises(ValueError):
        sinks.check_selection(spark.createDataFrame([row], SELECTION))


def test_sample_in_two_units(spark):
    with pytest.raises(ValueError):
        sinks.check_selection(spark.createDataFrame([("u", ["a"], 1, [], []), ("v", ["a"], 1, [], [])], SELECTION))


def test_large_manifest_in_chunks(spark, tmp_path):
    """A unit of many genomes: no line holds more than about a chunk."""
    n = 200_000
    samples = spark.createDataFrame([("u", "a", True), ("u", "b", True), ("v", "c", True), ("w", "d", False)], "analysis_unit_id string, sample_id string, included boolean")
    scored = spark.range(n).select(F.lit("u").alias("analysis_unit_id"), F.concat(F.lit("g"), "id").alias("genome_id"), (F.col("id") % 2 == 0).alias("pass_q_0_05"), (F.col("id") % 4 == 0).alias("pass_q_0_01"))
    rows, path = manifest.members(samples, scored), str(tmp_path / "m")
    manifest.write(manifest.lines(rows, "2024-01-01T00:00:00Z", {"x": "y"}), path)
    text = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert [(x["n_units"], x["inputs"]) for x in text if x["line"] == "head"] == [(2, {"x": "y"})]
    assert max(len(x.get("ids", [])) for x in text) < 1.2 * manifest.CHUNK and len(text) > 150
    got, units = manifest.read(spark, path)
    assert sorted(map(tuple, units.collect())) == [("u", 2, n // 2, n // 4), ("v", 1, 0, 0)]
    assert got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    manifest.write(spark.read.text(path).where("value NOT LIKE '%\"sample\"%' OR value NOT LIKE '%\"v\"%'"), str(tmp_path / "broken"))
    with pytest.raises(ValueError, match="empty_samples"):
        manifest.read(spark, str(tmp_path / "broken"))


@pytest.mark.parametrize(
    "rows,units,rule",
    [
        ([("u", "q005", "g")], [("u", 0, 1, 0)], "empty_samples"),
        ([("u", "sample", "a")], [("u", 2, 0, 0)], "wrong_n_samples"),
        ([("u", "sample", "a"), ("u", "q005", "g")], [("u", 1, 2, 0)], "wrong_n_genomes"),
        ([("u", "sample", "a")] * 2, [("u", 2, 0, 0)], "repeated_samples"),
        ([("u", "sample", "a"), ("u", "q005", "g"), ("u", "q005", "g")], [("u", 1, 2, 0)], "repeated_genomes"),
        ([("u", "sample", "a"), ("u", "q001", "g")], [("u", 1, 0, 1)], "q001_not_in_q005"),
        ([("u", "sample", "a"), ("v", "sample", "a")], [("u", 1, 0, 0), ("v", 1, 0, 0)], "samples_in_units"),
        ([("u", "sample", "a"), ("v", "sample", "b")], [("u", 1, 0, 0)], "wrong_n_samples"),
    ],
)
def test_broken_members(spark, rows, units, rule):
    got = manifest.violations(spark.createDataFrame(rows, "analysis_unit_id string, kind string, id string"), spark.createDataFrame(units, "analysis_unit_id string, n_samples long, n_q005 long, n_q001 long")).first()
    assert got[rule] == 1


def test_column_extract(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "`a.b` int, c string").write.parquet(str(tmp_path / "p"))
    sinks.extract_columns(spark, str(tmp_path / "p"), str(tmp_path / "o"), ["a.b"], ["n"])
    assert spark.read.csv(str(tmp_path / "o"), sep="\t", header=True).collect()[0].asDict() == {"n": "1"}
    with pytest.raises(ValueError):
        sinks.extract_columns(spark, str(tmp_path / "p"), str(tmp_path / "q"), ["zz"])
    with pytest.raises(ValueError):
        sinks.extract_columns(spark, str(tmp_path / "p"), str(tmp_path / "q"), ["c"], ["a", "b"])


def test_reuse_follows_provenance(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert [sinks.materialise(make, spark, path, {"v": v})[1] for v in (1, 1, 2)] == [False, True, False]
    assert len(calls) == 2


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",)], "s string")
    b = spark.createDataFrame([("y",), ("x",)], "s string")
    c = spark.createDataFrame([("y",), ("z",)], "s string")
    assert sinks.content_hash(a, "s") == sinks.content_hash(b, "s") != sinks.content_hash(c, "s")


def test_tables_as_text(spark, tmp_path):
    sinks.write_tables({"t": spark.createDataFrame([("u", ["a"])], "k string, v array<string>")}, str(tmp_path), "tsv")
    got = spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()
    assert len(got) == 1 and "a" in got[0].v


def test_digests_of_numbers_are_not_written_twice(spark, tmp_path):
    """A genome named 001 is not the number 1, and is known when it is there."""
    rows = spark.createDataFrame([("001", "p", "AAAAAAK"), ("1", "p", "CCCCCCK")], "genome_id string, protein string, peptide string")
    for part in (rows.where("genome_id = '001'"), rows, rows):
        digestion.write_digest(part, str(tmp_path / "d"))
    got = sorted(tuple(r) for r in readers.read_panel(spark, [str(tmp_path / "d")]).collect())
    assert got == [("001", "AAAAAAK"), ("1", "CCCCCCK")]
    kept = spark.read.schema("Protein string, Peptide string, genome_id string").csv(str(tmp_path / "d"), sep="\t", header=True)
    assert kept.count() == 2


def test_examples_of_inner_stops_are_the_first_by_name(spark):
    rows = spark.createDataFrame([("g", f"p{i:02}", "AAAK*CCCCCCK") for i in range(12)] + [("h", "q", "AAAK"), ("g", None, "A*K")], "genome_id string, header string, sequence string")
    got = {r.genome_id: r.inner_stop_examples for r in digestion.digest_qc(rows).collect()}
    assert got["h"] == [] and [x for x in got["g"] if x][:4] == ["p00", "p01", "p02", "p03"] and len(got["g"]) <= 5


def test_more_units_than_columns(spark):
    from presencia.operators import summary

    rows = spark.createDataFrame([(f"u{i}", "g", True, True, 0.001) for i in range(4)], "analysis_unit_id string, genome_id string, pass_q_0_01 boolean, pass_q_0_05 boolean, qvalue double")
    assert summary.presence_matrix(rows, "q001", 4).columns == ["genome_id", "u0", "u1", "u2", "u3"]
    with pytest.raises(ValueError):
        summary.presence_matrix(rows, "q001", 3)


def _stored(spark, path, rows, peptides=("AAAAAAK", "CCCCCCK"), policy="exact", digestion=None):
    from presencia.sources import reuse

    panel = spark.createDataFrame(rows, "genome_id string, peptide string")
    seen = spark.createDataFrame([(p,) for p in peptides], "peptide string")
    found, counts = reuse.matched(panel, seen, path, policy, digestion)
    return sorted(tuple(r) for r in found.collect()), counts["genomes_reused"], counts["genomes_matched"]


GENOMES = [("a", "AAAAAAK"), ("a", "DDDDDDK"), ("b", "CCCCCCK"), ("c", "DDDDDDK")]


@pytest.mark.parametrize("change", [{"peptides": ("AAAAAAK",)}, {"policy": "il-equivalent"}, {"digestion": {"least": 6}}, {"version": 2}])
def test_stored_matches_of_another_provenance_are_not_taken(spark, tmp_path, monkeypatch, change):
    from presencia.sources import reuse

    path, version = str(tmp_path / "store"), change.pop("version", None)
    assert _stored(spark, path, GENOMES)[1:] == (0, 3)
    if version:
        monkeypatch.setattr(reuse, "SCHEMA_VERSION", version)
    assert _stored(spark, path, GENOMES, **change)[1:] == (0, 3)
    assert _stored(spark, path, GENOMES[::-1], **change)[1:] == (3, 0)


def test_only_changed_genomes_are_matched_again(spark, tmp_path):
    path = str(tmp_path / "store")
    want = [("a", "AAAAAAK"), ("b", "CCCCCCK")]
    assert _stored(spark, path, GENOMES) == (want, 0, 3)
    # one changed, one new, one gone; then back to the first
    changed = [("a", "AAAAAAK"), ("a", "CCCCCCK"), ("b", "CCCCCCK"), ("d", "AAAAAAK")]
    assert _stored(spark, path, changed) == ([("a", "AAAAAAK"), ("a", "CCCCCCK"), ("b", "CCCCCCK"), ("d", "AAAAAAK")], 1, 2)
    assert _stored(spark, path, GENOMES) == (want, 3, 0)
    assert _stored(spark, path, []) == ([], 0, 0)


def test_batches_without_a_finished_ledger_are_passed_over(spark, tmp_path):
    path = tmp_path / "store"
    _stored(spark, str(path), GENOMES)
    (mark,) = path.glob("matches-*/ledger/batch=*/_SUCCESS")
    mark.unlink()
    assert _stored(spark, str(path), GENOMES) == ([("a", "AAAAAAK"), ("b", "CCCCCCK")], 0, 3)
