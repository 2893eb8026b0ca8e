import pytest

from presencia.params import ScoreParams
from presencia.plans.score import score

RAW = "Run string, `Stripped.Sequence` string, `Precursor.Quantity` double, Evidence double, `Q.Value` double"


def table(spark, peptides, run="s1"):
    return spark.createDataFrame([(run, p, 10.0, None, 0.001) for p in peptides], RAW)


def test_small_panel_falls_back_to_error_bounds(spark):
    own = {f"g{i}": [f"{c}AAAA{d}K" for d in "CDE"] for i, c in enumerate("FGHMN")}
    panel = spark.createDataFrame([(g, p) for g, ps in own.items() for p in ps], "genome_id string, peptide string")
    result = score(table(spark, [p for ps in own.values() for p in ps]), panel, ScoreParams())
    assert result.mode == "alpha-upper-bound"
    rows = result.unit_genome.collect()
    assert sorted(r.presence_rank for r in rows) == [1, 2, 3, 4, 5]
    for r in rows:
        assert (r.n_matched, r.n_unique, r.n_shared, r.pvalue_shared) == (3, 3, 0, 1.0)
        assert r.pvalue_unique == pytest.approx(0.05**3) and r.qvalue == pytest.approx(2 * 0.05**3) and r.pass_q_0_01
    tables = result.tables()
    assert {r.n_units_q_le_0_01 for r in tables["cohort_genome_summary"].collect()} == {1}
    assert {r.n_matchable for r in tables["coverage"].collect()} == {15}


def test_large_panel_uses_the_background(spark):
    panel = [("target", p) for p in ("CKMMAAK", "TAAAAAK", "TCCCCCK", "TDDDDDK")] + [(f"g{i:03d}", "CKMMAAK") for i in range(100)]
    raw = table(spark, ["CKMMAAK", "TAAAAAK", "TCCCCCK", "TDDDDDK"])
    result = score(raw, spark.createDataFrame(panel, "genome_id string, peptide string"), ScoreParams())
    assert result.mode == "empirical-background"
    top = result.unit_genome.where("presence_rank = 1").first()
    assert (top.genome_id, top.n_unique, top.background_size) == ("target", 3, 100 - result.unit_genome.where("NOT in_background AND genome_id <> 'target'").count())
    again = score(raw, spark.createDataFrame(panel, "genome_id string, peptide string").repartition(7), ScoreParams())
    key = lambda r: (r.genome_id, r.pvalue_shared, r.qvalue)
    assert sorted(map(key, again.unit_genome.collect())) == sorted(map(key, result.unit_genome.collect()))


def test_presence_full_equals_plain_python(spark):
    """The registered query in its default mode: the unique p from the genomes
    it names as background, then combined p, q and ranks."""
    from presencia.plans.queries import QUERIES
    from tests.duck import SF
    from tests.test_statistics import bh, brute_background

    rows = [r.asDict() for r in QUERIES["presence_full"](spark, SF).collect()]
    active = [r for r in rows if r["n_matched"]]
    left_out = sum(not r["in_background"] for r in active)
    names = ("analysis_unit_id", "genome_id", "n_unique", "opportunity", "unique_weighted_evidence", "weighted_evidence")
    want = brute_background([tuple(r[c] for c in names) for r in active], (left_out - 0.5) / len(active), 1 + max(r["bin"] for r in active), 0.95, 0.05)
    assert 0 < left_out < len(active) < len(rows)
    for r in active:
        got = (r["bin"], r["background_size"], r["p_tail"], r["background_threshold"], r["pvalue_unique"])
        assert got == pytest.approx((*want[r["genome_id"]][:4], max(want[r["genome_id"]][4], 1e-300)))
        a, b = r["pvalue_unique"], r["pvalue_shared"]
        assert r["pvalue"] == pytest.approx(min(1, 2 * a, max(a, b)) if r["n_unique"] else 1.0)
    assert [r["qvalue"] for r in active] == pytest.approx(list(bh([r["pvalue"] for r in active])))
    assert all(r["qvalue"] == r["pvalue_unique"] == 1.0 for r in rows if not r["n_matched"])
    order = sorted(rows, key=lambda r: (r["qvalue"], -r["n_unique"], -r["n_matched"], r["genome_id"]))
    assert [r["presence_rank"] for r in order] == list(range(1, len(rows) + 1))


def test_nothing_valid_is_an_error(spark):
    panel = spark.createDataFrame([("g", "AAAAAAK")], "genome_id string, peptide string")
    with pytest.raises(ValueError):
        score(table(spark, ["AAAAAAK"]).withColumnRenamed("Q.Value", "x").selectExpr("Run", "`Stripped.Sequence`", "`Precursor.Quantity`", "Evidence", "0.9 AS `Q.Value`"), panel, ScoreParams())


def test_shared_peptides_alone_do_not_call(spark):
    panel = spark.createDataFrame([(g, p) for g in ("a", "b") for p in ("AAAAAAK", "CCCCCCK")] + [("c", "DDDDDDK")], "genome_id string, peptide string")
    rows = {r.genome_id: r for r in score(table(spark, ["AAAAAAK", "CCCCCCK", "DDDDDDK"]), panel, ScoreParams(unique_mode="hypergeometric-opportunity")).unit_genome.collect()}
    assert rows["a"].pvalue == 1.0 and rows["a"].n_shared == 2 and not rows["a"].pass_q_0_05
    assert rows["c"].n_unique == 1 and rows["c"].pvalue_unique == pytest.approx(1.0)


def small_run(spark, **params):
    own = {f"g{i}": [f"{c}AAAA{d}K" for d in "CDE"][: i % 4] + ["SSSSSSK", "TTTTTTK"][: i % 3] for i, c in enumerate("FGHMNQWY")}
    panel = spark.createDataFrame([(g, p) for g, ps in own.items() for p in ps], "genome_id string, peptide string")
    raw = [(f"s{j}", p, 10.0, float(len(g) + j), 0.001) for j in range(3) for i, (g, ps) in enumerate(own.items()) for p in ps if (i + j) % 3]
    meta = spark.createDataFrame([("s0", "u"), ("s1", "u"), ("s2", "v")], "sample_id string, analysis_unit_id string")
    return score(spark.createDataFrame(raw, RAW), panel, ScoreParams(unit_mode="metadata", **params), meta)


def test_whole_run_equals_plain_python(spark):
    """Combined p, q, ranks, flags and the summary, from the two p-values."""
    result = small_run(spark, alpha=0.01)
    rows = [r.asDict() for r in result.unit_genome.collect()]
    assert len(rows) == 14
    for unit in ("u", "v"):
        mine = [r for r in rows if r["analysis_unit_id"] == unit]
        for r in mine:
            a, b = r["pvalue_unique"], r["pvalue_shared"]
            r["p"] = min(1, 2 * a, max(a, b)) if r["n_unique"] else 1.0
            assert r["pvalue"] == pytest.approx(r["p"])
        active = sorted((r for r in mine if r["n_matched"]), key=lambda r: r["p"])
        least = 1.0
        for i in range(len(active), 0, -1):
            least = min(least, active[i - 1]["p"] * len(active) / i)
            active[i - 1]["q"] = least
        for r in mine:
            assert r["qvalue"] == pytest.approx(r.setdefault("q", 1.0))
            assert r["pass_q_0_05"] == (r["qvalue"] <= 0.05 and r["n_matched"] > 0)
        order = sorted(mine, key=lambda r: (r["qvalue"], -r["n_unique"], -r["n_matched"], r["genome_id"]))
        assert [r["presence_rank"] for r in order] == list(range(1, len(mine) + 1))
    for s in result.tables()["cohort_genome_summary"].collect():
        mine = [r for r in rows if r["genome_id"] == s.genome_id]
        assert s.n_units_tested == 2 and s.n_units_q_le_0_05 == sum(r["qvalue"] <= 0.05 for r in mine)
        assert s.best_qvalue == min(r["qvalue"] for r in mine) and s.total_unique_peptides == sum(r["n_unique"] for r in mine)


def test_all_tables_of_a_run(spark, tmp_path):
    result = small_run(spark, alpha=0.01)
    assert result.mode == "alpha-upper-bound" and {"bin", "background_size", "p_tail"} <= set(result.unit_genome.columns)
    tables = result.tables(derived=True)
    called = {(r.analysis_unit_id, r.genome_id) for r in result.unit_genome.where("pass_q_0_05").collect()}
    assert called
    listed = [(r.analysis_unit_id, r.presence_rank) for r in tables["unit_genome_list_q005"].collect()]
    assert listed == sorted(listed) and len(listed) == len(called)
    assert tables["unit_genome_list_q005"].columns == ["analysis_unit_id", "genome_id", "Lineage", "presence_rank", "qvalue"]
    union = [r.genome_id for r in tables["genome_union_q005"].collect()]
    assert set(union) == {g for _, g in called}
    assert {r.genome_id for r in tables["genome_by_unit_q005_matrix"].collect()} == set(union)
    assert len(tables["unit_genome_results_full"].columns) > len(tables["unit_genome_results"].columns)
    import json

    document = json.loads(result.run_document().first().value)
    assert document["parameters"]["alpha"] == 0.01 and document["results"]["n_tests"] == 14 and document["counts"]["mode"] == result.mode
    assert set(document["seconds"]) == {"prepare", "stage1", "stage2", "decide"}


def test_unions_must_nest(spark):
    from presencia.operators import summary

    one, two = (spark.createDataFrame([(g,) for g in x], "genome_id string") for x in ("ab", "b"))
    with pytest.raises(RuntimeError):
        summary.require_nested(one, two)
    assert summary.require_nested(two, one) is two


def test_panel_counts_are_reused(spark, tmp_path):
    from presencia.plans.score import prepare

    panel = spark.createDataFrame([("a", "AAAAAAK"), ("b", "CCCCCCK")], "genome_id string, peptide string")
    path = f"file://{tmp_path}/reuse"
    for rows, want, again in ((panel, 2, 2), (panel, 2, 0), (panel.where("genome_id = 'a'"), 1, 0)):
        p = prepare(table(spark, ["AAAAAAK"]), rows, keep=True, reuse=path)
        assert (p.genomes.count(), p.reused["genomes_matched"]) == (want, again)
        assert [tuple(r) for r in p.matches.collect()] == [("a", "AAAAAAK")]
    assert spark.read.parquet(f"{path}/table").count() == 1


def test_written_tables_can_be_cleared(spark):
    from presencia import tables

    kept = tables.written(spark.range(3), "clear-me")
    path = tables.new_path(spark, "x").rsplit("/", 1)[0]
    assert kept.count() == 3 and spark.read.parquet(f"{path}/clear-me-*").count() == 3
    tables.clear_written(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/clear-me-*")


def test_scratch_tables_go_and_others_stay(spark):
    from presencia.tables import clear_scratch, scratch, written

    kept = written(spark.range(3).toDF("id"), "kept")
    with scratch(spark) as name:
        inner = written(spark.range(5).toDF("id"), "inner")
    after = written(inner, "after")
    assert name in inner.inputFiles()[0] and not any(name in f for x in (kept, after) for f in x.inputFiles())
    clear_scratch(spark, name)
    assert (kept.count(), after.count()) == (3, 5)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        inner.collect()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from presencia import tables

    unset = SimpleNamespace(get=lambda *_: None)

    def session(master):
        return SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            tables.shared_root(session(master))
    assert tables.shared_root(session("local[4]")).startswith("file:///")
