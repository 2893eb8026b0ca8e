import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presencia.functions import stats as S
from presencia.operators import background, decide, evidence, panel, ranking, shared, unique
from presencia.params import ScoreParams

# Fixed values: (unique p, shared p) and the closed-testing result.
CLOSED = [(1e-300, 1.0, 2e-300), (0.2, 0.8, 0.4), (0.8, 0.2, 0.8), (0.3, 0.3, 0.3), (0.001, 0.8, 0.002), (0.3, 1e-6, 0.3)]


def test_closed_testing_values(spark):
    rows = spark.createDataFrame(CLOSED, "pu double, ps double, want double")
    for r in rows.withColumn("got", S.simes_closed(F.col("pu"), F.col("ps"), F.lit(1))).collect():
        assert r.got == pytest.approx(r.want, rel=1e-12)
    assert rows.select(S.simes_closed(F.col("pu"), F.col("ps"), F.lit(0)).alias("p")).distinct().collect()[0].p == 1.0


def test_closed_testing_properties(spark):
    rng = random.Random(5)
    pairs = [(rng.random() ** 3, rng.random(), rng.random()) for _ in range(2000)]
    rows = spark.createDataFrame(pairs, "pu double, a double, b double")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    got = rows.select("pu", S.simes_closed(F.col("pu"), low, F.lit(1)).alias("x"), S.simes_closed(F.col("pu"), high, F.lit(1)).alias("y")).collect()
    assert all(r.pu <= r.x <= min(1, 2 * r.pu) + 1e-15 and r.x <= r.y for r in got)


def test_other_combiners(spark):
    cols = S.all_combined(F.lit(0.05), F.lit(0.8), F.lit(1))
    got = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert got.pvalue_combined_harmonic == pytest.approx(0.08 / 0.85)
    assert got.pvalue_combined_harmonic_calibrated == pytest.approx(0.16 / 0.85)
    assert got.pvalue_combined_bonferroni == pytest.approx(0.1)
    assert got.pvalue_combined_fisher == pytest.approx(0.04 * (1 - math.log(0.04)))
    gated = spark.range(1).select(*[c.alias(k) for k, c in S.all_combined(F.lit(0.05), F.lit(0.8), F.lit(0)).items()]).first()
    assert gated.pvalue_combined_harmonic == 1 and gated.pvalue_combined_fisher < 1


def bh(p):
    p = np.asarray(p)
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.clip(q, 0, 1)
    return out


def test_bh_with_ties_and_outsiders(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(200) ** 2, 2)
    rows = [("u", str(i), float(x), 1) for i, x in enumerate(p)] + [("u", "out", 0.0001, 0)]
    df = decide.bh(spark.createDataFrame(rows, "analysis_unit_id string, genome_id string, pvalue double, n_matched int"))
    got = {r.genome_id: r.qvalue for r in df.collect()}
    assert got.pop("out") == 1.0
    want = bh(p)
    assert all(abs(got[str(i)] - want[i]) < 1e-12 for i in range(200))


def test_panel_opportunity_by_policy(spark):
    rows = [("g1", "AIL"), ("g1", "AAK"), ("g2", "ALL"), ("g2", "CCK")]
    exact = spark.createDataFrame(rows, "genome_id string, peptide string")
    merged = exact.select("genome_id", F.translate("peptide", "IL", "JJ").alias("peptide")).distinct()

    def count(df):
        return {r.genome_id: r.opportunity for r in panel.opportunity(df).collect()}

    assert count(exact) == {"g1": 2, "g2": 2}
    assert count(merged) == {"g1": 1, "g2": 1}


@pytest.mark.parametrize("args", [(100, 10, 20, 3), (100, 10, 20, 10), (50, 5, 50, 2), (30, 12, 25, 8), (40, 30, 30, 21)])
def test_hypergeometric_tail(args):
    n, k, s, u = args
    want = sum(math.comb(k, x) * math.comb(n - k, s - x) for x in range(u, min(k, s) + 1)) / math.comb(n, s)
    assert unique.upper_tails(*[[a] for a in args])[0] == pytest.approx(want, rel=1e-9)


def test_hypergeometric_tails_of_many_rows():
    """Both sides of the mean, and counts whose sums would be long."""
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        n = rng.randint(1, 120)
        k, s = rng.randint(0, n), rng.randint(0, n)
        rows.append((n, k, s, rng.randint(0, n)))
    got = unique.upper_tails(*zip(*rows))
    for (n, k, s, u), p in zip(rows, got):
        want = sum(math.comb(k, x) * math.comb(n - k, s - x) for x in range(u, min(k, s) + 1)) / math.comb(n, s)
        assert p == pytest.approx(max(want, 1e-300), rel=1e-8)
    large = unique.upper_tails([10**9] * 2, [10**6] * 2, [10**6] * 2, [1_000, 1_100])
    assert 0.4 < large[0] < 0.6 and 1e-4 < large[1] < 2e-3


def test_hypergeometric_limits():
    assert unique.upper_tails([0, 10, 10], [0, 2, 2], [0, 5, 5], [1, 0, 3]).tolist() == [1.0, 1.0, 1e-300]


def active_frame(spark, rows):
    return spark.createDataFrame(rows, "analysis_unit_id string, genome_id string, n_unique long, opportunity long, unique_weighted_evidence double, weighted_evidence double")


def test_background_tail_values(spark):
    rows = [("u", f"g{i}", i, 5, 0.0, 0.0) for i in range(4)]
    out = background.background_stats(active_frame(spark, rows), F.lit(0.0), 1, ScoreParams(empirical_method="empirical-tail"))
    got = {r.genome_id: r.p_tail for r in out.collect()}
    assert [got[f"g{i}"] for i in range(4)] == [1.0, 0.75, 0.5, 0.25]


def brute_background(rows, fraction, n_bins, q, alpha):
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], -rows[i][4], -rows[i][5], rows[i][1]))
    drop = min(math.ceil(len(rows) * fraction), len(rows) - 1)
    inside = set(order[drop:])
    a = np.array([rows[i][3] for i in sorted(inside)], float)
    bins = min(n_bins, max(1, len(a) // 50), len(set(a)))
    edges = np.unique(np.round(np.quantile(a, np.linspace(0, 1, bins + 1)), 9))
    interior = edges[1:-1]
    place = [int((interior < r[3]).sum()) for r in rows]
    out = {}
    for i, r in enumerate(rows):
        u = np.array([rows[j][2] for j in inside if j != i and place[j] == place[i]], float)
        if not len(u):
            u = np.array([rows[j][2] for j in inside if j != i], float)
        threshold = float(np.quantile(u, q)) if len(u) else 0.0
        excess = max(0.0, r[2] - threshold)
        out[r[1]] = (place[i], len(u), (1 + (u >= r[2]).sum()) / (1 + len(u)), threshold, alpha**excess)
    return out


@pytest.mark.parametrize("seed,fraction,bins", [(1, 0.0, 1), (2, 0.1, 4), (3, 0.2, 8)])
def test_background_equals_brute_force(spark, seed, fraction, bins):
    rng = np.random.default_rng(seed)
    rows = [("u", f"g{i:03d}", int(rng.poisson(1.5)), int(rng.integers(0, 40)), float(rng.integers(0, 3)), float(rng.integers(0, 3))) for i in range(230)]
    want = brute_background(rows, fraction, bins, 0.95, 0.05)
    out = background.background_stats(active_frame(spark, rows), F.lit(fraction), bins, ScoreParams())
    for r in out.collect():
        got = (r.bin, r.background_size, r.p_tail, r.background_threshold, r.pvalue_unique)
        assert got == pytest.approx(want[r.genome_id], rel=1e-9), r.genome_id


def test_background_replaces_columns_of_its_names(spark):
    """A whole run's rows have a p-value of another mode when they get here."""
    rows = [("u", f"g{i:03d}", i % 7, i % 11, 0.0, 0.0) for i in range(120)]
    df = active_frame(spark, rows).withColumns({"pvalue_unique": F.lit(0.5), "p_tail": F.lit(0.5), "other": F.col("genome_id")})
    out = background.background_stats(df, F.lit(0.1), 2, ScoreParams())
    assert len(out.columns) == len(set(out.columns))
    want = brute_background(rows, 0.1, 2, 0.95, 0.05)
    for r in out.collect():
        assert (r.p_tail, r.pvalue_unique) == pytest.approx((want[r.genome_id][2], want[r.genome_id][4]), rel=1e-9) and r.other == r.genome_id
    judged, _ = background.calibrate(df.withColumns({"is_target": F.lit(True), "pvalue_shared": F.lit(1.0), "n_matched": F.lit(1)}), 2, ScoreParams())
    plain, _ = background.calibrate(active_frame(spark, rows).withColumns({"is_target": F.lit(True), "pvalue_shared": F.lit(1.0), "n_matched": F.lit(1)}), 2, ScoreParams())
    cols = ["genome_id", "pvalue_unique", "p_tail", "qvalue", "in_background"]
    assert sorted(judged.select(cols).collect()) == sorted(plain.select(cols).collect()) and judged.count() == 120


@pytest.mark.parametrize("n,eligible,low", [(5, False, 4), (101, True, 100)])
def test_structural_eligibility(spark, n, eligible, low):
    genomes = spark.createDataFrame([(f"g{i}", 3) for i in range(n)], "genome_id string, opportunity long")
    got = background.eligibility(genomes, ScoreParams()).first()
    assert (got.eligible, got.min_comparable) == (eligible, low)


def test_opportunity_is_required(spark):
    with pytest.raises(ValueError):
        background.background_stats(spark.createDataFrame([("u", 1)], "analysis_unit_id string, n_unique long"), F.lit(0.0), 1, ScoreParams())


def knockoff_input(spark):
    pools = [("u", (1, 0), 0.5, 10), ("u", (1, 0), 0.25, 30), ("u", (2, 0), 0.1, 7)]
    strata = [("u", "a", (1, 0), 4), ("u", "a", (2, 0), 3), ("u", "b", (2, 0), 5), ("u", "c", (1, 0), 1)]
    targets = [("u", "a", 2.0), ("u", "b", 0.5), ("u", "c", 0.25), ("u", "d", 0.0)]
    return (
        spark.createDataFrame(targets, "analysis_unit_id string, genome_id string, weighted_evidence_shared double"),
        spark.createDataFrame(strata, "analysis_unit_id string, genome_id string, stratum struct<deg_bin:int,len_bin:int>, c long"),
        spark.createDataFrame(pools, "analysis_unit_id string, stratum struct<deg_bin:int,len_bin:int>, contribution double, n long"),
    )


def test_knockoff_invariants(spark):
    t, s, p = knockoff_input(spark)
    one = {r.genome_id: r for r in shared.knockoff(t, s, p, 2000, 7).collect()}
    two = {r.genome_id: r for r in shared.knockoff(t, s, p, 2000, 7, work=20_000).collect()}
    assert one == two
    assert all(1 / 2001 <= r.pvalue_shared <= 1 for r in one.values())
    assert one["b"].pvalue_shared == 1.0 and one["d"].pvalue_shared == 1.0 and one["d"].z_shared == 0.0
    moments = {r.genome_id: r for r in evidence.null_moments(s, p).collect()}
    for g in "abc":
        sd = math.sqrt(moments[g].null_var / 2000)
        assert abs(one[g].null_mean - moments[g].null_mean) <= 5 * sd + 1e-9


def plain_sums(seed, unit, genome, strata, pools, k):
    """The generator once more, a draw at a time."""
    word = (1 << 32) - 1

    def mixed(x):
        x ^= x >> 16
        x = x * 0x21F0AAAD & word
        x ^= x >> 15
        x = x * 0xD35A2D97 & word
        return x ^ x >> 15

    sums = [0.0] * k
    for (deg, length), c in sorted(strata.items()):
        h = hashlib.md5(f"{seed}|{unit}|{genome}|{deg}|{length}".encode()).hexdigest()
        k0, k1 = int(h[:8], 16), int(h[8:16], 16)
        cells = [v for v, n in sorted(pools[deg, length].items()) for _ in range(n)]
        for j in range(k):
            for i in range(c):
                sums[j] += cells[mixed(mixed(k0 + j & word) ^ mixed(k1 + i & word)) * len(cells) >> 32]
    return sums


@pytest.mark.parametrize("page", [1, 2, 1 << 20])
def test_draws_equal_brute_force_over_any_pages(spark, monkeypatch, page):
    """Pools on one page or cut into many, in one go or continued."""
    monkeypatch.setattr(shared, "PAGE", page)
    t, s, p = knockoff_input(spark)
    pages = shared.pool_pages(p)
    first = shared.knockoff_sums(t, s, pages, 0, 60, 7)
    more = shared.knockoff_sums(t, s, pages, 60, 100, 7)
    got = {r.genome_id: r for r in shared.null_of(t, first.union(more)).collect()}
    pools = {(1, 0): {0.5: 10, 0.25: 30}, (2, 0): {0.1: 7}}
    for g, strata, seen in (("a", {(1, 0): 4, (2, 0): 3}, 2.0), ("b", {(2, 0): 5}, 0.5), ("c", {(1, 0): 1}, 0.25)):
        sums = plain_sums(7, "u", g, strata, pools, 100)
        assert got[g].null_mean == pytest.approx(sum(sums) / 100)
        assert got[g].pvalue_shared == (1 + sum(x >= seen - 1e-9 for x in sums)) / 101
    assert got["d"].pvalue_shared == 1.0
    whole = {r.genome_id: r for r in shared.knockoff(t, s, p, 100, 7).collect()}
    assert all(whole[g].pvalue_shared == got[g].pvalue_shared for g in "abcd")


@pytest.mark.parametrize("page", [1, 2, 1 << 20])
def test_nulls_move_no_sums_where_a_page_holds_the_pools(spark, monkeypatch, page):
    """Moments of both kinds of units equal those made from sums; only units
    with more pages than one write sums."""
    monkeypatch.setattr(shared, "PAGE", page)
    seen, sums = [], shared.knockoff_sums
    monkeypatch.setattr(shared, "knockoff_sums", lambda *a: seen.append(a) or sums(*a))
    t, s, p = knockoff_input(spark)
    t = t.union(spark.createDataFrame([("v", "a", 0.4)], t.schema))
    s, p = s.union(spark.createDataFrame([("v", "a", (1, 0), 300)], s.schema)), p.union(spark.createDataFrame([("v", (1, 0), 0.5, 3)], p.schema))
    pages = shared.pool_pages(p)
    got = {(r.analysis_unit_id, r.genome_id): r for r in shared.nulls(t, s, pages, 100, 7).collect()}
    assert len(seen) == (page < 3)
    want = {(r.analysis_unit_id, r.genome_id): r for r in shared.null_of(t, sums(t, s, pages, 0, 100, 7)).collect()}
    assert len(want) == 5 and got.keys() == want.keys()
    for k, r in want.items():
        assert tuple(got[k])[2:] == pytest.approx(tuple(r)[2:]), k


@pytest.mark.parametrize("cells", [4, 1 << 20])
def test_many_genomes_are_drawn_at_once(monkeypatch, cells):
    """Sums of a group equal those of each genome alone, with many draws, with
    pools of more places than cells and on a page that holds part of a pool."""
    pd = pytest.importorskip("pandas")
    monkeypatch.setattr(shared, "CELLS", cells)
    monkeypatch.setattr(shared, "BLOCK", 1 << 10)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"genome_id": [f"g{i // 2}" for i in range(60)], "deg_bin": [1, 2] * 30, "len_bin": 0, "c": rng.integers(1, 300, 60), "k0": rng.integers(0, 1 << 32, 60), "k1": rng.integers(0, 1 << 32, 60)})
    n = rng.integers(1, 9, 40)
    page = pd.concat([pd.DataFrame({"deg_bin": d, "len_bin": 0, "contribution": rng.random(40), "n": n, "low": np.cumsum(n) - n + at, "total": n.sum() + 2 * at, "page": 0}) for d, at in ((1, 0), (2, 5))])
    heads, sums = next(shared._drawn(rows, page, 10, 60))
    whole = dict(zip(heads.genome_id, sums))
    for g, own in rows.groupby("genome_id"):
        want = np.zeros(50)
        for r in own.itertuples():
            pool = page[page.deg_bin == r.deg_bin]
            at = 5 * (r.deg_bin - 1)
            cells_of = np.concatenate([np.zeros(at), np.repeat(pool.contribution, pool.n), np.zeros(at)])
            want += cells_of[shared.draws(r.k0, r.k1, r.c, len(cells_of), 10, 60)].sum(axis=1)
        assert whole[g] == pytest.approx(want)
        assert (next(shared._drawn(own, page, 10, 60))[1][0] == whole[g]).all()


def test_draws_are_even():
    """Places of a pool are drawn equally often, iterations do not repeat."""
    found = shared.draws(123, 456, 100, 10, 0, 2_000)
    counts = np.bincount(found.ravel().astype(int), minlength=10)
    assert len(counts) == 10 and abs(counts / found.size - 0.1).max() < 0.003
    sums = found.sum(axis=1).astype(float)
    assert abs(sums.mean() - 450) < 2 and abs(sums.std() - math.sqrt(825)) < 2
    assert len({tuple(r) for r in found.tolist()}) == 2_000


def test_refinement_prefers_the_second_stage(spark):
    schema = "analysis_unit_id string, genome_id string, pvalue_shared double"
    out = shared.refined(spark.createDataFrame([("u", "a", 0.5), ("u", "b", 0.6)], schema), spark.createDataFrame([("u", "a", 0.1)], schema))
    assert {r.genome_id: (r.pvalue_shared, r.refined) for r in out.collect()} == {"a": (0.1, True), "b": (0.6, False)}


def test_error_column_must_cover_unique_peptides(spark):
    rows = spark.createDataFrame([(1, 0.0, 1)], "n_unique long, log_error_sum double, n_unique_without_error long")
    with pytest.raises(ValueError):
        unique.alpha_bound(rows, ScoreParams(error_source="peptide-error-column"))


@pytest.mark.parametrize("kw", [{"unit_mode": "x"}, {"combiner": "x"}, {"unique_count_power": 0.0}, {"peptide_policy": "x"}])
def test_parameters_are_checked(kw):
    with pytest.raises(ValueError):
        ScoreParams(**kw)


@pytest.mark.parametrize("mode", ["all-samples", "metadata"])
def test_calibration_equals_brute_force(spark, mode):
    rng = np.random.default_rng(7)
    counts = [int(rng.poisson(1.0)) for _ in range(220)] + [14, 15, 16, 9, 12, 18] * 3
    rows = [("u", f"g{i:03d}", u, int(rng.integers(0, 30)), float(u), float(u)) for i, u in enumerate(counts)]
    params = ScoreParams(unit_mode=mode)
    c = params.calibration

    def share(fraction):
        found = brute_background(rows, fraction, 4, 0.95, 0.05)
        p = [min(1.0, 2 * max(found[r[1]][4], 1e-300)) if r[2] > 0 else 1.0 for r in rows]
        return float((bh(p) <= c.candidate_q).mean())

    f, want = min(max(c.initial, c.least), c.most), []
    for i in range(1, c.max_iterations + 1):
        s = share(f)
        new = min(max(s, c.least), c.most)
        want.append((i, f, s, new))
        settled, f = abs(new - f) < c.settled, new
        if settled:
            break
    df = active_frame(spark, rows).withColumns({"is_target": F.lit(True), "pvalue_shared": F.lit(1.0), "n_matched": F.col("n_unique") + 1})
    judged, trace = background.calibrate(df, 4, params)
    got = sorted(tuple(r)[1:] for r in trace.where("iteration IS NOT NULL").collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(a == pytest.approx(b) for g, w in zip(got, want) for a, b in zip(g, w))
    last = trace.where("iteration IS NULL").first()
    assert (last.exclude_fraction, last.candidate_fraction) == pytest.approx((f, share(f)))
    report = background.calibration_report(judged, trace, params).first()
    assert report.iteration_count == len(want) and report.final_exclusion_fraction == pytest.approx(f)
    assert report.cap_reached == (f >= c.most - 1e-12)
    assert report.initial_background_size == len(rows) - math.ceil(len(rows) * report.initial_exclusion_fraction)
    bins = background.bin_report(judged, params, background.first_bins(df, 4, params)).collect()
    assert sum(b.initial_background_genomes for b in bins) == report.initial_background_size
    assert sum(b.active_genomes for b in bins) == len(rows)


@pytest.mark.parametrize("falling,pressed", [(True, True), (False, False)])
def test_cap_pressure_follows_the_unit(spark, falling, pressed):
    """A bin presses only in a unit at its cap, by its share or by no settling.
    Counts that fall steadily ask for more in every pass, until the cap."""
    rows = [("u", f"g{i:03d}", 400 - 2 * i if falling else 1 + 40 * (i < 10), 5, float(-i), float(-i)) for i in range(200)]
    df = active_frame(spark, rows).withColumns({"is_target": F.lit(True), "pvalue_shared": F.lit(1.0), "n_matched": F.col("n_unique")})
    params = ScoreParams(min_bin_size=20)
    judged, trace = background.calibrate(df, 4, params)
    report = background.calibration_report(judged, trace, params).first()
    bins = background.bin_report(judged, params, None, background.calibration_report(judged, trace, params)).collect()
    for b in bins:
        assert b.cap_pressure == (report.cap_reached and (b.candidate_fraction > 0.2 + 1e-12 or not report.converged))
    share = sum(b.active_genomes for b in bins if b.cap_pressure) / len(rows)
    assert report.affected_fraction == pytest.approx(share) and report.adequate_fraction == pytest.approx(1 - share)
    assert report.suitable == (not (report.cap_reached and (report.update_above_cap or not report.converged) and share + 1e-12 >= 0.9))
    assert any(b.cap_pressure for b in bins) == report.cap_reached == pressed
    assert ("below the cap" in report.reason) == (not report.cap_reached)


def test_ranks_and_running_sums_over_ranges(spark, monkeypatch):
    from presencia.operators import ranking

    monkeypatch.setattr(ranking, "STRIDE", 7)
    rng = random.Random(5)
    rows = [(rng.choice(["u", "u", "u", "v", "w"]), rng.randint(0, 9), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "unit string, q long, k long, n long").repartition(9)
    ranked = ranking.with_rank(df, "unit", [F.desc("q"), F.asc("k")], "r")
    summed = {(r.unit, r.k): r for r in ranking.running_sum(ranked, "unit", "r", "n", "upto").collect()}
    for unit in "uvw":
        total = 0
        mine = sorted((r for r in rows if r[0] == unit), key=lambda r: (-r[1], r[2]))
        for i, (_, _, k, n) in enumerate(mine):
            total += n
            assert (summed[unit, k].r, summed[unit, k].upto) == (i + 1, total)
        assert {r.upto_total for (u, _), r in summed.items() if u == unit} == {total}
    assert ranking.with_rank(df.limit(0), "unit", [F.asc("k")], "r").count() == 0


def test_no_window_holds_a_whole_unit(spark):
    """Ranks over one unit are planned by ranges, not by the unit alone."""
    from presencia.operators import decide

    rows = spark.createDataFrame([("all", f"g{i}", 0.5, 1, 1) for i in range(50)], "analysis_unit_id string, genome_id string, qvalue double, n_unique long, n_matched long")
    plan = decide.ranked(rows)._jdf.queryExecution().toString()
    assert "row_number" not in plan and "presence_rank" in plan


def test_p_histogram_has_all_bins(spark):
    from presencia.operators import diagnostics

    rows = spark.createDataFrame([(1, 0, 0.0), (1, 0, 0.05), (1, 2, 1.0), (0, 0, 0.5), (1, 1, None)], "n_matched long, n_unique long, pvalue_shared double")
    got = {(r.pool, r.bin): (r.n, r.fraction) for r in diagnostics.shared_p_histogram(rows).collect()}
    assert len(got) == 18 and got["all", 0] == (1, 1 / 3) and got["all", 4] == (1, 1 / 3) and got["all", 8] == (1, 1 / 3) and got["unique_0", 8] == (0, 0.0)


def test_calling_curve_counts_matched_genomes(spark):
    from presencia.operators import diagnostics

    rows = spark.createDataFrame([(1, 0.001), (1, 0.002), (1, 0.3), (0, 1.0)], "n_matched long, qvalue double")
    # the thresholds are fixed values
    want = [(0.001, 1), (0.002, 2), (0.005, 2), (0.01, 2), (0.02, 2), (0.05, 2), (0.1, 2), (0.2, 2), (0.5, 3), (1.0, 3)]
    assert [tuple(r) for r in diagnostics.calling_curve(rows).collect()] == want


def test_quantiles_of_one_group_of_millions(spark):
    """Order statistics of one unit with three million distinct values."""
    n = 3_000_000
    rows = spark.range(n).select(F.lit("u").alias("k"), ((F.col("id") * 7_919) % n).cast("double").alias("v"))
    got = ranking.quantiles(rows, ["k"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}).first()
    assert got.n == n
    assert [got.a, got.b, got.c, got.d, got.e] == pytest.approx([(n - 1) * q for q in (0.0, 0.25, 0.5, 0.999, 1.0)])


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    data = {k: rng.integers(0, 12, n).astype(float) for k in ("a", "b")}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("c", None)], "k string, v double")
    got = {r.k: r for r in ranking.quantiles(rows.repartition(3), ["k"], "v", {"q1": 0.1, "q2": 0.5, "q3": 0.95}).collect()}
    assert set(got) == {"a", "b"}
    for k, vs in data.items():
        assert [got[k].q1, got[k].q2, got[k].q3] == pytest.approx(np.quantile(vs, [0.1, 0.5, 0.95])) and got[k].n == n


def test_bh_of_many_distinct_values(spark):
    """One unit whose p-values all differ, over several ranges."""
    n = 50_000
    p = np.random.default_rng(3).random(n) ** 2
    rows = spark.createDataFrame([("u", i, float(x), 1) for i, x in enumerate(p)], "analysis_unit_id string, g long, pvalue double, n_matched int")
    got = np.array([r.qvalue for r in decide.bh(rows).orderBy("g").select("qvalue").collect()])
    order = np.argsort(p)
    raw = p[order] * n / np.arange(1, n + 1)
    want = np.empty(n)
    want[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert np.allclose(got, want)


def test_running_values_over_ranges(spark):
    rows = [(k, float(v), (v * 37) % 11) for k in ("a", "b") for v in range(300 if k == "a" else 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        placed = ranking.ranged(spark.createDataFrame(rows, "k string, v double, x int"), ["k"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.select("_range").distinct().count() > 1
    up = {(r.k, r.v): r for r in ranking.running(placed, ["k"], "v", "x", "s").collect()}
    back = {(r.k, r.v): r.s for r in ranking.running(placed, ["k"], "v", "x", "s", F.min, backwards=True).collect()}
    for k, v, x in rows:
        assert up[k, v].s == sum(z for a, b, z in rows if a == k and b <= v)
        assert back[k, v] == min(z for a, b, z in rows if a == k and b >= v)
