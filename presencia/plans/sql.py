"""Independent SQL for the registered queries, over the driver's tables.

Common table expressions are chained; a statement takes those up to the one it
reads. All of it is written for DuckDB.
"""

from __future__ import annotations

CUT = (
    "regexp_replace(regexp_replace(upper(regexp_replace(coalesce({0}, ''), '[^A-Za-z]', '', 'g')), "
    "'([KR])([^P|])', '\\1|\\2', 'g'), '([KR])([^P|])', '\\1|\\2', 'g')"
)
LOO = """
  SELECT {keys}, n_unique, in_background, h.total - m AS size, h.ge - m AS ge, h.le - m AS le, h.total, h.below, m, h.sum - m * n_unique AS sum
  FROM (SELECT DISTINCT {keys}, n_unique, in_background, CAST(in_background AS INT) AS m FROM binned) a
  CROSS JOIN LATERAL (SELECT count(*) AS total, count(*) FILTER (b.n_unique >= a.n_unique) AS ge, count(*) FILTER (b.n_unique <= a.n_unique) AS le,
    count(*) FILTER (b.n_unique < a.n_unique) AS below, coalesce(sum(b.n_unique), 0) AS sum FROM binned b WHERE b.in_background AND {match}) h"""

#: (name, body) in an order where each reads only earlier ones.
STEPS: list[tuple[str, str]] = [
    ("frag_p", f"SELECT CAST(doc_id AS VARCHAR) AS genome_id, unnest(string_split({CUT.format('text')}, '|')) AS f FROM documents"),
    ("panel", "SELECT DISTINCT genome_id, translate(f, 'IL', 'JJ') AS peptide FROM frag_p WHERE length(f) BETWEEN 7 AND 30"),
    ("frag_o", f"SELECT conv_id, turn, role, unnest(string_split({CUT.format('text')}, '|')) AS f FROM conversations"),
    (
        "target",
        """SELECT 'c' || conv_id AS sample_id, translate(f, 'IL', 'JJ') AS peptide, f AS raw, CAST(length(f) * (turn + 1) AS DOUBLE) AS intensity,
        (length(f) % 8) / 8.0 AS score, ((conv_id * 7 + turn * 13) % 100) / 1000.0 AS error FROM frag_o WHERE f <> '' AND role IS DISTINCT FROM 'system'""",
    ),
    ("clean", "SELECT * FROM target WHERE intensity > 0 AND error <= 0.05"),
    ("pairs", "SELECT DISTINCT sample_id, peptide FROM clean"),
    ("per_sample", "SELECT sample_id, count(*) AS n_total_rows FROM target GROUP BY sample_id"),
    ("meta", "SELECT DISTINCT 'c' || conv_id AS sample_id, 'u' || (conv_id % 4) AS analysis_unit_id, conv_id % 17 <> 0 AS included, 'site' || (conv_id % 3) AS site FROM conversations"),
    (
        "mapping",
        """SELECT s.sample_id, m.analysis_unit_id, m.included, coalesce(v.n, 0) AS n_valid_peptides, s.n_total_rows, m.site FROM per_sample s
        JOIN meta m USING (sample_id) LEFT JOIN (SELECT sample_id, count(*) AS n FROM pairs GROUP BY sample_id) v USING (sample_id)""",
    ),
    ("unit_peptides", "SELECT DISTINCT m.analysis_unit_id, p.peptide FROM pairs p JOIN mapping m USING (sample_id) WHERE m.included"),
    ("matches", "SELECT genome_id, peptide FROM panel WHERE peptide IN (SELECT peptide FROM unit_peptides)"),
    ("deg", "SELECT peptide, count(*) AS d, CASE WHEN count(*) = 1 THEN min(genome_id) END AS owner FROM matches GROUP BY peptide"),
    (
        "genomes",
        """SELECT t.genome_id, t.n AS total_peptide_count, coalesce(u.n, 0) AS opportunity FROM (SELECT genome_id, count(*) AS n FROM panel GROUP BY genome_id) t
        LEFT JOIN (SELECT g AS genome_id, count(*) AS n FROM (SELECT peptide, min(genome_id) AS g FROM panel GROUP BY peptide HAVING count(*) = 1) GROUP BY g) u USING (genome_id)""",
    ),
    ("used", "SELECT c.* FROM clean c JOIN mapping m USING (sample_id) WHERE m.included"),
    ("best", "SELECT peptide, max(score) AS best, max(error) AS error FROM used GROUP BY peptide"),
    (
        "scores",
        """SELECT peptide, CASE WHEN high <= low THEN 1.0 ELSE (best - low) / (high - low) END AS score, greatest(least(error, 1.0), 1e-12) AS error
        FROM best, (SELECT min(best) AS low, max(best) AS high FROM best)""",
    ),
    (
        "peptides",
        """SELECT peptide, d, score, 1.0 / d AS weight, score / d AS contribution,
        CASE WHEN d <= 1 THEN 0 WHEN d <= 5 THEN 1 WHEN d <= 20 THEN 2 WHEN d <= 100 THEN 3 WHEN d <= 500 THEN 4 ELSE 5 END AS deg_bin FROM deg JOIN scores USING (peptide)""",
    ),
    ("um", "SELECT * FROM unit_peptides JOIN peptides USING (peptide) JOIN matches USING (peptide)"),
    (
        "metrics",
        """SELECT analysis_unit_id, genome_id, count(*) AS n_matched, count(*) FILTER (d = 1) AS n_unique, count(*) FILTER (d >= 2) AS n_shared, avg(score) AS average_score,
        sum(weight) AS effective_count, sum(contribution) AS weighted_evidence, coalesce(sum(score) FILTER (d = 1), 0) AS unique_weighted_evidence,
        coalesce(sum(weight) FILTER (d >= 2), 0) AS effective_count_shared, coalesce(sum(contribution) FILTER (d >= 2), 0) AS weighted_evidence_shared
        FROM um GROUP BY analysis_unit_id, genome_id""",
    ),
    (
        "grid",
        """SELECT u.analysis_unit_id, g.genome_id, g.total_peptide_count, g.opportunity, coalesce(n_matched, 0) AS n_matched, coalesce(n_unique, 0) AS n_unique, coalesce(n_shared, 0) AS n_shared,
        coalesce(weighted_evidence, 0) AS weighted_evidence, coalesce(unique_weighted_evidence, 0) AS unique_weighted_evidence, coalesce(effective_count, 0) AS effective_count,
        coalesce(weighted_evidence_shared, 0) AS weighted_evidence_shared
        FROM (SELECT DISTINCT analysis_unit_id FROM mapping WHERE included) u CROSS JOIN genomes g LEFT JOIN metrics m ON m.analysis_unit_id = u.analysis_unit_id AND m.genome_id = g.genome_id""",
    ),
    ("alpha", "SELECT *, CASE WHEN n_unique = 0 THEN 1.0 ELSE greatest(least(pow({alpha}, n_unique), 1.0), 1e-300) END AS pvalue_unique FROM grid"),
    ("comb", "SELECT *, CASE WHEN n_unique = 0 THEN 1.0 ELSE least(1.0, 2 * pvalue_unique) END AS pvalue FROM alpha"),
    (
        "bh",
        """SELECT *, least(1.0, min(raw) OVER (PARTITION BY analysis_unit_id ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (
        SELECT *, pvalue * count(*) OVER (PARTITION BY analysis_unit_id) / r AS raw FROM (SELECT *, row_number() OVER (PARTITION BY analysis_unit_id ORDER BY pvalue, genome_id) AS r FROM comb WHERE n_matched >= 1))""",
    ),
    ("q", "SELECT c.*, coalesce(b.q, 1.0) AS qvalue FROM comb c LEFT JOIN bh b ON b.analysis_unit_id = c.analysis_unit_id AND b.genome_id = c.genome_id"),
    (
        "scored",
        """SELECT *, row_number() OVER (PARTITION BY analysis_unit_id ORDER BY round(qvalue, 12), n_unique DESC, n_matched DESC, genome_id) AS presence_rank,
        qvalue <= 0.01 AND n_matched >= 1 AS pass_q_0_01, qvalue <= 0.05 AND n_matched >= 1 AS pass_q_0_05 FROM q""",
    ),
    (
        "split",
        """SELECT * EXCLUDE (n, r), r > least(ceil(n * 0.05), n - 1) AS in_background FROM (SELECT *, count(*) OVER (PARTITION BY analysis_unit_id) AS n,
        row_number() OVER (PARTITION BY analysis_unit_id ORDER BY n_unique DESC, round(unique_weighted_evidence, 9) DESC, round(weighted_evidence, 9) DESC, genome_id) AS r FROM grid WHERE n_matched >= 1)""",
    ),
    (
        "edges",
        """SELECT analysis_unit_id, list_distinct(list_transform(quantile_cont(opportunity, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: round(x, 9))) AS e4,
        list_distinct(list_transform(quantile_cont(opportunity, [0.0, 1/3, 2/3, 1.0]), lambda x: round(x, 9))) AS e3, list_distinct(list_transform(quantile_cont(opportunity, [0.0, 0.5, 1.0]), lambda x: round(x, 9))) AS e2,
        least(4, greatest(1, count(*) // 50), count(DISTINCT opportunity)) AS k FROM split WHERE in_background GROUP BY analysis_unit_id""",
    ),
    (
        "interior",
        "SELECT analysis_unit_id, list_filter(e, lambda x: x > list_min(e) AND x < list_max(e)) AS i FROM (SELECT analysis_unit_id, CASE k WHEN 4 THEN e4 WHEN 3 THEN e3 WHEN 2 THEN e2 ELSE [0.0] END AS e FROM edges)",
    ),
    ("binned", "SELECT s.*, len(list_filter(t.i, lambda x: x < s.opportunity)) AS bin FROM split s JOIN interior t USING (analysis_unit_id)"),
    ("loo_bin", LOO.format(keys="analysis_unit_id, bin", match="b.analysis_unit_id = a.analysis_unit_id AND b.bin = a.bin")),
    ("loo_unit", LOO.format(keys="analysis_unit_id", match="b.analysis_unit_id = a.analysis_unit_id")),
]


_WORD = "4294967295::UBIGINT"


def _mixed(rows: str) -> str:
    """``rows`` with their column x put through the draws' mixing function."""
    for step in ("xor(x, x >> 16)", f"(x * 569420461::UBIGINT) & {_WORD}", "xor(x, x >> 15)", f"(x * 3545902487::UBIGINT) & {_WORD}", "xor(x, x >> 15)"):
        rows = f"SELECT * REPLACE ({step} AS x) FROM ({rows})"
    return rows


KNOCKOFF = [
    ("counted", "SELECT analysis_unit_id, genome_id, deg_bin, count(*) AS c FROM um WHERE d >= 2 GROUP BY 1, 2, 3"),
    ("digested", "SELECT *, md5('42|' || analysis_unit_id || '|' || genome_id || '|' || deg_bin || '|0') AS h FROM counted"),
    ("keyed", "SELECT * EXCLUDE (h), CAST('0x' || substr(h, 1, 8) AS BIGINT) AS k0, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS k1 FROM digested"),
    (
        "pool",
        """SELECT *, CAST(sum(n) OVER (PARTITION BY analysis_unit_id, deg_bin ORDER BY contribution) - n AS BIGINT) AS low FROM (
        SELECT analysis_unit_id, deg_bin, contribution, count(*) AS n FROM unit_peptides JOIN peptides USING (peptide) WHERE d >= 2 GROUP BY 1, 2, 3)""",
    ),
    ("pool_sizes", "SELECT analysis_unit_id, deg_bin, CAST(sum(n) AS UBIGINT) AS total FROM pool GROUP BY 1, 2"),
]


def knockoff_draws(tag: str, who: str, first: int, last: int) -> list[tuple[str, str]]:
    """sums{tag}: one row a genome of ``who`` and iteration, with its sum."""
    key = "analysis_unit_id, genome_id, deg_bin"
    return [
        (f"asked{tag}", f"SELECT * FROM keyed JOIN (SELECT DISTINCT analysis_unit_id, genome_id FROM {who}) USING (analysis_unit_id, genome_id)"),
        (f"ks{tag}", _mixed(f"SELECT {key}, k, CAST(k0 + k AS UBIGINT) & {_WORD} AS x FROM asked{tag}, (SELECT unnest(range({first}, {last})) AS k)")),
        (f"is{tag}", _mixed(f"SELECT {key}, CAST(k1 + i AS UBIGINT) & {_WORD} AS x FROM (SELECT *, unnest(range(c)) AS i FROM asked{tag})")),
        (f"at{tag}", _mixed(f"SELECT {key}, k, xor(a.x, b.x) AS x FROM ks{tag} a JOIN is{tag} b USING ({key})")),
        (f"place{tag}", f"SELECT {key}, k, CAST((x * total) >> 32 AS BIGINT) AS place FROM at{tag} JOIN pool_sizes USING (analysis_unit_id, deg_bin)"),
        (
            f"sums{tag}",
            f"""SELECT p.analysis_unit_id, p.genome_id, k, sum(contribution) AS s FROM place{tag} p ASOF JOIN pool q
            ON p.analysis_unit_id = q.analysis_unit_id AND p.deg_bin = q.deg_bin AND p.place >= q.low GROUP BY 1, 2, 3""",
        ),
    ]


def knockoff_null(name: str, sums: str) -> tuple[str, str]:
    """``name``: p, moments and quantiles of each genome's sums."""
    return (
        name,
        f"""SELECT s.analysis_unit_id, s.genome_id, (1.0 + count(*) FILTER (s >= e - 1e-9 * greatest(1.0, abs(e)))) / (1.0 + count(*)) AS pvalue_shared, avg(s) AS null_mean, stddev_samp(s) AS null_sd,
        quantile_cont(s, 0.95) AS null_q95, quantile_cont(s, 0.99) AS null_q99, (any_value(e) - avg(s)) / (stddev_samp(s) + 1e-12) AS z_shared FROM {sums} s
        JOIN (SELECT analysis_unit_id, genome_id, weighted_evidence_shared AS e FROM metrics) m ON m.analysis_unit_id = s.analysis_unit_id AND m.genome_id = s.genome_id GROUP BY 1, 2""",
    )


def _both(rows: str, null: str) -> str:
    return f"""SELECT *, CASE WHEN n_unique = 0 THEN 1.0 ELSE least(1.0, 2 * pvalue_unique, greatest(pvalue_unique, pvalue_shared)) END AS pvalue
    FROM (SELECT r.*, coalesce(k.pvalue_shared, 1.0) AS pvalue_shared FROM {rows} r LEFT JOIN {null} k ON k.analysis_unit_id = r.analysis_unit_id AND k.genome_id = r.genome_id)"""


def whole_run(body: str, alpha: str = "0.05") -> str:
    """``body`` after both Monte Carlo stages by error bounds: tables null1,
    null2 (the second stage where it ran, else the first) and scored."""
    names = [n for n, _ in STEPS]
    until = names.index("alpha") + 1
    steps = STEPS[:until] + KNOCKOFF + knockoff_draws("1", "metrics", 0, 500) + [knockoff_null("null1", "sums1"), ("first", _both("alpha", "null1"))]
    steps.append(("again", "SELECT analysis_unit_id, genome_id FROM first WHERE n_matched >= 1 AND pvalue BETWEEN 0.01 AND 0.05"))
    steps += knockoff_draws("2", "again", 500, 2000)
    steps.append(("sums", "SELECT * FROM sums2 UNION ALL SELECT s.* FROM sums1 s JOIN again USING (analysis_unit_id, genome_id)"))
    steps.append(knockoff_null("extended", "sums"))
    steps.append(("null2", "SELECT * FROM extended UNION ALL SELECT * FROM null1 WHERE (analysis_unit_id, genome_id) NOT IN (SELECT (analysis_unit_id, genome_id) FROM again)"))
    steps.append(("comb", _both("alpha", "null2")))
    steps += STEPS[until + 1 :][: names.index("scored") - until]
    return chained([(n, b.replace("{alpha}", alpha)) for n, b in steps], body)


#: Error bounds of one peptide: the usual one, and one so small that genomes are called.
ALPHA, CALLING_ALPHA = "0.05", "0.003"


def chained(steps: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in steps) + " " + body


def statement(last: str, body: str, alpha: str = ALPHA) -> str:
    """``body`` after all steps up to ``last``."""
    names = [n for n, _ in STEPS]
    return chained([(n, b.replace("{alpha}", alpha)) for n, b in STEPS[: names.index(last) + 1]], body)


def background_pass(i: str, share: str) -> list[tuple[str, str]]:
    """Steps of one empirical pass over ``ranked0`` with the shares of the table
    ``share`` (analysis_unit_id, f): bins, leave-one-out values, p, q. Values are
    taken from sorted lists, which lose one own copy."""
    most = "[0.0, 0.25, 0.5, 0.75, 1.0]", "[0.0, 1/3, 2/3, 1.0]", "[0.0, 0.5, 1.0]"
    edges = ", ".join(f"list_distinct(list_transform(quantile_cont(opportunity, {e}), lambda x: round(x, 9))) AS e{k}" for k, e in zip((4, 3, 2), most))
    place = "(len(l) - 1) * 0.95"
    return [
        (f"split{i}", f"SELECT r.*, s.f, r.place > least(ceil(r.n * s.f), r.n - 1) AS in_background FROM ranked0 r JOIN {share} s USING (analysis_unit_id)"),
        (f"edges{i}", f"SELECT analysis_unit_id, {edges}, least(4, greatest(1, count(*) // 50), count(DISTINCT opportunity)) AS k FROM split{i} WHERE in_background GROUP BY analysis_unit_id"),
        (
            f"binned{i}",
            f"""SELECT s.*, len(list_filter(t.e, lambda x: x > list_min(t.e) AND x < list_max(t.e) AND x < s.opportunity)) AS bin FROM split{i} s JOIN
            (SELECT analysis_unit_id, CASE k WHEN 4 THEN e4 WHEN 3 THEN e3 WHEN 2 THEN e2 ELSE [0.0] END AS e FROM edges{i}) t USING (analysis_unit_id)""",
        ),
        (f"lists{i}", f"SELECT analysis_unit_id, bin, coalesce(list_sort(list(n_unique) FILTER (in_background)), []) AS l FROM binned{i} GROUP BY 1, 2"),
        (f"whole{i}", f"SELECT analysis_unit_id, list_sort(list(n_unique) FILTER (in_background)) AS l FROM binned{i} GROUP BY 1"),
        (
            f"asked{i}",
            f"""SELECT a.*, CASE WHEN a.in_background THEN list_concat(b.l[1:list_position(b.l, a.n_unique) - 1], b.l[list_position(b.l, a.n_unique) + 1:]) ELSE b.l END AS own,
            CASE WHEN a.in_background THEN list_concat(w.l[1:list_position(w.l, a.n_unique) - 1], w.l[list_position(w.l, a.n_unique) + 1:]) ELSE w.l END AS every
            FROM (SELECT DISTINCT analysis_unit_id, bin, n_unique, in_background FROM binned{i}) a JOIN lists{i} b USING (analysis_unit_id, bin) JOIN whole{i} w USING (analysis_unit_id)""",
        ),
        (
            f"loo{i}",
            f"""SELECT analysis_unit_id, bin, n_unique, in_background, len(l) AS size, len(list_filter(l, lambda x: x >= n_unique)) AS ge,
            CASE WHEN len(l) = 0 THEN 0.0 ELSE l[CAST(floor({place}) AS BIGINT) + 1] + (l[least(CAST(floor({place}) AS BIGINT) + 2, len(l))] - l[CAST(floor({place}) AS BIGINT) + 1]) * ({place} - floor({place})) END AS threshold
            FROM (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE every END AS l FROM asked{i})""",
        ),
        (
            f"tested{i}",
            f"""SELECT b.*, size, threshold, greatest(0, b.n_unique - threshold) AS excess, (1.0 + ge) / (1.0 + size) AS p_tail, 1.0 / (1.0 + size) AS resolution,
            CASE WHEN b.n_unique = 0 THEN 1.0 ELSE least(1.0, 2 * greatest(CASE WHEN b.n_unique > threshold THEN pow(0.05, b.n_unique - threshold) ELSE 1.0 END, 1e-300)) END AS p
            FROM binned{i} b JOIN loo{i} l ON l.analysis_unit_id = b.analysis_unit_id AND l.bin = b.bin AND l.n_unique = b.n_unique AND l.in_background = b.in_background""",
        ),
        (
            f"judged{i}",
            f"""SELECT *, least(1.0, min(raw) OVER (PARTITION BY analysis_unit_id ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (
            SELECT *, p * n / r AS raw FROM (SELECT *, row_number() OVER (PARTITION BY analysis_unit_id ORDER BY p, genome_id) AS r FROM tested{i}))""",
        ),
        (f"share{i}", f"SELECT analysis_unit_id, max(f) AS f, avg(CASE WHEN q <= 0.2 THEN 1.0 ELSE 0.0 END) AS share FROM judged{i} GROUP BY 1"),
    ]


RANKED = (
    "ranked0",
    """SELECT *, count(*) OVER (PARTITION BY analysis_unit_id) AS n, row_number() OVER (PARTITION BY analysis_unit_id
    ORDER BY n_unique DESC, round(unique_weighted_evidence, 9) DESC, round(weighted_evidence, 9) DESC, genome_id) AS place FROM grid WHERE n_matched >= 1""",
)


def empirical(body: str, share: str = "0.05") -> str:
    """``body`` after one pass with the same share for all units: table testedx."""
    steps = STEPS[: [n for n, _ in STEPS].index("grid") + 1] + [RANKED]
    return chained(steps + [("given", f"SELECT DISTINCT analysis_unit_id, {share}::DOUBLE AS f FROM ranked0")] + background_pass("x", "given"), body)


def diagnosed(body: str) -> str:
    """``body`` after one pass whose shares are those of the calls' own
    candidates: table testedd."""
    names = [n for n, _ in STEPS]
    steps = [(n, b.replace("{alpha}", ALPHA)) for n, b in STEPS[: names.index("scored") + 1]] + [RANKED]
    steps.append(("sharec", "SELECT analysis_unit_id, greatest(least(avg(CASE WHEN qvalue <= 0.2 THEN 1.0 ELSE 0.0 END), 0.2), 0.02) AS f FROM scored WHERE n_matched >= 1 GROUP BY 1"))
    return chained(steps + background_pass("d", "sharec"), body)


def calibration(body: str) -> str:
    """``body`` after the three passes of a grouped calibration and the last one:
    tables step1 to step3 (f, share, new, done), judged9 and share9."""
    steps = STEPS[: [n for n, _ in STEPS].index("grid") + 1] + [RANKED]
    steps.append(("state1", "SELECT DISTINCT analysis_unit_id, 0.05::DOUBLE AS f, false AS done FROM ranked0"))
    for i in (1, 2, 3):
        steps += background_pass(str(i), f"state{i}")
        steps.append((f"step{i}", f"SELECT s.*, h.share, greatest(least(h.share, 0.2), 0.02) AS new FROM state{i} s JOIN share{i} h USING (analysis_unit_id)"))
        steps.append((f"state{i + 1}", f"SELECT analysis_unit_id, CASE WHEN done THEN f ELSE new END AS f, done OR abs(new - f) < 0.01 AS done FROM step{i}"))
    return chained(steps + background_pass("9", "state4"), body)


def digits(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)
