"""The registered queries over whole tables, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presencia.llm import ann, classifier, filteraudit, fim, fst, langid, linededup, packing, quality, secrets, simhash, tokencount, warc
from presencia.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.snapshot_report(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity_report(_table(spark, sf_dir, "pages"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst.encoding_report(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_simhash, op2_token_counts, op3_secrets, op4_packing, op5_warc_fixity, op6_cross_polytope,
            op7_language_id, op8_quality, op9_sentencepiece, op10_line_dedup, op11_fim, op12_filter_audit, op13_quality_classifier,
        )
    }


# Kind, pattern, group and least length of what op3 finds, once
# more and without the library's shorter forms.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("repo_token", "gh[opsur]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    ("web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
)


def _secret_sql() -> str:
    """The scan by gaps and matches, once more, over DuckDB's lists."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate(_SECRETS):
        pattern = pattern.replace("'", "''").replace("\\x20", " ")
        parts.append(
            f"""SELECT id, {i} AS no, '{kind}' AS kind,
            string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS found,
            regexp_extract_all(t, '{pattern}', {group}) AS val, {least} AS least FROM d"""
        )
    union = " UNION ALL ".join(parts)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({union}),
    k AS (SELECT id, no, kind, gaps, found, val, least, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0),
    p AS (SELECT id, no, kind, length(val[i]) AS n, least,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s,
        length(found[i]) AS size FROM k),
    f AS (SELECT id, no, kind, CAST(s AS BIGINT) AS s, CAST(s + size AS BIGINT) AS e FROM p WHERE n >= least),
    g AS (SELECT id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS b, count(*) FILTER (no = 2) AS c, {listed} AS spans, {listed} FILTER (no < 3) AS base FROM f GROUP BY id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (id)"""


# Measures, what they divide and what is added to both.
_RATES = (
    ("symbols", "n_symbols", 0.5, "n_words", 1),
    ("dup_lines", "n_dup_lines", 0.5, "n_lines", 1),
    ("repeats", "n_repeat_words", 0.5, "n_words", 1),
    ("word_length", "word_chars", 100, "n_words", 20),
)


def _quality_sql() -> str:
    """Counts from lists and windows; fences from sorted buckets, which have
    the sketches' quantiles at the same ranks."""
    p = quality.QualityParams()
    gamma = (1 + p.accuracy) / (1 - p.accuracy)
    values = " UNION ALL ".join(f"SELECT id, lang, source, '{m}' AS measure, ({top} + CAST({a} AS DOUBLE)) / ({below} + CAST({b} AS DOUBLE)) AS v FROM f WHERE n_words > 0" for m, top, a, below, b in _RATES)
    slack = " ".join(f"WHEN '{m}' THEN {x}" for m, x in p.slack)
    reach = " ".join(f"WHEN '{m}' THEN {x}" for m, x in p.reach)

    def at(q):
        return f"list_sort(list(b))[CAST(ceil(count(*) * {q}) AS BIGINT)]"

    def level(name, group):
        keys = "".join(f"{g}, " for g in group)
        return f"{name} AS (SELECT {keys}measure, count(*) AS n, {at(0.25)} AS b25, {at(0.75)} AS b75 FROM v GROUP BY {keys}measure)"

    def value(b):
        return f"(pow({gamma!r}, {b}) * 2 / {gamma + 1!r})"

    def pick(q):
        prior = float(p.prior_docs)
        of_lang = f"((l.n * ln{value('l.b' + q)} + {prior} * ln{value('g.b' + q)}) / (l.n + {prior}))"
        return f"exp((a.n * ln{value('a.b' + q)} + {prior} * {of_lang}) / (a.n + {prior}))"

    counts = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    s AS (SELECT id, p, words[p:p + 4] AS k FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS p FROM w)),
    r AS (SELECT id, p FROM (SELECT id, p, count(*) OVER (PARTITION BY id, k) AS n FROM s) WHERE n > 1),
    c AS (SELECT id, count(DISTINCT p + i) AS n FROM r, (SELECT unnest(range(5)) AS i) GROUP BY id),
    f AS (SELECT w.id, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN c ON c.id = w.id),
    m AS ({values}),
    v AS (SELECT *, CAST(ceil(ln(v) / ln({gamma!r})) AS BIGINT) AS b FROM m),
    {level('a', ['lang', 'source'])}, {level('l', ['lang'])}, {level('g', [])},
    e AS (SELECT a.lang, a.source, a.measure, greatest({pick('75')} * pow({pick('75')} / {pick('25')}, CASE a.measure {reach} END), {pick('75')} + CASE a.measure {slack} END) AS bound
        FROM a JOIN l ON l.lang IS NOT DISTINCT FROM a.lang AND l.measure = a.measure JOIN g ON g.measure = a.measure),
    o AS (SELECT v.id, string_agg(v.measure, ',' ORDER BY list_position({[m for m, *_ in _RATES]}, v.measure)) AS over FROM v JOIN e
        ON e.lang IS NOT DISTINCT FROM v.lang AND e.source IS NOT DISTINCT FROM v.source AND e.measure = v.measure WHERE v.v > e.bound GROUP BY v.id)
    SELECT {counts}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND o.over IS NULL AS kept, coalesce(o.over, '') AS over
    FROM f LEFT JOIN o USING (id)"""


_FIM_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS k FROM d),
    c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS a, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS b FROM u),
    p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:], ''), '') AS s FROM c)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p"""

_AUDIT_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    f AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
        + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > least, least IS NOT NULL) AS INT) AS bits FROM w),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS v),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS vs FROM x a, x b, x c, x d, x e
        WHERE a.v + b.v + c.v + d.v + e.v = 31 AND len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
    s AS (SELECT filter_order, step, vs[step] AS own, coalesce(list_sum(vs[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (bits & (earlier | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & own > 0 AND bits & earlier = 0), 0) AS removed,
        coalesce(sum(n) FILTER (bits & own > 0 AND bits & earlier > 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = own), 0) AS unique_fails,
        coalesce(sum(good) FILTER (bits & own > 0 AND bits & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bits & own > 0 AND bits & earlier = 0), 0) AS toxic_lost
        FROM c, s GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": _secret_sql(), "op8_quality": _quality_sql(), "op11_fim": _FIM_SQL, "op12_filter_audit": _AUDIT_SQL}
