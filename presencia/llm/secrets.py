"""Secret scanning over versions of files through an incremental blob ledger.

Every version's text is addressed by its SHA-256. The ledger is a Parquet
table (blob, rules, spans); only blobs that it does not hold for the given
rule version are scanned, once each, and findings are joined back to all
paths that carry the blob, a hot blob in parts. Everything is DataFrame
functions.

Defined cases: null text counts as empty; an empty or clean text has no span;
repeated rows and exact copies are scanned once and each keeps its row; null
paths are kept. An empty table gives an empty result and an empty ledger. Only
the path and text columns are read, so other columns can't clash; redaction,
which carries the others, refuses columns named ``_llm_...``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.llm.tables import hot_join, hot_keys, new_path, reserved, written


@dataclass(frozen=True)
class Rule:
    """``group``: the capture group whose length counts; ``least``: its least
    length. Matches are leftmost and non-overlapping; short ones are dropped
    after matching, so they still use up their text. ``quick``: a pattern that
    finds the matches that are long enough, and no other, with less work."""

    kind: str
    pattern: str
    group: int
    least: int
    quick: str | None = None


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Fixed patterns, in the order that ties in spans follow.
BASE_RULES = (
    Rule("assign", f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]+", 0, 16, "[0-9a-f]{16,}"),
)
#: Credentials that their issuers mark, beside what the base rules find.
MORE_RULES = (
    Rule("repo_token", "gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\r\\n]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
)
RULES = BASE_RULES + MORE_RULES


def version_of(rules: tuple[Rule, ...]) -> str:
    """Names what rules find: any change of them gives another name."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least, r.quick) for r in rules]).encode()).hexdigest()[:16]


RULE_VERSION = version_of(RULES)

SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule in code points: the gaps between matches and the
    matches themselves alternate, so their lengths add up to positions."""
    pattern = rule.quick or rule.pattern
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), value.alias("value"))
    start = F.lit(0)
    walked = F.aggregate(
        zipped,
        F.struct(start.alias("at"), F.expr(f"cast(array() as {SPAN})").alias("found")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(
                x["value"] >= rule.least,
                F.concat(
                    s["found"],
                    F.array(
                        F.struct(
                            (s["at"] + x["gap"]).alias("start"), F.lit(number).alias("kind_no"),
                            (s["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"),
                        )
                    ).cast(SPAN),
                ),
            ).otherwise(s["found"]).alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.expr(f"cast(array() as {SPAN})"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of ``blobs`` (blob, text)."""
    found = [_spans(F.col("text"), rule, i) for i, rule in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*found)).alias("spans"))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"blob binary, spans {SPAN}, rules string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_versions(
    versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str | None = None,
    path_col: str = "path", text_col: str = "text",
) -> DataFrame:
    """path, blob, spans for every row of ``versions``.

    ``ledger``: folder of the ledger table; new (blob, rule version) pairs are
    appended. None starts one of its own in the shared folder. A run that dies
    before its append commits leaves the ledger as it was and is simply run
    again.
    """
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = versions.select(F.col(f"`{path_col}`").alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    rule_version = rule_version or version_of(rules)
    hot = _append_unseen(rows, ledger, rules, rule_version)
    found = _findings(spark, ledger, rule_version)
    return hot_join(rows.select("path", "blob"), found, hot, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans")
    )


def _append_unseen(rows: DataFrame, ledger: str, rules: tuple[Rule, ...], rule_version: str) -> DataFrame | None:
    """Scan the blobs of ``rows`` (blob, text) that the ledger lacks and append
    them. Returns the hot blobs of the rows."""
    counts = written(rows.groupBy("blob").agg(F.count("*").alias("n")), "secret-blobs")
    hot = hot_keys(counts, "blob")
    known = _ledger(rows.sparkSession, ledger)
    if known is None:
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    else:
        unseen = counts.select("blob").join(known.where(F.col("rules") == rule_version).select("blob").distinct(), "blob", "left_anti")
        blobs = _unseen_texts(rows, unseen, hot)
    scan(blobs, rules).withColumn("rules", F.lit(rule_version)).write.mode("append").parquet(ledger)
    return hot


def _unseen_texts(rows: DataFrame, unseen: DataFrame, hot: DataFrame | None) -> DataFrame:
    """blob, text of the unseen blobs, once each. Joined and grouped by one key,
    texts move once at most; those of hot blobs meet in their tasks before."""
    first = F.first("text").alias("text")
    if hot is None:
        return rows.join(unseen, "blob").groupBy("blob").agg(first)
    keys = F.broadcast(hot.select("blob"))
    often = rows.join(keys, "blob", "left_semi").groupBy("blob").agg(first).join(unseen, "blob")
    return often.unionByName(rows.join(keys, "blob", "left_anti").join(unseen, "blob").groupBy("blob").agg(first))


def _findings(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame:
    """blob, spans of the ledger's blobs that hold any. A retried append can
    repeat a pair; both copies say the same."""
    known = _ledger(spark, ledger)
    return known.where((F.col("rules") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of op3: counts by kind, the hash of the base spans, all spans."""
    found = scan_versions(docs, ledger, path_col=id_col, text_col=text_col)
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("path").alias("doc_id"),
        *[_count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def snapshot_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``secret_report`` of a corpus that arrives in two snapshots, as a ledger
    meets it: half of the documents, by a hash of the id, are scanned into a
    new ledger first, then the whole corpus is, of which only blobs that the
    first half did not hold are scanned still. Both halves are whole texts."""
    ledger = new_path(docs.sparkSession, "secret-ledger")
    first = docs.where(F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 2 == 0, F.lit(False)))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    _append_unseen(first.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")), ledger, RULES, RULE_VERSION)
    return secret_report(docs, ledger, id_col, text_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", ledger: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` (a table of files) with every found span replaced by ``mask``;
    columns as they were. Overlapping spans are masked once, as their union."""
    reserved(docs)
    names = docs.columns
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    body = F.col(f"`{text_col}`")
    text = F.coalesce(body, F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    hot = _append_unseen(docs.select(blob.alias("blob"), text.alias("text")), ledger, RULES, RULE_VERSION)
    found = _findings(spark, ledger, RULE_VERSION).select(F.col("blob").alias("_llm_blob"), F.col("spans").alias("_llm_spans"))
    walked = F.aggregate(
        "_llm_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(body, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))
            .otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.length(body))),
    )
    hot = None if hot is None else hot.withColumnRenamed("blob", "_llm_blob")
    joined = hot_join(docs.withColumn("_llm_blob", blob), found, hot, "_llm_blob", "left")
    masked = F.when(F.col("_llm_spans").isNull(), body).otherwise(walked)
    return joined.select(*[masked.alias(n) if n == text_col else F.col(f"`{n}`") for n in names])
