"""The queries of this subpackage, each over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import documented, format_copies, language, leaks, near_duplicates, packing, percentiles, pii, shared_spans, syntax

METRICS = ["TranslationTime", "CompileTime", "RuntimeTime"]
VOCABULARY = f"{packing.TOKENIZERS}/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark_dataset", "ProgramID", "Content")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = percentiles.program_percentiles(table(spark, sf_dir, "experiment_results"), "Program", METRICS)
    return out.select("Program", "metric", "n", *[F.round(c, 6).alias(c) for c in out.columns if c[0] == "p" and c[1:].isdigit()])


def p1_percentiles_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all days, put together from mergeable counts per half of the run."""
    rows = table(spark, sf_dir, "experiment_results")
    rows = percentiles.deduplicate(rows, ["Program", "FinishedAt", *METRICS])
    early = F.coalesce(F.to_date("FinishedAt") < F.lit("2025-03-01"), F.lit(False))
    parts = [percentiles.value_counts(percentiles.measurements(rows.where(c), "Program", METRICS)) for c in (early, ~early)]
    tall = percentiles.percentiles(percentiles.merge(*parts), (50.0, 90.0))
    return tall.select(F.col("g").alias("Program"), "metric", "n", "percent", F.round("value", 6).alias("value"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.found(programs(spark, sf_dir), "ProgramID", "Content")


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.collapsed(programs(spark, sf_dir), "ProgramID", "Content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documented.documented_functions(programs(spark, sf_dir), "ProgramID", "Content", code=False)
    return out.select(F.col("k").alias("program_id"), F.col("name").alias("function_name")).distinct()


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documented.documented_functions(programs(spark, sf_dir), "ProgramID", "Content")
    return out.select(F.col("k").alias("program_id"), F.col("name").alias("function_name"), "description", "code")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(programs(spark, sf_dir), "ProgramID", "Content", threshold=0.7)
    return pairs.select(F.col("a").alias("program_a"), F.col("b").alias("program_b")).distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates.near_duplicate_groups(programs(spark, sf_dir), "ProgramID", "Content", threshold=0.7)
    return out.select(F.col("k").alias("program_id"), "class_rep", "group", "links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = shared_spans.sharing_pairs(programs(spark, sf_dir), "ProgramID", "Content", 300)
    return pairs.withColumnsRenamed({"a": "program_a", "b": "program_b"})


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_spans.shared_spans(programs(spark, sf_dir), "ProgramID", "Content", 300)
    return out.withColumnRenamed("k", "program_id")


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_spans.stretches(programs(spark, sf_dir), "ProgramID", "Content", 300)
    return out.withColumnRenamed("k", "program_id")


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_spans.partner_stretches(programs(spark, sf_dir), "ProgramID", "Content", 300)
    return out.withColumnsRenamed({"k": "program_id", "partner": "partner_id"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "raw_sources", "OriginalPath", "Content")
    return syntax.found(files, "OriginalPath", "Content").withColumnRenamed("path", "original_path")


def p6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every file, in the order in which the parser met them; the first one is the cause."""
    files = table(spark, sf_dir, "raw_sources", "OriginalPath", "Content")
    rows = syntax.parsed(files, "OriginalPath", "Content").where("fails").select("path", "language", F.posexplode("errors").alias("place", "e"))
    return rows.select(F.col("path").alias("original_path"), "language", "place", F.col("e.line").alias("line"), F.col("e.message").alias("message"), (F.col("place") == 0).alias("is_cause"))


def p6_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and accepted files of each language, and of each first cause that rejects them."""
    return syntax.acceptance(table(spark, sf_dir, "raw_sources", "OriginalPath", "Content"), "OriginalPath", "Content")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "raw_sources", "OriginalPath", "Repository", "Content")
    reports = table(spark, sf_dir, "compile_report", "OriginalPath", "ErrorCount", "ReturnCode")
    return syntax.rates(files, "OriginalPath", "Content", "Repository", reports)


def _model(spark: SparkSession, sf_dir: str) -> language.Model:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.fit(programs(spark, sf_dir), "ProgramID", "Content", docs, "doc_id", "text", "lang")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = language.language_words(programs(spark, sf_dir), "ProgramID", "Content", _model(spark, sf_dir))
    return words.where("n >= 25").select(F.col("k").alias("program_id"), "lang")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.shares(programs(spark, sf_dir), "ProgramID", "Content", _model(spark, sf_dir))
    return out.select(F.col("k").alias("program_id"), "lang", F.col("n").alias("words"), "share", "chars", "file_share")


def p7_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.prose(programs(spark, sf_dir), "ProgramID", "Content", _model(spark, sf_dir))
    return out.select(F.col("k").alias("program_id"), "start", "end", "lang", F.col("n").alias("words"), "sentence")


#: Kinds of documents that p8_mixture wants in equal parts.
P8_TARGETS = {kind: 1.0 for kind in ("readme", "issue", "report", "repair_log", "editorial", "review")}


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = packing.pack(packing.token_counts(docs, "doc_id", "text", "source", VOCABULARY), 2048)
    return out.select("container", F.col("k").alias("doc_id"), "source", "start", F.col("n").alias("n_tokens"))


def _by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed to target proportions of the kinds, in windows of 64 containers."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "doc_kind")
    return packing.pack(packing.token_counts(docs, "doc_id", "text", "doc_kind", VOCABULARY), 2048, 64, P8_TARGETS)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached shares of each kind of document."""
    out = packing.mixture(_by_kind(spark, sf_dir), P8_TARGETS)
    return out.select(F.col("source").alias("doc_kind"), "windows", *[F.round(c, 6).alias(c) for c in ("target", "least", "mean", "most")])


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each window are."""
    return packing.fill(_by_kind(spark, sf_dir)).select("window", "containers", "tokens", F.round("fill", 6).alias("fill"))


def _leaks(spark: SparkSession, sf_dir: str, spans: bool) -> DataFrame:
    items = table(spark, sf_dir, "eval_items", "item_id", "text")
    return leaks.leaks(documents(spark, sf_dir), items, "doc_id", "text", "item_id", ["text"], 20, spans)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, False).select(F.col("k").alias("doc_id"), F.col("item").alias("item_id"))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, True).select(F.col("k").alias("doc_id"), F.col("item").alias("item_id"), "start", "end", "words")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir), "doc_id", "text").select(F.col("k").alias("doc_id"), F.col("type").alias("pii_type"), F.col("item").alias("pii_text"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("k", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_percentiles, p1_percentiles_of_days, p2_found, p2_collapsed, p3_found, p3_pairs, p4_found, p4_groups, p5_found, p5_shared, p5_stretches, p5_spans, p6_found, p6_errors, p6_acceptance, p6_rates, p7_found, p7_shares, p7_prose, p8_packed, p8_mixture, p8_fill, p9_found, p9_passages, p10_found, p10_redacted)
    return {f.__name__: f for f in every}


_P1_ROWS = """
WITH rows AS (SELECT DISTINCT * FROM experiment_results),
long AS (
  SELECT Program, 'TranslationTime' AS metric, TranslationTime AS v FROM rows
  UNION ALL SELECT Program, 'CompileTime', CompileTime FROM rows
  UNION ALL SELECT Program, 'RuntimeTime', RuntimeTime FROM rows),
good AS (SELECT * FROM long WHERE v >= 0 AND v::VARCHAR NOT IN ('nan', 'inf'))
"""

_P2_KEYS = r"""
WITH t AS (SELECT ProgramID AS k, regexp_replace(Content, '^\s+', '') AS c FROM benchmark_dataset WHERE ProgramID IS NOT NULL AND Content IS NOT NULL),
h AS (SELECT k, c, CASE WHEN starts_with(c, '/*') THEN regexp_extract(c, '^/\*(?s:.*?)\*/', 0) ELSE regexp_extract(c, '^(?:[ \t]*//[^\r\n]*(?:\r\n|\n|\r|$))+', 0) END AS head FROM t),
l AS (SELECT k, regexp_split_to_array(head, '\r\n|\n|\r') AS hl, regexp_split_to_array(substr(c, length(head) + 1), '\r\n|\n|\r') AS rl FROM h),
n AS (SELECT k,
  list_sort(list_filter(list_transform(hl, lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g'))), lambda x: x <> '')) AS head,
  list_sort(list_transform(list_filter(rl, lambda x: regexp_matches(x, '^\s*#\s*include\b')), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')))) AS inc,
  lower(regexp_replace(array_to_string(list_filter(rl, lambda x: NOT regexp_matches(x, '^\s*#\s*include\b')), ''), '[^\p{L}\p{N}]', '', 'g')) AS body FROM l),
g AS (SELECT k, min(k) OVER (PARTITION BY head, inc, body) AS first_id FROM n)
"""

_P9 = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS i FROM iw WHERE len(w) >= 20)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM dw WHERE len(w) >= 20))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def oracle_sql() -> dict[str, str]:
    quantiles = ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p:g}" for p in percentiles.PERCENTS)
    return {
        "p1_percentiles": _P1_ROWS + f"SELECT Program, metric, count(*) AS n, {quantiles} FROM good GROUP BY ALL",
        "p1_percentiles_of_days": _P1_ROWS + "SELECT Program, metric, count(*) AS n, 50.0::DOUBLE AS percent, round(quantile_cont(v, 0.5), 6) AS value FROM good GROUP BY ALL UNION ALL SELECT Program, metric, count(*), 90.0::DOUBLE, round(quantile_cont(v, 0.9), 6) FROM good GROUP BY ALL",
        "p2_found": _P2_KEYS + "SELECT first_id, k AS copy_id FROM g WHERE first_id <> k",
        "p2_collapsed": _P2_KEYS + "SELECT first_id, count(*) AS copies FROM g GROUP BY ALL",
        "p9_found": _P9,
    }
