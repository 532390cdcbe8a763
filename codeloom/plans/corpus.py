"""Queries over the corpus tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.functions import text as T
from codeloom.lineage import spread
from codeloom.operators import corpus as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "benchmark_dataset").select("ProgramID", "Content"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sources(table(spark, sf_dir, "raw_sources"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _programs(spark, sf_dir).select("ProgramID", T.line_classes(T.normalise(F.col("Content"))).alias("l"))
    return rows.select("ProgramID", F.col("l.total").alias("total"), F.col("l.code").alias("code"), F.col("l.blank").alias("blank"), F.col("l.comment").alias("comments"))


def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _programs(spark, sf_dir).select("ProgramID", T.strip_comments(T.normalise(F.col("Content"))).alias("clean"))
    return rows.select("ProgramID", *[c.alias(n) for n, c in T.structure_counts(F.col("clean")).items()])


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _programs(spark, sf_dir).select("ProgramID", T.strip_comments(T.normalise(F.col("Content"))).alias("clean"))
    return rows.select("ProgramID", T.complexity(F.col("clean")).alias("complexity"))


def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _programs(spark, sf_dir).select("ProgramID", T.strip_comments(T.normalise(F.col("Content"))).alias("clean"))
    return rows.select("ProgramID", T.nesting_depth(F.col("clean")).alias("depth"))


def stl_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _programs(spark, sf_dir).select("ProgramID", T.stl_usage(F.col("Content")).alias("stl"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_sources")
    return rows.select("OriginalPath", F.sha2(F.col("Content").cast("binary"), 256).alias("sha"), F.octet_length("Content").cast("bigint").alias("bytes"), F.octet_length(T.normalise(F.col("Content"))).cast("bigint").alias("text_bytes"))


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.blanked(_sources(spark, sf_dir))
    return rows.select("path", T.has_main(F.col("blank")).alias("has_main"))


def test_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.blanked(_sources(spark, sf_dir))
    return rows.select("path", F.coalesce(T.test_framework(F.col("blank")), F.lit("")).alias("framework"))


def local_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.blanked(_sources(spark, sf_dir))
    return rows.select("path", F.explode(T.local_includes(F.col("stripped"))).alias("include")).groupBy("path", "include").agg(F.count("*").alias("n"))


def unresolved_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with includes that nothing answers, as the original reports them (none) and as they are."""
    src = _sources(spark, sf_dir)
    listing = table(spark, sf_dir, "raw_sources").select(F.col("OriginalPath").alias("path"))
    actual = C.unresolved(src, listing, False).withColumn("dep_actual", F.lit(True))
    # With strings blanked no include is left, so that column needs no scan.
    return src.select("path").join(actual, "path", "left").select("path", F.lit(False).alias("dep_reported"), F.coalesce("dep_actual", F.lit(False)).alias("dep_actual"))


def program_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(_sources(spark, sf_dir), "File").select("path", F.col("File").alias("rel"), "program_type")


def program_type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per class and file, with the class of files with unanswered includes, which may be in another one, too. Only
    executables are compiled."""
    src = _sources(spark, sf_dir)
    listing = table(spark, sf_dir, "raw_sources").select(F.col("OriginalPath").alias("path"))
    return C.type_table(C.classify(src, "File"), src.select("path", "File").join(C.unresolved(src, listing, False), "path", "left_semi"))


def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    listing = table(spark, sf_dir, "raw_sources").select(F.col("OriginalPath").alias("path"))
    return C.filter_report(C.classify(src), C.unresolved(src, listing, False))


def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that has the content of an earlier one."""
    files = table(spark, sf_dir, "documents").select(F.format_string("doc_%09d", "doc_id").alias("path"), F.col("text").alias("raw"))
    return C.duplicates(C.with_hash(files)).where("not is_unique").select("original", F.col("path").alias("duplicate"), "sha")


def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_summary(C.with_hash(table(spark, sf_dir, "documents").select(F.col("text").alias("raw"))))


def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repository_scan(table(spark, sf_dir, "raw_sources"), "Category", "Repository", "OriginalPath", "Content")


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repository_scan(spark, sf_dir)
    return rows.agg(F.sum("cpp_files").alias("files"), F.sum("total_loc").alias("loc"), F.round(F.sum("size_mb"), 6).alias("mb"))


def url_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "repository_statistics")
    return rows.select("RepositoryName", C.owner(F.coalesce("RepositoryURL", F.lit("unknown"))).alias("owner"))


def path_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_sources")
    return rows.select("OriginalPath", *[c.alias(n) for n, c in C.source_info(F.col("File")).items()], T.base_name(F.col("OriginalPath")).alias("name"), T.directory(F.col("OriginalPath")).alias("directory"))


def compile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "compile_report")
    made = C.compile_fields(F.col("Stderr"), F.col("ReturnCode"))
    out = rows.select("OriginalPath", "CompileTimeSeconds", *[c.alias(n) for n, c in made.items()])
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def compile_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "raw_sources").select(F.col("OriginalPath").alias("path"))
    return C.with_verdict(files, C.compile_verdicts(table(spark, sf_dir, "compile_report")))


def compile_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compile_verdicts(spark, sf_dir)
    return rows.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "PASS").alias("passed"), (F.count_if(F.col("status") == "PASS") * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental copy of the raw folder to a target that has an older state of every third file."""
    rows = table(spark, sf_dir, "raw_sources").select(F.col("File").alias("rel"), F.octet_length("Content").alias("length"))
    third = F.length("rel") % 3
    target = rows.where(third != 1).select("rel", F.when(third == 0, F.col("length")).otherwise(F.col("length") - 1).alias("length"))
    return C.copy_plan(rows, target).groupBy("action").agg(F.count("*").alias("files"))


def benchmark_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = C.compile_verdicts(table(spark, sf_dir, "compile_report"))
    return C.benchmark_set(_sources(spark, sf_dir), verdicts)


def source_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_sources").where(F.rlike("OriginalPath", F.lit(C.SOURCE_EXTENSION))).select(F.col("OriginalPath").alias("path"), "File", F.sha2(F.col("Content").cast("binary"), 256).alias("sha"))
    urls = table(spark, sf_dir, "repository_statistics").select(F.col("RepositoryName").alias("Repository"), F.col("RepositoryURL").alias("GitHubURL"))
    # The set that is mapped: what benchmark_ids builds, next to the given programs.
    built = benchmark_ids(spark, sf_dir).select("ProgramID", "Filename", "sha")
    given = table(spark, sf_dir, "benchmark_dataset").select(F.concat(F.lit("given_"), "ProgramID").alias("ProgramID"), "Filename", F.sha2(F.col("Content").cast("binary"), 256).alias("sha"))
    return C.source_mapping(built.unionByName(given), raw, urls)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every unique source with its class and verdict."""
    src = _sources(spark, sf_dir)
    unique = C.duplicates(C.with_hash(src)).where("is_unique").select("path", "sha")
    classes = C.classify(src).select("path", "program_type", (F.col("program_type") == "executable").alias("compile_eligible"))
    out = C.metrics(src, "path", "Category", "Repository").join(unique, "path").join(classes, "path", "left")
    out = C.with_verdict(out, C.compile_verdicts(table(spark, sf_dir, "compile_report")))
    return out.withColumn("program_type", F.coalesce("program_type", F.lit("unknown"))).withColumn("compile_eligible", F.coalesce("compile_eligible", F.lit(False)))


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_counts(spark, sf_dir)
    code = F.when(F.col("code") > 0, F.col("code"))
    return rows.agg(F.count("*").alias("programs"), F.round(F.coalesce(F.avg(code), F.lit(0.0)), 6).alias("avg_code"), F.coalesce(F.max(code), F.lit(0)).alias("max_code"))


def loc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs by lines of code, in bins of 50 (the width is ours)."""
    return line_counts(spark, sf_dir).groupBy(F.floor(F.col("code") / 50).cast("bigint").alias("bin")).agg(F.count("*").alias("programs"))


def dataset_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark_dataset")
    return rows.groupBy(F.coalesce("Category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("programs"), F.sum("FileSizeBytes").alias("bytes"))


def top_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark_dataset")
    return rows.groupBy("Repository").agg(F.count("*").alias("programs")).orderBy(F.desc("programs"), "Repository").limit(10)


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program_types(spark, sf_dir).groupBy("program_type").agg(F.count("*").alias("files"))


QUERIES = (
    line_counts, structure_counts, complexity, nesting_depth, stl_usage, content_hashes, entry_points, test_frameworks, local_includes, unresolved_deps, program_types, filter_report,
    dedup_report, dedup_summary, repository_scan, corpus_totals, url_owner, path_provenance, compile_fields, compile_verdicts, compile_pass_rate, copy_plan, benchmark_ids, source_mapping,
    program_type_table, metadata, dataset_summary, loc_histogram, dataset_distribution, top_repositories, class_distribution,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE = " || ".join(f"chr({ord(c)})" for c in X.WHITE_SPACE)
_TEXT = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"
_PROGRAMS = f"SELECT ProgramID, {_TEXT.format('Content')} AS t FROM benchmark_dataset"
_CLEAN = f"regexp_replace(regexp_replace({{0}}, {_q(X.BLOCK_COMMENT)}, ' ', 'gs'), {_q(X.LINE_COMMENT)}, ' ', 'g')"
_BLANK = f"regexp_replace({{0}}, {_q(X.STRING_LITERAL)}, '\"\"', 'g')"
_N = lambda c, p, o="": f"len(regexp_extract_all({c}, {_q((f'(?{o})' if o else '') + p)}))"

_LINE_TAIL = f"""
l AS (SELECT ProgramID, array_to_string(list_transform(list_transform(string_split(t, chr(10)), lambda x: trim(x, {_SPACE})), lambda x: CASE
    WHEN x = '' THEN 'b'
    WHEN starts_with(x, '//') AND contains(x, '*/') THEN 'S'
    WHEN starts_with(x, '//') THEN 's'
    WHEN contains(x, '/*') AND contains(x, '*/') THEN 'C'
    WHEN contains(x, '/*') THEN 'o'
    WHEN contains(x, '*/') THEN 'E'
    ELSE 'x' END), '') AS codes FROM p),
r AS (SELECT ProgramID, codes, regexp_replace(codes, 'o[^SCE]*[SCE]?', '', 'g') AS outside FROM l),
line_counts AS (SELECT ProgramID, length(codes) AS total, length(regexp_replace(outside, '[^xE]', '', 'g')) AS code,
  length(regexp_replace(codes, '[^b]', '', 'g')) AS blank,
  length(codes) - length(regexp_replace(codes, '[^b]', '', 'g')) - length(regexp_replace(outside, '[^xE]', '', 'g')) AS comments FROM r)
"""
_LINES = f"WITH p AS ({_PROGRAMS}),{_LINE_TAIL}"

_SRC = f"""
src AS (SELECT OriginalPath AS path, File, Category, Repository, Content AS raw, {_TEXT.format('Content')} AS t FROM raw_sources
  WHERE regexp_matches(lower(OriginalPath), {_q(C.SOURCE_EXTENSION)}) AND NOT contains(OriginalPath, '/.git/') AND Content IS NOT NULL),
strip AS (SELECT *, {_CLEAN.format('t')} AS stripped FROM src),
blank AS (SELECT *, {_BLANK.format('stripped')} AS blanked FROM strip),
marked AS (SELECT *, {' OR '.join(f"regexp_matches(blanked, {_q(p)})" for p in X.MAIN_PATTERNS)} AS has_main,
  CASE {' '.join(f"WHEN regexp_matches(blanked, {_q(p)}) THEN {_q(n)}" for n, p in X.TEST_FRAMEWORKS)} ELSE '' END AS framework FROM blank),
classes AS (SELECT path, File AS rel, CASE WHEN framework <> '' THEN 'test' WHEN has_main THEN 'executable' ELSE 'library' END AS program_type FROM marked WHERE length(t) > 0),
inc AS (SELECT path, unnest(regexp_extract_all(stripped, {_q('(?m)' + X.LOCAL_INCLUDE)}, 1)) AS include FROM strip),
names AS (SELECT DISTINCT regexp_extract(OriginalPath, '[^/]*$') AS name FROM raw_sources),
dep AS (SELECT DISTINCT path FROM inc WHERE include <> '{X.ALWAYS_PRESENT_HEADER}' AND NOT starts_with(include, '<') AND regexp_extract(include, '[^/]*$') NOT IN (SELECT name FROM names)),
verdicts AS (SELECT OriginalPath AS path, CASE WHEN min(CASE WHEN Status = 'PASS' THEN 1 ELSE 0 END) = 1 THEN 'PASS' ELSE 'FAIL' END AS status, max(CompileTimeSeconds) AS seconds FROM compile_report WHERE OriginalPath IS NOT NULL GROUP BY 1),
uniq AS (SELECT sha256(raw) AS sha, min(path) AS path FROM src GROUP BY 1),
built AS (SELECT row_number() OVER (ORDER BY u.path) AS n, u.path, sha FROM uniq u JOIN classes c ON c.path = u.path AND program_type = 'executable' JOIN verdicts v ON v.path = u.path AND status = 'PASS'),
bench AS (SELECT printf('program_%06d', n) AS ProgramID, printf('program_%06d.cpp', n) AS Filename, path AS OriginalSource, sha FROM built)
"""

_REPO = f"""
WITH f AS (SELECT Category, Repository, octet_length(encode(Content)) AS bytes, lower(OriginalPath) AS p, {_TEXT.format('Content')} AS t FROM raw_sources),
g AS (SELECT *, regexp_matches(p, {_q(C.SOURCE_EXTENSION)}) AS s, regexp_matches(p, {_q(C.HEADER_EXTENSION)}) AS h,
  CASE WHEN length(t) = 0 THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN ends_with(t, chr(10)) THEN 0 ELSE 1 END END AS loc FROM f),
repo AS (SELECT Category, Repository, sum(bytes) / 1048576.0 AS size_mb, count(*) FILTER (s) AS cpp_files, count(*) FILTER (h) AS header_files,
  coalesce(sum(loc) FILTER (s), 0)::BIGINT AS total_loc, coalesce(sum(loc) FILTER (s), 0)::BIGINT / greatest(count(*) FILTER (s), 1) AS average_loc,
  coalesce(max(loc) FILTER (s), 0) AS maximum_loc, bool_or(starts_with(regexp_extract(p, '[^/]*$'), 'readme')) AS readme_exists FROM g GROUP BY ALL)
"""

_DEDUP = "WITH d AS (SELECT printf('doc_%09d', doc_id) AS path, sha256(text) AS sha FROM documents)"
_COUNTS = {
    "functions": _N("c", X.FUNCTION),
    "loops": f"{_N('c', X.FOR)} + {_N('c', X.WHILE)}",
    "conditionals": f"{_N('c', X.IF)} + {_N('c', X.ELSE_IF)} + {_N('c', X.SWITCH)}",
    "classes": _N("c", X.CLASS),
    "namespaces": _N("c", X.NAMESPACE),
    "templates": _N("c", X.TEMPLATE),
    "lambdas": _N("c", X.LAMBDA),
    "includes": _N("c", X.INCLUDE, "m"),
    "returns": _N("c", X.RETURN),
}
_DEPTH_TAIL = """
ch AS (SELECT ProgramID, unnest(string_split(b, '')) AS x, generate_subscripts(string_split(b, ''), 1) AS i FROM (SELECT ProgramID, regexp_replace(c, '[^{}]', '', 'g') AS b FROM k)),
s AS (SELECT ProgramID, sum(CASE x WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY ProgramID ORDER BY i) AS d FROM ch),
depths AS (SELECT k.ProgramID, greatest(0, coalesce(max(d), 0))::INT AS depth FROM k LEFT JOIN s USING (ProgramID) GROUP BY ALL)
"""
_STL = "coalesce(nullif(array_to_string(list_filter([" + ", ".join(map(_q, sorted(X.STL_TOKENS))) + "], lambda w: contains(lower({0}), w)), ', '), ''), 'none')"
_CLEANED = f"WITH k AS (SELECT ProgramID, {_CLEAN.format('t')} AS c FROM ({_PROGRAMS}))"

SQL = {
    "line_counts": _LINES + "SELECT * FROM line_counts",
    "structure_counts": _CLEANED + "SELECT ProgramID, " + ", ".join(f"{s} AS {n}" for n, s in _COUNTS.items()) + " FROM k",
    "complexity": _CLEANED + f"SELECT ProgramID, 1 + {_N('c', X.DECISION_NO_CASE)} AS complexity FROM k",
    "nesting_depth": f"{_CLEANED},{_DEPTH_TAIL} SELECT * FROM depths",
    "stl_usage": f"SELECT ProgramID, {_STL.format('Content')} AS stl FROM benchmark_dataset",
    "content_hashes": f"SELECT OriginalPath, sha256(Content) AS sha, octet_length(encode(Content)) AS bytes, octet_length(encode({_TEXT.format('Content')})) AS text_bytes FROM raw_sources",
    "entry_points": f"WITH {_SRC} SELECT path, has_main FROM marked",
    "test_frameworks": f"WITH {_SRC} SELECT path, framework FROM marked",
    "local_includes": f"WITH {_SRC} SELECT path, include, count(*) AS n FROM inc GROUP BY ALL",
    "unresolved_deps": f"WITH {_SRC} SELECT path, false AS dep_reported, path IN (SELECT path FROM dep) AS dep_actual FROM src",
    "program_types": f"WITH {_SRC} SELECT * FROM classes",
    "program_type_table": f"WITH {_SRC} SELECT path, rel AS File, program_type, CASE WHEN program_type = 'executable' THEN 'TRUE' ELSE 'FALSE' END AS compile_eligible FROM classes UNION ALL SELECT path, File, 'dependency', 'FALSE' FROM raw_sources JOIN dep ON path = OriginalPath",
    "filter_report": f"""WITH {_SRC}, n AS (SELECT count(*) FILTER (program_type = 'executable') AS e, count(*) FILTER (program_type = 'library') AS l, count(*) FILTER (program_type = 'test') AS t, (SELECT count(*) FROM dep) AS d FROM classes)
      SELECT unnest(['OriginalCPPFiles', 'ExecutablePrograms', 'Remove_LibraryFiles', 'Remove_TestFiles', 'Remove_DependencyFiles', 'Remaining_BenchmarkPrograms', 'FilterRate', 'distinct_total']) AS metric,
      unnest([(e + l + t + d)::DOUBLE, e::DOUBLE, l::DOUBLE, t::DOUBLE, d::DOUBLE, e::DOUBLE, e * 100.0::DOUBLE / greatest(e + l + t + d, 1), (e + l + t)::DOUBLE]) AS value FROM n""",
    "dedup_report": _DEDUP + ", o AS (SELECT sha, min(path) AS original FROM d GROUP BY 1) SELECT original, path AS duplicate, sha FROM d JOIN o USING (sha) WHERE path <> original",
    "dedup_summary": _DEDUP + ", n AS (SELECT count(*)::DOUBLE AS a, count(DISTINCT sha)::DOUBLE AS u FROM d) SELECT unnest(['TotalFiles', 'UniqueFiles', 'DuplicateFiles', 'DuplicateRatio']) AS metric, unnest([a, u, a - u, (a - u) / greatest(a, 1.0) * 100]) AS value FROM n",
    "repository_scan": _REPO + "SELECT * FROM repo",
    "corpus_totals": _REPO + "SELECT sum(cpp_files)::BIGINT AS files, sum(total_loc)::BIGINT AS loc, round(sum(size_mb), 6) AS mb FROM repo",
    "url_owner": "SELECT RepositoryName, coalesce(list_filter(string_split(RepositoryURL, '/'), lambda p: p <> '' AND NOT starts_with(p, 'http') AND NOT contains(p, 'github') AND NOT contains(p, '.'))[1], 'unknown') AS owner FROM repository_statistics",
    "path_provenance": "SELECT OriginalPath, CASE WHEN len(string_split(File, '/')) > 1 THEN string_split(File, '/')[1] ELSE 'unknown' END AS category, CASE WHEN len(string_split(File, '/')) > 2 THEN string_split(File, '/')[2] ELSE 'unknown' END AS repository, regexp_extract(OriginalPath, '[^/]*$') AS name, regexp_replace(OriginalPath, '/?[^/]*$', '') AS directory FROM raw_sources",
    "compile_fields": "SELECT OriginalPath, CompileTimeSeconds, len(regexp_extract_all(lower(coalesce(Stderr, '')), 'warning:')) AS warnings, len(regexp_extract_all(lower(coalesce(Stderr, '')), 'error:')) AS errors, substr(Stderr, 1, 200) AS stderr, CASE WHEN ReturnCode = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n FROM compile_report GROUP BY ALL",
    "compile_verdicts": f"WITH {_SRC} SELECT OriginalPath AS path, coalesce(status, 'FAIL') AS status, coalesce(seconds, 0.0) AS seconds FROM raw_sources LEFT JOIN verdicts ON path = OriginalPath",
    "compile_pass_rate": f"WITH {_SRC} SELECT count(*) AS files, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'PASS') * 100.0::DOUBLE / greatest(count(*), 1) AS rate FROM raw_sources LEFT JOIN verdicts ON path = OriginalPath",
    "copy_plan": "SELECT CASE WHEN length(File) % 3 = 0 THEN 'skipped' ELSE 'copied' END AS action, count(*) AS files FROM raw_sources GROUP BY 1",
    "benchmark_ids": f"WITH {_SRC} SELECT * FROM bench",
    "source_mapping": f"""WITH {_SRC},
      raw AS (SELECT File, regexp_extract(OriginalPath, '[^/]*$') AS name, sha256(Content) AS sha FROM raw_sources WHERE regexp_matches(OriginalPath, {_q(C.SOURCE_EXTENSION)})),
      wanted AS (SELECT ProgramID, Filename, sha FROM bench UNION ALL SELECT 'given_' || ProgramID, Filename, sha256(Content) FROM benchmark_dataset),
      hit AS (SELECT ProgramID, coalesce(min(File) FILTER (name = Filename), min(File)) AS File FROM wanted LEFT JOIN raw USING (sha) GROUP BY ProgramID),
      named AS (SELECT ProgramID, coalesce(File, 'unknown') AS OriginalPath, CASE WHEN len(string_split(File, '/')) > 1 THEN string_split(File, '/')[1] ELSE 'unknown' END AS Category, CASE WHEN len(string_split(File, '/')) > 2 THEN string_split(File, '/')[2] ELSE 'unknown' END AS Repository FROM hit)
      SELECT ProgramID, OriginalPath, Category, Repository, coalesce(RepositoryURL, 'unknown') AS GitHubURL FROM named LEFT JOIN repository_statistics ON RepositoryName = Repository""",
    "metadata": f"""WITH {_SRC}, p AS (SELECT path AS ProgramID, t FROM src), {_LINE_TAIL}, k AS (SELECT path AS ProgramID, stripped AS c, t FROM strip), {_DEPTH_TAIL}
      SELECT u.path, f.Category, f.Repository, n.total AS total_lines, n.code AS code_lines, n.blank AS blank_lines, n.comments AS comment_lines, {", ".join(f"{q} AS {n}" for n, q in _COUNTS.items())},
      1 + {_N("c", X.DECISION_NO_CASE)} AS complexity, d.depth AS nesting_depth, {_STL.format("k.t")} AS stl_usage, u.sha, coalesce(l.program_type, 'unknown') AS program_type, coalesce(l.program_type = 'executable', false) AS compile_eligible, coalesce(v.status, 'FAIL') AS status, coalesce(v.seconds, 0.0) AS seconds
      FROM uniq u JOIN src f ON f.path = u.path JOIN k ON k.ProgramID = u.path JOIN line_counts n ON n.ProgramID = u.path JOIN depths d ON d.ProgramID = u.path LEFT JOIN classes l ON l.path = u.path LEFT JOIN verdicts v ON v.path = u.path""",
    "dataset_summary": _LINES + "SELECT count(*) AS programs, round(coalesce(avg(CASE WHEN code > 0 THEN code END), 0.0), 6) AS avg_code, coalesce(max(CASE WHEN code > 0 THEN code END), 0) AS max_code FROM line_counts",
    "loc_histogram": _LINES + "SELECT (code // 50)::BIGINT AS bin, count(*) AS programs FROM line_counts GROUP BY 1",
    "dataset_distribution": "SELECT coalesce(Category, 'unknown') AS category, count(*) AS programs, sum(FileSizeBytes)::BIGINT AS bytes FROM benchmark_dataset GROUP BY 1",
    "top_repositories": "SELECT Repository, count(*) AS programs FROM benchmark_dataset GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "class_distribution": f"WITH {_SRC} SELECT program_type, count(*) AS files FROM classes GROUP BY 1",
}
