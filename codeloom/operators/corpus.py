"""The corpus pipeline over one row per source file: metrics, classes, exact duplicates, provenance, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import fixed as X
from codeloom.functions import text as T
from codeloom.lineage import checkpointed, fenced, partitions_for, spread, stored

SOURCE_EXTENSION = r"[.](cpp|cc|cxx)$"
HEADER_EXTENSION = r"[.](h|hpp|hh|hxx)$"


def sources(files: DataFrame, path: str = "OriginalPath", content: str = "Content") -> DataFrame:
    """The C++ sources among the files (extension in any case, nothing below .git) as (path, raw, text)."""
    p = F.col(path)
    return spread(files).where(F.rlike(F.lower(p), F.lit(SOURCE_EXTENSION)) & ~F.contains(p, F.lit("/.git/")) & F.col(content).isNotNull()).select("*", p.alias("path"), F.col(content).alias("raw"), T.normalise(F.col(content)).alias("text"))


def metrics(src: DataFrame, *keep: str) -> DataFrame:
    """All metrics of each source. Comments are stripped once; the text columns end here."""
    clean = src.select(*keep, "text", T.strip_comments(F.col("text")).alias("clean"))
    counts = T.structure_counts(F.col("clean"))
    out = clean.select(*keep, T.line_classes(F.col("text")).alias("l"), *[c.alias(n) for n, c in counts.items()], T.complexity(F.col("clean")).alias("complexity"), T.nesting_depth(F.col("clean")).alias("nesting_depth"), T.stl_usage(F.col("text")).alias("stl_usage"))
    return out.select(*keep, F.col("l.total").alias("total_lines"), F.col("l.code").alias("code_lines"), F.col("l.blank").alias("blank_lines"), F.col("l.comment").alias("comment_lines"), *counts, "complexity", "nesting_depth", "stl_usage")


def blanked(src: DataFrame, *keep: str) -> DataFrame:
    """Adds ``stripped`` (no comments) and ``blank`` (no comments, empty strings)."""
    rows = src.select(*keep, "path", "text", T.strip_comments(F.col("text")).alias("stripped")).select(*keep, "path", "text", "stripped", T.blank_strings(F.col("stripped")).alias("blank"))
    return fenced(rows, [*keep, "path", "text"], ["stripped", "blank"])


def classify(src: DataFrame, *keep: str) -> DataFrame:
    """(path, program_type, framework): test before executable before library; empty texts have no class."""
    rows = blanked(src, *keep).where("length(text) > 0")
    framework = T.test_framework(F.col("blank"))
    kind = F.when(F.col("framework").isNotNull(), "test").when(F.col("entry"), "executable").otherwise("library")
    rows = rows.select(*keep, "path", framework.alias("framework"), T.has_main(F.col("blank")).alias("entry"))
    return fenced(rows, [*keep, "path"], ["framework", "entry"]).select(*keep, "path", kind.alias("program_type"), "framework", "entry")


def type_table(classes: DataFrame, dependency: DataFrame) -> DataFrame:
    """(path, File, program_type, compile_eligible) of all classes; ``dependency`` (path, File) is a class of its own."""
    rows = classes.select("path", "File", "program_type").unionByName(dependency.select("path", "File", F.lit("dependency").alias("program_type")))
    return rows.withColumn("compile_eligible", F.when(F.col("program_type") == "executable", "TRUE").otherwise("FALSE"))


def unresolved(src: DataFrame, listing: DataFrame, reported: bool) -> DataFrame:
    """(path): sources with a local include that no file answers: not next to it, not by path, not by name anywhere.

    ``reported`` looks at text whose strings are blanked, as the original does, so that quoted paths are gone and
    nothing is ever found; otherwise only comments are stripped. ``listing`` (path) has all files.
    """
    rows = blanked(src)
    found = rows.select("path", F.explode(T.local_includes(F.col("blank" if reported else "stripped"))).alias("inc"))
    found = found.where((F.col("inc") != X.ALWAYS_PRESENT_HEADER) & ~F.startswith(F.col("inc"), F.lit("<")))
    near = found.withColumn("target", T.normal_path(F.concat_ws("/", T.directory(F.col("path")), F.col("inc"))))
    files = listing.select(F.col("path").alias("target")).distinct()
    names = listing.select(T.base_name(F.col("path")).alias("name")).distinct()
    left = near.join(files, "target", "left_anti")
    left = left.withColumn("name", T.base_name(F.col("inc"))).join(names, "name", "left_anti")
    return left.select("path").distinct()


def with_hash(files: DataFrame, content: str = "raw") -> DataFrame:
    return files.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256))


def duplicates(hashed: DataFrame, path: str = "path") -> DataFrame:
    """(path, sha, original, is_unique): the smallest path of equal contents stands for them.

    An aggregate by hash and a join back: an aggregate combines before the shuffle, so a hash that very many files
    share is no single task, as a window over it would be.
    """
    first = hashed.groupBy("sha").agg(F.min(path).alias("original"))
    return hashed.select(path, "sha").join(first, "sha").select(path, "sha", "original", (F.col(path) == F.col("original")).alias("is_unique"))


def dedup_summary(hashed: DataFrame) -> DataFrame:
    """(metric, value) of totals and the ratio of duplicates in percent."""
    by_hash = hashed.groupBy("sha").count()
    one = by_hash.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("TotalFiles"), F.count("*").cast("double").alias("UniqueFiles"))
    one = one.withColumn("DuplicateFiles", F.col("TotalFiles") - F.col("UniqueFiles")).withColumn("DuplicateRatio", F.col("DuplicateFiles") / F.greatest("TotalFiles", F.lit(1.0)) * 100)
    return one.unpivot([], ["TotalFiles", "UniqueFiles", "DuplicateFiles", "DuplicateRatio"], "metric", "value")


def filter_report(classes: DataFrame, dependency: DataFrame) -> DataFrame:
    """(metric, value). The total adds up the classes and the warnings, as the original does; ``distinct_total`` is right."""
    counts = classes.agg(F.count_if(F.col("program_type") == "executable").alias("executable"), F.count_if(F.col("program_type") == "library").alias("library"), F.count_if(F.col("program_type") == "test").alias("test"))
    both = counts.crossJoin(dependency.agg(F.count("*").alias("dependency")))
    d = lambda c: c.cast("double")
    total = F.col("executable") + F.col("library") + F.col("test") + F.col("dependency")
    one = both.select(
        d(total).alias("OriginalCPPFiles"),
        d(F.col("executable")).alias("ExecutablePrograms"),
        d(F.col("library")).alias("Remove_LibraryFiles"),
        d(F.col("test")).alias("Remove_TestFiles"),
        d(F.col("dependency")).alias("Remove_DependencyFiles"),
        d(F.col("executable")).alias("Remaining_BenchmarkPrograms"),
        (F.col("executable") * 100.0 / F.greatest(total, F.lit(1))).alias("FilterRate"),
        d(total - F.col("dependency")).alias("distinct_total"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def source_info(path: Column) -> dict[str, Column]:
    """Category and repository by position in a path below the raw folder."""
    parts = F.split(path, "/")
    known = lambda i: F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i)))
    return {"category": F.coalesce(known(0), F.lit("unknown")), "repository": F.coalesce(known(1), F.lit("unknown"))}


def repository_scan(files: DataFrame, category: str, repository: str, path: str, content: str) -> DataFrame:
    """Per repository: size of all its files in MB, sources with their lines, headers, and whether there is a read-me."""
    low = F.lower(F.col(path))
    is_source, is_header = F.rlike(low, F.lit(SOURCE_EXTENSION)), F.rlike(low, F.lit(HEADER_EXTENSION))
    # Without the last line end: a text file that ends in one has as many lines as line ends.
    lines = F.size(F.split(F.regexp_replace(T.normalise(F.col(content)), r"\n\z", ""), "\n", -1)) * F.when(F.length(content) > 0, 1).otherwise(0)
    rows = files.select(category, repository, F.octet_length(content).alias("bytes"), is_source.alias("s"), is_header.alias("h"), F.when(is_source, lines).alias("loc"), F.startswith(F.lower(T.base_name(F.col(path))), F.lit("readme")).alias("readme"))
    out = rows.groupBy(category, repository).agg(F.sum("bytes").alias("bytes"), F.count_if("s").alias("cpp_files"), F.count_if("h").alias("header_files"), F.coalesce(F.sum("loc"), F.lit(0)).cast("bigint").alias("total_loc"), F.coalesce(F.max("loc"), F.lit(0)).alias("maximum_loc"), F.max("readme").alias("readme_exists"))
    return out.select(category, repository, (F.col("bytes") / (1024.0 * 1024.0)).alias("size_mb"), "cpp_files", "header_files", "total_loc", (F.col("total_loc") / F.greatest("cpp_files", F.lit(1))).alias("average_loc"), "maximum_loc", "readme_exists")


def owner(url: Column) -> Column:
    """First part of a URL that is neither the scheme nor a host; "unknown" for others, as for user@host:path forms."""
    good = F.filter(F.split(url, "/"), lambda p: (p != "") & ~F.startswith(p, F.lit("http")) & ~F.contains(p, F.lit("github")) & ~F.contains(p, F.lit(".")))
    return F.coalesce(F.when(url != "unknown", F.get(good, F.lit(0))), F.lit("unknown"))


def program_id(n: Column) -> Column:
    return F.format_string("program_%06d", n)


def number(df: DataFrame, order: str, into: str = "n") -> DataFrame:
    """Dense numbers from 1 in the order of a unique column, without one task for all rows: rows are range partitioned
    and sorted, and each partition starts after the counts of those before it (one row per partition)."""
    placed = stored(df.repartitionByRange(partitions_for(df), order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    starts = placed.groupBy("_p").agg(F.count("*").alias("c"), F.min("_i").alias("_lo"))
    starts = starts.select("_p", "_lo", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn(into, F.col("_i") - F.col("_lo") + F.col("_s") + 1).drop("_p", "_i", "_lo", "_s")


def source_mapping(programs: DataFrame, raw: DataFrame, urls: DataFrame) -> DataFrame:
    """(ProgramID, OriginalPath, Category, Repository, GitHubURL): the raw file with the same content, one of the same name
    first, else the smallest path; "unknown" where there is none. ``raw`` is (path, File, sha), ``programs`` (ProgramID, Filename, sha)."""
    info = source_info(F.col("File"))
    best = raw.groupBy("sha", T.base_name(F.col("path")).alias("name")).agg(F.min("File").alias("File"))
    any_name = best.groupBy("sha").agg(F.min("File").alias("any_file"))
    hit = programs.join(any_name, "sha", "left").join(best.withColumnRenamed("name", "Filename"), ["sha", "Filename"], "left")
    hit = hit.select("ProgramID", F.coalesce("File", "any_file").alias("File"))
    hit = hit.select("ProgramID", F.coalesce("File", F.lit("unknown")).alias("OriginalPath"), *[F.when(F.col("File").isNull(), "unknown").otherwise(c).alias(n) for n, c in (("Category", info["category"]), ("Repository", info["repository"]))])
    return hit.join(urls, "Repository", "left").select("ProgramID", "OriginalPath", "Category", "Repository", F.coalesce("GitHubURL", F.lit("unknown")).alias("GitHubURL"))


def compile_verdicts(reports: DataFrame) -> DataFrame:
    """One row per path out of reports that may come twice: PASS only if every report says so, with the longest time."""
    return reports.where("OriginalPath is not null").groupBy("OriginalPath").agg(F.min(F.when(F.col("Status") == "PASS", 1).otherwise(0)).alias("ok"), F.max("CompileTimeSeconds").alias("seconds")).select(F.col("OriginalPath").alias("path"), F.when(F.col("ok") == 1, "PASS").otherwise("FAIL").alias("status"), "seconds")


def with_verdict(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds status ("FAIL" where there is no report) and seconds (0)."""
    return files.join(verdicts, "path", "left").withColumn("status", F.coalesce("status", F.lit("FAIL"))).withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def compile_fields(stderr: Column, code: Column) -> dict[str, Column]:
    """Counts of messages, the text cut to 200 characters, and the status."""
    low = F.lower(F.coalesce(stderr, F.lit("")))
    return {"warnings": F.regexp_count(low, F.lit("warning:")), "errors": F.regexp_count(low, F.lit("error:")), "stderr": F.substring(stderr, 1, 200), "status": F.when(code == 0, "PASS").otherwise("FAIL")}


def copy_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """(rel, action): files whose size at the target is the same are skipped."""
    joined = source.join(target.select("rel", F.col("length").alias("there")), "rel", "left")
    return joined.select("rel", F.when(F.col("there") == F.col("length"), "skipped").otherwise("copied").alias("action"))


def benchmark_set(src: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The numbered data set: executable, unique by content and compiled, in the order of the paths."""
    unique = duplicates(with_hash(src)).where("is_unique").select("path", "sha")
    runnable = classify(src).where("program_type = 'executable'").select("path")
    passed = verdicts.where("status = 'PASS'").select("path")
    # Paths and hashes only; what follows sorts and numbers them, and must see one state of them.
    chosen = checkpointed(unique.join(runnable, "path", "left_semi").join(passed, "path", "left_semi"))
    return number(chosen, "path").select(program_id(F.col("n")).alias("ProgramID"), F.concat(program_id(F.col("n")), F.lit(".cpp")).alias("Filename"), F.col("path").alias("OriginalSource"), "sha")
