"""Source files that do not parse (problem 6): recursive descent, precedence climbing, panic-mode recovery.

The language is what the extension promises. Each file is parsed by ``cpp_parser`` or ``py_parser``; both go on after an
error, so a file has the list of all its errors, and the first one is the cause. The compiler's verdict is only a hint
and is reported next to the parser's, since it may belong to another state of the file or fail for other reasons.

Defined results: null path or text: left out; an empty text parses; an extension of no known language gives language
"other" and no verdict; compile reports that were delivered several times count once, by the worst verdict; a repeated
path is one row per text in ``parsed`` and one in ``found``.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import cpp_parser, py_parser
from codeloom.llm.common import keyed_texts, spread, text_groups

#: What the extensions promise.
CPP_EXTENSIONS = ("cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h++", "h", "ipp", "inl")
PYTHON_EXTENSIONS = ("py", "pyw", "pyi")
MAX_RECURSION = 50_000


def language(path: str) -> str:
    extension = path.rpartition("/")[2].rpartition(".")[2].lower()
    return "cpp" if extension in CPP_EXTENSIONS else "python" if extension in PYTHON_EXTENSIONS else "other"


def errors(path: str, text: str) -> list[tuple[int, str]]:
    rule = {"cpp": cpp_parser.parse_errors, "python": py_parser.parse_errors}.get(language(path))
    return rule(text) if rule else []


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses with a deep stack: nested code needs more frames than Python allows by default."""
    sys.setrecursionlimit(MAX_RECURSION)
    before = threading.stack_size(256 << 20)
    try:
        for keys, texts in text_groups(batches):
            made: list[list[tuple[int, str]] | BaseException] = []

            def work(keys=keys, texts=texts, made=made) -> None:
                try:
                    made.extend(errors(k, t) for k, t in zip(keys, texts))
                except BaseException as e:  # noqa: BLE001 - raised again by the task
                    made.append(e)

            thread = threading.Thread(target=work)
            thread.start()
            thread.join()
            if made and isinstance(made[-1], BaseException):
                raise made[-1]
            rows = [[{"line": line, "message": message} for line, message in e] for e in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.string()), pa.array([language(k) for k in keys], type=pa.string()), pa.array(rows, type=pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())])))],
                names=["path", "language", "errors"],
            )
    finally:
        threading.stack_size(before)


def parsed(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, language, errors, first_line, first_cause, fails) of every file."""
    rows = spread(keyed_texts(df, path, text)).mapInArrow(_deep, "path string, language string, errors array<struct<line:int,message:string>>")
    return rows.select("path", "language", "errors", F.get("errors", F.lit(0))["line"].alias("first_line"), F.get("errors", F.lit(0))["message"].alias("first_cause"), (F.size("errors") > 0).alias("fails"))


def found(df: DataFrame, path: str, text: str) -> DataFrame:
    return parsed(df, path, text).where("fails").select("path").distinct()


def acceptance(df: DataFrame, path: str, text: str) -> DataFrame:
    """(language, cause, files, share): of each language the files that are accepted (null cause), and those that are not by the kind of
    their first error, what is quoted in its message left out."""
    cause = F.trim(F.regexp_replace(F.regexp_replace("first_cause", r"'[^']*'|\"[^\"]*\"", "..."), r"before \.\.\.$", ""))
    rows = parsed(df, path, text).groupBy("language", F.when(F.col("fails"), cause).alias("cause")).agg(F.count("*").alias("files"))
    totals = rows.groupBy("language").agg(F.sum("files").alias("all"))
    return rows.join(totals, "language").select("language", "cause", "files", (F.col("files") / F.col("all")).alias("share"))


def rates(df: DataFrame, path: str, text: str, repository: str, reports: DataFrame | None = None) -> DataFrame:
    """(repository, language, files, failing, rate, compiler_failing, agreeing): per repository and language, with the number of
    files that the compiler failed on, whatever the reason, and of those for which it agrees."""
    verdicts = parsed(df, path, text).select("path", "language", "fails")
    owners = df.select(F.col(f"`{path}`").cast("string").alias("path"), F.coalesce(F.col(f"`{repository}`").cast("string"), F.lit("unknown")).alias("repository")).where("path is not null").dropDuplicates(["path"])
    rows = verdicts.groupBy("path", "language").agg(F.max("fails").alias("fails")).join(owners, "path")
    if reports is None:
        rows = rows.withColumn("compiler", F.lit(None).cast("boolean"))
    else:
        hints = reports.where("OriginalPath is not null").groupBy(F.col("OriginalPath").alias("path")).agg(F.max((F.col("ReturnCode") != 0) | (F.coalesce("ErrorCount", F.lit(0)) > 0)).alias("compiler"))
        rows = rows.join(hints, "path", "left")
    return rows.groupBy("repository", "language").agg(
        F.count("*").alias("files"),
        F.count_if("fails").alias("failing"),
        (F.count_if("fails") / F.count("*")).alias("rate"),
        F.count_if("compiler").alias("compiler_failing"),
        F.count_if(F.col("compiler") == F.col("fails")).alias("agreeing"),
    )
