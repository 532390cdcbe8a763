"""Records that are the same but for their formatting (problem 2): commutative multiset hashing.

A source text becomes a set of named fields, each normalised to its lower-case letters and digits: one field per line
of the comment that opens the file, one per #include line, and one for all the rest in its order. Each
(name, value) pair is hashed, the hashes are added up, so that the order of the fields does not matter and
repeated ones count, and records are grouped by the sums. Groups of one need nothing more. In the others every record's
fields are compared with those of the first record of its group, without sorting them. Should hashes ever
collide, the odd ones are grouped by their complete fields.

The plan stays in the JVM. Fields are computed once. Groups are pre-aggregated before the shuffle. The members of a very large
group are salted before they are brought together, and its first record is sent to each salt.

Defined results: null key or text: left out; texts with no letter or digit are copies of one another; a repeated
key counts as often as it occurs, but is no copy of itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.lineage import fenced, stored
from codeloom.llm.common import keyed_texts, spread

MASK = (1 << 60) - 1
#: Members of a group for each partition that its first record is sent to.
MEMBERS_PER_SALT = 20_000
#: Large groups, of three numbers each, that are broadcast; were there more, they would be joined.
MOST_BROADCAST = 500_000
#: Lines of an opening comment, or #include lines, from which sorting is cheaper than counting.
MANY_LINES = 64


def normal(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def fields(docs: DataFrame) -> DataFrame:
    """(k, head, includes, body) of (k, t): the normalised fields."""
    text = F.regexp_replace("t", r"^[\s\x{FEFF}]+", "")
    block = F.regexp_extract("t0", r"^/\*[\s\S]*?\*/", 0)
    lines = F.split(F.col("rest"), "\r\n|\r|\n")
    is_comment = F.transform("lines", lambda x: F.startswith(F.ltrim(F.regexp_replace(x, "^\t+", "")), F.lit("//")))
    run = F.coalesce(F.nullif(F.array_position(is_comment, False), F.lit(0)) - 1, F.size("lines").cast("long"))
    out = docs.select("k", text.alias("t0")).withColumn("block", block)
    out = out.withColumn("rest", F.expr("substring(t0, length(block) + 1)")).withColumn("lines", lines)
    # A block comment that opens the file is followed by the rest; else a run of line comments may open it.
    out = out.withColumn("run", F.when(F.col("block") != "", 0).otherwise(run).cast("int"))
    out = out.withColumn("head", F.when(F.col("block") != "", F.split("block", "\r\n|\r|\n")).otherwise(F.slice("lines", 1, F.col("run"))))
    out = out.withColumn("lines", F.slice("lines", F.col("run") + 1, F.size("lines")))
    include = lambda x: F.rlike(x, F.lit(r"^\s*#\s*include\b"))
    return out.select(
        "k",
        F.filter(F.transform("head", normal), lambda x: x != "").alias("head"),
        F.transform(F.filter("lines", include), normal).alias("includes"),
        normal(F.array_join(F.filter("lines", lambda x: ~include(x)), "\n")).alias("body"),
    )


def multiset(c: str, name: str, seed: int) -> Column:
    """Sum of the hashes of (name, value) over an array: the same for every order."""
    return F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: (acc + F.xxhash64(F.lit(seed), F.lit(name), x).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK)))


def fingerprints(parts: DataFrame) -> DataFrame:
    """Adds ``f1`` and ``f2``, two independent sums over all fields."""
    for i, seed in (("f1", 17), ("f2", 40961)):
        whole = F.xxhash64(F.lit(seed), F.lit("body"), "body").bitwiseAND(F.lit(MASK))
        total = (multiset("head", "head", seed) + multiset("includes", "include", seed)).bitwiseAND(F.lit(MASK))
        parts = parts.withColumn(i, (total + whole).bitwiseAND(F.lit(MASK)))
    return fenced(parts, ["k"], ["f1", "f2", "head", "includes", "body"])


def same_multiset(a: str, b: str) -> Column:
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    counted = F.when(F.size(a) > MANY_LINES, F.array_sort(a) == F.array_sort(b)).otherwise(F.forall(a, lambda x: count(a, x) == count(b, x)))
    return F.when(F.col(a) == F.col(b), True).when(F.size(a) != F.size(b), False).otherwise(counted)


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(first_id, copy_id) for every record, also (x, x) for the first record x of each set."""
    parts = stored(fingerprints(fields(spread(keyed_texts(df, key, text)))))
    groups = parts.groupBy("f1", "f2").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    several = groups.where("n > 1").withColumn("salts", F.ceil(F.col("n") / MEMBERS_PER_SALT).cast("int"))
    large = several.where("salts > 1").select("f1", "f2", F.col("salts").alias("many"))
    count = large.count()  # at most one for MEMBERS_PER_SALT rows
    salted = parts.withColumn("many", F.lit(1)) if not count else parts.join(F.broadcast(large) if count <= MOST_BROADCAST else large, ["f1", "f2"], "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("k"), F.coalesce("many", F.lit(1))).cast("int")).drop("many")
    each = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    members = stored(salted.join(each, ["f1", "f2", "salt"]))
    # min_by would hold whole texts in the first aggregation; the first record is picked from the members instead.
    heads = members.where("k = first").dropDuplicates(["f1", "f2"])
    heads = heads.select("f1", "f2", F.col("head").alias("head0"), F.col("includes").alias("includes0"), F.col("body").alias("body0"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    compared = members.join(heads, ["f1", "f2", "salt"]).withColumn("same", (F.col("body") == F.col("body0")) & same_multiset("head", "head0") & same_multiset("includes", "includes0"))
    equal = compared.where("same").select(F.col("first").alias("first_id"), F.col("k").alias("copy_id"))
    odd = compared.where("not same").groupBy("body", F.array_sort("head"), F.array_sort("includes")).agg(F.min("k").alias("first_id"), F.collect_set("k").alias("ks"))
    collided = odd.select("first_id", F.explode("ks").alias("copy_id"))
    single = groups.where("n = 1").select(F.col("first").alias("first_id"), F.col("first").alias("copy_id"))
    return equal.unionByName(collided).unionByName(single)


def collapsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(first_id, copies): one row per record that is left, with the number of records that it stands for."""
    return copies(df, key, text).groupBy("first_id").agg(F.count("*").alias("copies"))


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """(first_id, copy_id) without the first records themselves."""
    return copies(df, key, text).where("first_id <> copy_id").distinct()
