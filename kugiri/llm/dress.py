"""Duplicates hidden by formatting differences.

Every normalized (field name, value) pair is hashed; the hashes of a record are added up, which makes a multiset hash that
no order of fields changes. Records are grouped by this fingerprint, and each record's fields are compared with those of
the group's first as multisets, by counting, without sorting. Records that collide without being equal are resolved by
their whole content.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kugiri.plans.shared import stable
from kugiri.plans.skew import join_by_key

#: Prime of the additive hash; sums of two residues stay below 2^62.
PRIME = (1 << 61) - 1


def bare(text: Column) -> Column:
    """Only letters and digits, without letter case. The case is mapped up and down, as neither way alone joins all forms;
    the optimizer would drop the first of two neighbouring mappings.
    """
    return F.lower(F.regexp_replace(F.upper(text), r"[^\p{L}\p{Nd}]+", ""))


def pairs(named: dict[str, Column], free: Column, texts: dict[str, Column] | None = None) -> Column:
    """The array of a record's (name, value) pairs.

    named: numbers and other exact values that belong to their field, of which NULL equals NULL; texts: text values that belong
    to theirs; free: array of text values that may stand in any field. Texts are compared by letters and digits, and those
    without any are dropped, as NULL is.
    """
    fixed = [F.coalesce(F.concat(F.lit(n + "\x01"), c.cast("string")), F.lit(n + "\x02")) for n, c in named.items()]
    own = [F.concat(F.lit(n + "\x04"), bare(c)) for n, c in (texts or {}).items()]
    own = F.filter(F.array(*own).cast("array<string>"), lambda v: v.isNotNull() & ~v.endswith("\x04"))
    text = F.filter(F.transform(free, lambda v: F.coalesce(bare(v), F.lit(""))), lambda v: v != "")
    return F.concat(F.array(*fixed).cast("array<string>"), own, F.transform(text, lambda v: F.concat(F.lit("text\x01"), v)))


def multiset_hash(values: Column, seed: int) -> Column:
    """Sum of the elements' hashes modulo PRIME."""
    residue = lambda v: F.pmod(F.xxhash64(F.lit(seed), v), F.lit(PRIME))
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: F.pmod(total + residue(v), F.lit(PRIME)))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often, in any order."""
    often = lambda values, v: F.size(F.filter(values, lambda x: x == v))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda v: often(a, v) == often(b, v))


#: Fingerprints of repeated groups that are broadcast (24 bytes each); with more of them the records meet by a shuffle.
MOST_REPEATED = 1_000_000


def _grouped(records: DataFrame, scope: str, id: str, values: str) -> tuple[DataFrame, DataFrame]:
    """All records by fingerprint, and those that repeat one: with the group's first id, and their sorted content where it
    differs from the first's (else NULL).

    Content is only moved for the copies and firsts of repeated groups, which are found by fingerprints alone, and compared
    once. The scope counts as one more pair.
    """
    inside = F.coalesce(F.concat(F.lit("scope\x03"), F.col(scope)), F.lit("scope\x04"))
    slim = records.select(F.col(scope).alias("s"), F.col(id).alias("__id"), F.concat(F.col(values), F.array(inside)).alias("__v"))
    slim = stable(slim.select(multiset_hash(F.col("__v"), 11).alias("__a"), multiset_hash(F.col("__v"), 23).alias("__b"), "s", "__id", "__v"))
    total, key = slim.count(), ["__a", "__b"]
    repeated = stable(slim.groupBy(*key).agg(F.min("__id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    if repeated.count() <= MOST_REPEATED:
        members = slim.join(F.broadcast(repeated), key)
    else:
        members = join_by_key(slim, repeated.withColumn("__n", F.col("n")), key, "__n", total)
    firsts = members.where("__id = first_id").select(*key, F.col("__v").alias("__first"), "n")
    met = join_by_key(members.where("__id <> first_id").drop("n"), firsts, key, "n", total)
    differs = ~same_multiset(F.col("__v"), F.col("__first"))
    return slim, stable(met.select(*key, "s", "__id", "first_id", F.when(differs, F.array_sort("__v")).alias("__other")))


def _others(met: DataFrame) -> DataFrame:
    """Groups of records whose fingerprint is that of other content (practically none), by the content itself, which holds the scope."""
    return met.where("__other IS NOT NULL").groupBy("__a", "__b", "__other", "s").agg(F.min("__id").alias("first_id"), F.count("*").alias("n"))


def copies(records: DataFrame, scope: str, id: str, values: str) -> DataFrame:
    """One row per record that repeats an earlier one: scope, first_id and copy_id.

    records has a scope within which records are compared (NULL is a scope of its own), a unique id and the array of pairs.
    The first of a group is the one with the smallest id. Records without any pair equal each other. A group may hold any
    share of all rows. An empty table gives no row.
    """
    _, met = _grouped(records, scope, id, values)
    resolved = met.where("__other IS NOT NULL").drop("first_id").join(_others(met).drop("s"), ["__a", "__b", "__other"])
    out = met.where("__other IS NULL").select("s", "first_id", "__id").unionByName(resolved.select("s", "first_id", "__id"))
    return out.where("__id <> first_id").select(F.col("s").alias(scope), "first_id", F.col("__id").alias("copy_id"))


def collapse(records: DataFrame, scope: str, id: str, values: str) -> DataFrame:
    """One row per distinct record: scope, first_id and copies, the number of records that are equal (1: no copy)."""
    slim, met = _grouped(records, scope, id, values)
    others = _others(met)
    strangers = others.groupBy("__a", "__b").agg(F.sum("n").alias("__off"))
    groups = slim.groupBy("__a", "__b").agg(F.first("s").alias("s"), F.min("__id").alias("first_id"), F.count("*").alias("n"))
    kept = groups.join(strangers, ["__a", "__b"], "left").select("s", "first_id", (F.col("n") - F.coalesce("__off", F.lit(0))).alias("copies"))
    return kept.unionByName(others.select("s", "first_id", F.col("n").alias("copies"))).withColumnRenamed("s", scope)
