"""Lexicon operators as joins, and single filters as Column expressions."""

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kugiri.functions.charfilters import character_filter
from kugiri.operators.lattice import MOST_BYTES, sentences
from kugiri.plans.skew import join_table


def sentence_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per sentence: df's other columns, sentence, place and bytes. Only a sentence over the byte bound leaves the JVM."""

    def cut(parts: pa.Array) -> pa.Array:
        return pa.array([None if p is None else list(sentences(p)) for p in parts.to_pylist()], pa.list_(pa.string()))

    rest = [c for c in df.columns if c != text]
    # only a text over the bound can hold a sentence over it
    long = F.octet_length(text) >= MOST_BYTES
    ends = F.split(text, r"(?<=[\n\t。、])")
    short = df.where(~long).select(*rest, F.posexplode(F.filter(ends, lambda s: s != "")).alias("place", "sentence"))
    cut_rows = df.where(long).select(*rest, F.posexplode(F.arrow_udf(cut, "array<string>")(text)).alias("place", "sentence"))
    return short.unionByName(cut_rows).withColumn("bytes", F.octet_length("sentence").cast("long"))


def code_point(c: Column) -> Column:
    """The code point of a one-character string."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")


def with_categories(df: DataFrame, character: str, categories) -> DataFrame:
    """df with the categories of each character: a broadcast of the intervals of char.def, looked up by binary order.

    An empty string is left out.
    """
    rows = categories.rows()
    lows = F.array(*[F.lit(low) for low, _, _ in rows])
    names = F.array(*[F.array(*map(F.lit, own)) for _, _, own in rows])
    kept = df.where(F.col(character) != "")
    at = F.size(F.filter(lows, lambda low: low <= code_point(F.col(character))))
    return kept.withColumn("categories", F.element_at(names, at))


def prefix_matches(texts: DataFrame, lexicon: DataFrame, by: list[str], surface: str = "surface") -> DataFrame:
    """Every lexicon entry that is a prefix of a text: texts' prefixes, up to the longest surface, meet entries by equality.

    Adds the entry's other columns, end_char and end_byte. Work grows with the length of the texts, not of the lexicon.
    """
    longest = lexicon.agg(F.max(F.char_length(surface)).alias("n")).first().n or 0
    ends = F.explode(F.sequence(F.lit(1), F.least(F.char_length(surface), F.lit(longest)))) if longest else F.explode(F.array().cast("array<int>"))
    parts = texts.where(F.char_length(surface) > 0).select("*", ends.alias("end_char")).withColumn("__prefix", F.substring(F.col(surface), F.lit(1), F.col("end_char")))
    known = lexicon.withColumnRenamed(surface, "__prefix")
    return join_table(parts, known, [*by, "__prefix"]).withColumn("end_byte", F.octet_length("__prefix")).drop("__prefix")


def details_by_id(tokens: DataFrame, lexicon: DataFrame, widths: DataFrame) -> DataFrame:
    """tokens (dict_name, word_id, lex_type and others) with their details, padded with * to the dictionary's width.

    A system word without an entry has none before padding, any other token has UNK.
    """
    words = lexicon.select("word_id", F.col("details").alias("__own")).dropDuplicates(["word_id"])
    joined = join_table(join_table(tokens, widths.dropDuplicates(["dict_name"]), ["dict_name"]), words, ["word_id"], "left")
    own = F.when(F.col("lex_type") == "System", F.coalesce("__own", F.array().cast("array<string>"))).otherwise(F.array(F.lit("UNK")))
    return joined.withColumn("details", F.concat(own, F.array_repeat(F.lit("*"), F.greatest(F.col("width") - F.size(own), F.lit(0))))).drop("__own", "width")


def simple_user_words(users: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Simple user words as full entries: default ids and cost, fields placed by name, missing ones the default value.

    users: dict_name, surface, part_of_speech, reading and others; the dictionary's user schema names what they are. Words
    without a surface are left out.
    """
    j = join_table(users.where(F.trim("surface") != ""), dictionaries.dropDuplicates(["dict_name"]), ["dict_name"])
    missing = F.col("default_field_value")
    place = lambda f: F.when(f == F.col("user_dictionary_schema")[1], F.coalesce("part_of_speech", missing)).when(f == F.col("user_dictionary_schema")[2], F.coalesce("reading", missing)).otherwise(missing)
    details = F.transform(F.slice("dictionary_schema", 5, F.greatest(F.size("dictionary_schema") - 4, F.lit(0))), place)
    return j.select(*users.columns, F.col("default_left_context_id").alias("left_id"), F.col("default_right_context_id").alias("right_id"), F.col("default_word_cost").alias("cost"), details.alias("details"))


#: Patterns that, unless they match nothing at all, mean the same in Java and in Python: literals, escaped punctuation, plain classes and groups, and greedy quantifiers.
SAME_PATTERN = re.compile(r"(?:(?:[^\\.^$*+?{}\[\]()|&~#]|\\[\\.^$*+?{}()|\[\]-]|\[\^?(?:[^\[\]\\^&~|-](?:-[^\[\]\\^&~|-])?)+\]|\(\?:|\))(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})?)*")


def filter_column(kind: str, args: dict) -> Callable[[Column], Column]:
    """A character filter as a Column function. Single-character mappings and patterns that all dialects read alike stay in the JVM."""
    made = character_filter(kind, args)
    if made.is_identity():
        return lambda c: c
    if kind == "regex" and SAME_PATTERN.fullmatch(args["pattern"]) and not made.pattern.fullmatch(""):
        literal = re.sub(r"([\\$])", r"\\\1", args["replacement"])
        return lambda c: F.regexp_replace(c, args["pattern"], literal)
    if kind == "mapping" and all(len(k) == 1 == len(v) for k, v in made.mapping.items()):
        return lambda c: F.translate(c, "".join(made.mapping), "".join(made.mapping.values()))

    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else made.apply(t)[0] for t in texts.to_pylist()], pa.string())

    return lambda c: F.arrow_udf(apply, "string")(c)
