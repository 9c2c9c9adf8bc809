"""Visually identical text with different characters, brought to one form.

For each token the script sets of its characters are intersected. An empty intersection is a mixed-script token; one that
lies outside the dictionary's scripts is a whole-script confusable. The spelling in the script that all characters have a
twin in is selected, the remaining forms (width, composition, invisible characters, blanks) are normalized, and the
result is compared by skeleton, where all characters that are drawn alike share one prototype.

The prototypes and twins come from the public confusables data of Unicode in the ICU library that Spark carries.
"""

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kugiri.operators.lexicon import outside
from kugiri.plans.names import columns, free
from kugiri.plans.skew import join_table

INVISIBLE = regex.compile(r"[\s\p{Zs}\p{Zl}\p{Zp}\p{Cc}\p{Cf}\p{Default_Ignorable_Code_Point}⠀]+")
#: Strokes drawn like the prolonged sound mark or a dash, beside all of category Pd.
STROKES = "ー一ㅡ─━−―｜"[:-1]
#: Scripts written together, by the group of a dictionary.
SCRIPTS = {"ja": {"CJK", "HIRAGANA", "KATAKANA", "LATIN"}, "ko": {"CJK", "HANGUL", "LATIN"}, "zh": {"CJK", "BOPOMOFO", "LATIN"}, "la": {"LATIN"}}
WRITTEN_TOGETHER = [{"CJK", "HIRAGANA", "KATAKANA"}, {"CJK", "HANGUL"}, {"CJK", "BOPOMOFO"}]


def confusables(spark: SparkSession) -> dict[str, str]:
    """Prototype of every character that is drawn like another, from the ICU library on the driver."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    chars = [c for c in map(chr, range(0x21, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cc", "Cn", "Co", "Zl", "Zp") and not 0xAC00 <= ord(c) < 0xD7A4]
    parts = checker.getSkeleton("\n".join(chars)).split("\n")
    if len(parts) != len(chars):
        raise RuntimeError("the confusables data can't be read")
    table = {c: p for c, p in zip(chars, parts) if p != unicodedata.normalize("NFD", c)}
    dashes = {c for c in chars if unicodedata.category(c) == "Pd"} | set(STROKES)
    return table | {c: "ー" for c in dashes}


def _script_test(name: str) -> "regex.Pattern | None":
    try:
        return regex.compile(rf"\p{{Script_Extensions={name}}}")
    except regex.error:
        return None


@lru_cache(1)
def script_names() -> tuple[str, ...]:
    """All scripts, by the one or two words that the names of their letters begin with."""
    heads: dict[str, set[str]] = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c)[0] == "L":
            first, _, rest = unicodedata.name(c, "").partition(" ")
            heads.setdefault(first, set()).add(rest.partition(" ")[0])
    out = ["Han"]
    for first, seconds in heads.items():
        out += [first] if _script_test(first) else [n for s in sorted(seconds) if s.isalpha() and _script_test(n := f"{first}_{s}")]
    return tuple(out)


#: Names of the scripts, where they were shipped from the driver.
_NAMES: list[str] = []


@lru_cache(1)
def _script_tests() -> list[tuple[str, "regex.Pattern"]]:
    """A pattern for each script, by its Script_Extensions."""
    return [(n.upper(), _script_test(n)) for n in _NAMES or script_names()]


#: Scripts of the characters that were shipped from the driver.
_KNOWN: dict[str, frozenset[str] | None] = {}


@lru_cache(65536)
def _scripts(c: str) -> frozenset[str] | None:
    if unicodedata.category(c)[0] != "L":
        return None
    out = {"CJK" if name == "HAN" else name for name, test in _script_tests() if test.match(c)}
    if c == "ー":
        out.add("CJK")
    if not out:
        return None
    return frozenset(out | {"+".join(sorted(g)) for g in WRITTEN_TOGETHER if g & out})


def scripts(c: str) -> frozenset[str] | None:
    """The scripts a character is written in (Script_Extensions); None when it goes with any (digits, marks, punctuation)."""
    return _KNOWN[c] if c in _KNOWN else _scripts(c)


def resolved(token: str) -> frozenset[str] | None:
    """Intersection of the characters' script sets; empty for mixed scripts, None when every character goes with any."""
    out = None
    for c in token:
        s = scripts(c)
        if s is not None:
            out = s if out is None else out & s
    return out


class Normalizer:
    """table: prototypes, as confusables() gives them."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.twins: dict[str, dict[str, str]] = {}
        for c, p in [*table.items(), *((p, p) for p in set(table.values()) if len(p) == 1)]:
            s = scripts(c)
            if s and unicodedata.normalize("NFKC", c) == c:
                for name in s:
                    # several twins in one script: the first in code order, as that is the common letter
                    if name not in (own := self.twins.setdefault(p, {})) or c < own[name]:
                        own[name] = c

    def clean(self, text: str) -> str:
        """Width and composition made uniform, what shows nothing or only a blank taken out."""
        out = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        return unicodedata.normalize("NFKC", out)

    def prototypes(self, text: str) -> str:
        return "".join([self.table.get(c) or unicodedata.normalize("NFD", c) for c in text])

    def skeleton(self, text: str) -> str:
        return self.prototypes(self.clean(text))

    def spell(self, text: str, wanted: set[str]) -> tuple[str, str]:
        """The spelling in one script, and whether the token was single, mixed or whole (wholly in a foreign script)."""
        clean = self.clean(text)
        sets = resolved(clean)
        kind = "single" if sets is None or sets & wanted or any("+" in s for s in sets) and any("+" in s and set(s.split("+")) & wanted for s in sets) else "whole" if sets else "mixed"
        if kind == "single":
            return clean, kind
        present = [s for c in clean if (s := scripts(c))]
        for script in sorted(wanted, key=lambda w: (-sum(w in s for s in present), w)):
            out = []
            for c in clean:
                s = scripts(c)
                if s is None or script in s:
                    out.append(c)
                elif twin := self.twins.get(self.table.get(c, c), {}).get(script):
                    out.append(twin)
                else:
                    break
            else:
                return "".join(out), kind
        return clean, kind


FORM_DDL = "form string, kind string, skeleton string"
FORM = pa.struct([("form", pa.string()), ("kind", pa.string()), ("skeleton", pa.string())])


def form_column(text: Column, group: Column, table: dict[str, str]) -> Column:
    """A struct (form, kind, skeleton) for each text; group is a key of SCRIPTS, any other means Latin. NULL for NULL."""
    state: dict = {}
    # looked up once, on the driver
    names = script_names()
    known = {c: scripts(c) for c in {*table, *(p for p in table.values() if len(p) == 1)}}

    def form(texts: pa.Array, groups: pa.Array) -> pa.Array:
        if not state:
            _KNOWN.update(known)
            _NAMES[:] = names
            state["by"], state["seen"] = Normalizer(table), {}
        by, seen, out = state["by"], state["seen"], []
        if len(seen) > 200_000:
            seen.clear()
        for key in zip(texts.to_pylist(), groups.to_pylist()):
            if key[0] is None:
                out.append(None)
                continue
            if (got := seen.get(key)) is None:
                spelled, kind = by.spell(key[0], SCRIPTS.get(key[1], {"LATIN"}))
                got = seen[key] = {"form": spelled, "kind": kind, "skeleton": by.prototypes(spelled)}
            out.append(got)
        return pa.array(out, FORM)

    return F.arrow_udf(form, FORM_DDL)(text, group)


def match_lexicon(rows: DataFrame, lexicon: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """The rows (dict_name, surface and any others) that look like a word of their dictionary but are written otherwise.

    Adds word_id, the word's lexicon_surface and kind. Only dictionaries whose normalize_details is true take part (NULL is
    false). Rows with a NULL surface or of no such dictionary are left out; letter case matters. Rows are not shuffled while
    the lexicon is small enough to be broadcast; beyond, those of hot keys aren't (plans.skew). Where rows has columns named like the added ones, an underscore
    is put behind the new names. A surface of nothing visible looks like no word; an empty table gives no row.
    """
    table = confusables(rows.sparkSession)
    flags = dictionaries.where("normalize_details").select("dict_name", F.col("lang_group").alias("__group")).dropDuplicates(["dict_name"])
    words = join_table(lexicon, flags, ["dict_name"]).select("dict_name", form_column(F.col("surface"), F.col("__group"), table)["skeleton"].alias("__skeleton"), "word_id", F.col("surface").alias("lexicon_surface"))
    words = words.where("__skeleton <> ''").groupBy("dict_name", "__skeleton").agg(F.min_by(F.struct("word_id", "lexicon_surface"), "word_id").alias("__w"))
    off = outside(join_table(rows, flags, ["dict_name"]), lexicon)
    formed = off.withColumn("__f", form_column(F.col("surface"), F.col("__group"), table)).withColumn("__skeleton", F.col("__f.skeleton"))
    out = join_table(formed, words, ["dict_name", "__skeleton"])
    return out.select(*columns(rows), F.col("__w.word_id").alias(free(rows, "word_id")), F.col("__w.lexicon_surface").alias(free(rows, "lexicon_surface")), F.col("__f.kind").alias(free(rows, "kind")))
