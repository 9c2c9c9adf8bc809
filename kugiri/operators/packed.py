"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton finds the known whole values that hold delimiters; dynamic programming over the delimiter
positions picks the cover of least cost by quoted values, known values and plain values. So a delimiter inside a quoted
or a known value is protected.
"""

import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kugiri.plans.names import columns, free

#: Costs of the cover: a quoted value, a known value that holds delimiters, any other value. A known value beats two plain ones.
QUOTED, KNOWN, PLAIN = 1, 2, 4
#: Known values that hold a delimiter and are shipped to the workers; more are an error. Others change no cover and aren't shipped.
MOST_KNOWN = 2_000_000


@lru_cache(1)
def separators() -> str:
    """The characters of the comma, semicolon, bar and tab families in any width or script, and all controls."""
    named = re.compile(r"(?<!SQUARE WITH CENTRE )(?<!PEDESTAL WITH )(?:COMMA|SEMICOLON|VERTICAL LINE|VERTICAL BAR|BROKEN BAR|LIGHT VERTICAL|HEAVY VERTICAL|DIVIDES)")
    out = {";", "␉"}  # the Greek question mark is canonically a semicolon; the symbol for a tab
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind == "Cc" or kind in ("Po", "Sm", "So") and (m := named.search(unicodedata.name(c, ""))) and m.end() == len(unicodedata.name(c)) and "WITH" not in unicodedata.name(c):
            out.add(c)
    return "".join(sorted(out))


@lru_cache(1)
def blanks() -> str:
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Zs", "Zl", "Zp"))


class Splitter:
    """Splits packed strings; known: whole values that may occur."""

    def __init__(self, known=()):
        self.seps, self.blanks = frozenset(separators()), blanks()
        self.sep = re.compile("[" + re.escape(separators()) + "]")
        self.known = frozenset(known)
        self.automaton = ahocorasick.Automaton()
        for v in self.known:
            # a value that is nothing but delimiters can't be told from delimiters
            if self.sep.search(v) and self.sep.sub("", v).strip(self.blanks) and v == v.strip(self.blanks):
                self.automaton.add_word(v, len(v))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _quoted(self, text: str, at: int) -> tuple[str, int] | None:
        """The value quoted from `at`, and the position of the delimiter (or end) that follows it."""
        q, i, n = text[at], at + 1, len(text)
        while (j := text.find(q, i)) >= 0:
            if text.startswith(q, j + 1):
                i = j + 2
                continue
            k = j + 1
            while k < n and text[k] in self.blanks:
                k += 1
            return (text[at + 1 : j].replace(q + q, q), k) if k == n or text[k] in self.seps else None
        return None

    def split(self, text: str) -> list[str]:
        """The values in order; an empty value keeps its place."""
        n = len(text)
        cuts = [m.start() for m in self.sep.finditer(text)]
        quotes = '"' in text or "'" in text
        spans: dict[int, list[int]] = {}
        if cuts and len(self.automaton):
            for last, length in self.automaton.iter(text):
                start = last + 1 - length
                spans.setdefault(start, []).append(length)
        if not quotes and not spans:
            return [v.strip(self.blanks) for v in self.sep.split(text)]
        starts = [0, *(c + 1 for c in cuts)]
        ends = [*cuts, n]
        at = {s: i for i, s in enumerate(starts)}
        place = {e: i for i, e in enumerate(ends)}
        best: list[tuple | None] = [None] * (len(starts) + 1)
        best[0] = (0, None, None)
        for i, s in enumerate(starts):
            if best[i] is None:
                continue
            cost, first = best[i][0], s
            while first < n and text[first] in self.blanks:
                first += 1
            value = text[s : ends[i]].strip(self.blanks)
            edges = [(i, PLAIN, value)]
            if first < n and text[first] in "\"'" and (quoted := self._quoted(text, first)):
                edges = [(place[quoted[1]], QUOTED, quoted[0])]
            elif first in spans:
                for length in spans[first]:
                    k = stop = first + length
                    while k < n and text[k] in self.blanks:
                        k += 1
                    if k in place:
                        edges.append((place[k], KNOWN, text[first:stop]))
            for j, more, v in edges:
                if best[j + 1] is None or cost + more < best[j + 1][0]:
                    best[j + 1] = (cost + more, i, v)
        out, i = [], len(starts)
        while i:
            _, i, v = best[i]
            out.append(v)
        return out[::-1]


def split_column(packed: Column, known: list[str] | tuple = ()) -> Column:
    """The values of a packed string as an array, in order; NULL for NULL, one empty value for an empty string.

    Equal strings of a batch are split once.
    """
    sep = Splitter().sep
    known = sorted(v for v in set(known) if v and sep.search(v))
    state: dict = {}

    def split(a: pa.Array) -> pa.Array:
        if not state:
            state["by"] = Splitter(known)
        coded = pc.dictionary_encode(a)
        values = pa.array(list(map(state["by"].split, coded.dictionary.to_pylist())), pa.list_(pa.string()))
        return values.take(coded.indices)

    return F.arrow_udf(split, "array<string>")(packed)


def split_rows(df: DataFrame, packed: str, pos: str = "pos", val: str = "val", known: list[str] | tuple = ()) -> DataFrame:
    """One row per non-empty value of df.packed, with df's other columns, its position from 0 and the value.

    A NULL or blank field gives no row. Where df has a column named pos or val, an underscore is put behind the new one's name.
    """
    rest, pos, val = columns(df, (packed,)), free(df, pos, (packed,)), free(df, val, (packed,))
    source = F.col(f"`{packed}`")
    out = df.where(source.isNotNull()).select(*rest, split_column(source, known).alias("__values"))
    return out.select(*rest, F.posexplode("__values").alias(pos, val)).where(F.col(val) != "")


def known_values(lexicon: DataFrame, details: str = "details") -> list[str]:
    """The distinct detail values of a lexicon that hold a delimiter, which alone change a cover.

    They are shipped to the workers, so more than MOST_KNOWN of them are an error.
    """
    values = lexicon.select(F.explode(details).alias("v")).where(F.col("v").rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in separators()) + "]")).distinct()
    got = [r.v for r in values.limit(MOST_KNOWN + 1).collect()]
    if len(got) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} values that hold a delimiter")
    return got
