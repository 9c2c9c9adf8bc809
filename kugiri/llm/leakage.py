"""Evaluation passages leaking into training text: a prefix-filtered set join of word shingles.

A leak is a run of at least RUN consecutive words of an item that stands in a document with at most one word in TOLERANCE
changed, missing or added. Two such changes leave a window of 20 words at least 6 of its 16 shingles of five words.

1. Words and shingles are numbers by hashes of their characters. The items' are marked in two bit tables of fixed size.
2. One pass over the documents, whatever the number of items, keeps the stretches where marked shingles lie close enough
   (length bound), cut into pieces of bounded length, and counts every marked shingle over all documents.
3. The items' shingles are ordered by rarity over all documents. Of each item window only the necessary prefix, its rarest
   16 - 6 + 1 shingles, is joined with those of the stretches, by equality; hot shingles are split (plans.skew).
4. Each candidate's words are verified by exact alignment over item-sized windows (positional bound).
"""

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kugiri.plans.shared import stable
from kugiri.plans.skew import join_table

SHINGLE, RUN, TOLERANCE = 5, 20, 10
#: Shingles that a run of RUN words keeps at least.
NEEDED = RUN - SHINGLE + 1 - RUN // TOLERANCE * SHINGLE
PREFIX = RUN - SHINGLE + 1 - NEEDED + 1
#: Words of a stretch beyond its outermost shingles: what a run of under 2 * RUN words may hold there.
MARGIN = 2 * RUN
#: Changes of a run of under 2 * RUN words.
MOST_EDITS = (2 * RUN - 1) // TOLERANCE
#: Words of a piece of a stretch; neighbouring pieces share 2 * MARGIN, so that each run of under 2 * RUN words is in one.
PIECE = 1024
#: Bits of the tables that mark the items' words and shingles; more items fill them, which lets more through but loses nothing.
WORD_BITS, SHINGLE_BITS = 22, 24
#: Characters of texts that are split into words at once.
CHARS_AT_ONCE = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

PARAGRAPH = re.compile(r"[\[【〔]\s*\d{1,6}\s*[\]】〕]")
PAGE = re.compile(r"(?m)^[^\S\r\n]*(?:[-–—]+[^\S\r\n]*\d{1,5}[^\S\r\n]*[-–—]+|\d{1,5}|(?:page|seite|página|p\.)[^\S\r\n]*\d{1,5}(?:[^\S\r\n]*(?:/|of|von|de|sur)[^\S\r\n]*\d{1,5})?)[^\S\r\n]*$")
HYPHEN = re.compile(r"(?<=\w)[-‐‑­]\s*(?=\w)")
WORDS = re.compile(r"[^\W_]+")
_TABLE: list[np.ndarray] = []


def plain(text: str) -> str:
    """The text of which WORDS are the words that count: without case, hyphens, page and paragraph numbers."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "[" in text or "【" in text or "〔" in text:
        text = PARAGRAPH.sub(" ", text)
    if "\n" in text:
        text = PAGE.sub("", text)
    return HYPHEN.sub("", text)


def words(text: str) -> list[str]:
    """The words that count."""
    return WORDS.findall(plain(text))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points belong to words, and the weights of places in a word; made once in a process."""
    if not _TABLE:
        member = np.zeros(sys.maxunicode + 1, bool)
        for m in WORDS.finditer("".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))):
            member[m.start() : m.end()] = True
        _TABLE.extend([member, np.multiply.accumulate(np.full(64, MULTIPLIER))])
    return _TABLE[0], _TABLE[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * MULTIPLIER
    return h ^ h >> np.uint64(29)


def numbers(texts: list[str]) -> list[np.ndarray]:
    """The words of each text as numbers from 1 up, all texts at once; equal words have equal numbers."""
    member, weight = _tables()
    parts = [plain(t) for t in texts]
    codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = member[codes]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return [np.empty(0, np.uint64) for _ in texts]
    size = last - first
    begin = np.cumsum(size) - size
    own = codes[inside].astype(np.uint64)
    at = np.arange(len(own)) - np.repeat(begin, size)
    # each character's part depends on its place
    h = np.add.reduceat((own + np.uint64(1)) * (weight[at & 63] ^ (own << np.uint64(20))) + (at >> 6).astype(np.uint64) * own, begin)
    h = _mixed(h) | np.uint64(1)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return np.split(h, np.searchsorted(first, ends[:-1]))


def blocks(ids: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all runs of `size` words that hold no unknown word (number 0)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = np.concatenate(([0], np.cumsum(ids != 0)))
    at = np.flatnonzero(known[size:] - known[:-size] == size)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = _mixed(h ^ ids[at + k])
    return at, h


class Marks:
    """Bit tables of the items' words and shingles. A number that isn't marked is none of theirs."""

    def __init__(self, word_table: np.ndarray, shingle_table: np.ndarray):
        self.word_table, self.shingle_table = word_table, shingle_table

    @staticmethod
    def _marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(len(table) * 64 - 1)
        return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with 0 for words of no item; places and hashes of the marked shingles."""
        ids = np.where(self._marked(self.word_table, ids), ids, np.uint64(0))
        at, h = blocks(ids)
        hit = self._marked(self.shingle_table, h)
        return ids, at[hit], h[hit]

    @staticmethod
    def stretches(ids: np.ndarray, at: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of each piece of a stretch that may hold a run, and its marked shingles."""
        if len(at) < NEEDED:
            return []
        # length bound: NEEDED shingles within the words that a shortest run, with its changes, can take
        reach = RUN + RUN // TOLERANCE - SHINGLE
        near = at[NEEDED - 1 :] - at[: len(at) - NEEDED + 1] <= reach
        if not near.any():
            return []
        keep = np.zeros(len(at) + 1, np.int32)
        starts = np.flatnonzero(near)
        np.add.at(keep, starts, 1)
        np.add.at(keep, starts + NEEDED, -1)
        keep = np.cumsum(keep[:-1]) > 0
        at, h = at[keep], h[keep]
        cuts = np.flatnonzero(np.diff(at) > 2 * MARGIN) + 1
        out = []
        for a, g in zip(np.split(at, cuts), np.split(h, cuts)):
            first, last = max(0, int(a[0]) - MARGIN), min(len(ids), int(a[-1]) + SHINGLE + MARGIN)
            for p in range(first, max(first + 1, last - 2 * MARGIN), PIECE - 2 * MARGIN):
                end = min(last, p + PIECE)
                own = g[(a >= p) & (a + SHINGLE <= end)]
                if len(own) >= NEEDED:
                    out.append((ids[p:end], np.unique(own)))
        return out


def _reach(a: list[int], i: int, b: list[int], j: int, step: int) -> list[int]:
    """The most words of a, from i in the direction of step, that align with words of b from j with 0, 1, ... MOST_EDITS changes."""
    na, nb = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    front, out = {0: 0}, [0]
    for edits in range(MOST_EDITS + 1):
        if edits:
            after: dict[int, int] = {}
            for d, x in front.items():
                # d: words of b taken more than words of a
                for e, y in ((d, x + 1), (d + 1, x), (d - 1, x + 1)):
                    if y <= na and y + e <= nb and y > after.get(e, -1):
                        after[e] = y
            front = after or front
        for d, x in front.items():
            while x < na and x + d < nb and a[i + step * x] == b[j + step * (x + d)]:
                x += 1
            front[d] = x
        best = max(front.values())
        if edits:
            out.append(max(best, out[-1]))
        else:
            out[0] = best
    return out


class Words:
    """A text's word numbers with its shingles and its blocks of one word more."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.at, self.shingles = blocks(ids)
        self._longer: tuple | None = None
        self._places: dict[int, list[int]] | None = None

    @property
    def own(self) -> np.ndarray:
        return np.unique(self.shingles)

    def longer(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        if self._longer is None:
            self._longer = (*blocks(self.ids, SHINGLE + 1), self.ids.tolist())
        return self._longer

    def places(self) -> dict[int, list[int]]:
        if self._places is None:
            self._places = {}
            at, h, _ = self.longer()
            for p, x in zip(at.tolist(), h.tolist()):
                self._places.setdefault(x, []).append(p)
        return self._places


def contains_run(item: Words, own: np.ndarray, stretch: Words) -> bool:
    """Whether the stretch holds a run of the item; own: the item's distinct shingles, sorted.

    NEEDED of them must lie within the words that a shortest run can take. A run of RUN to 2 * RUN - 1 words with its changes
    has an exact block of SHINGLE + 1 words, and a longer run holds such a run. So every such block is extended to both
    sides by the furthest-reaching alignment. Blocks repeated within the same surroundings are extended once.
    """
    if not len(own):
        return False
    shared = stretch.at[own[np.minimum(np.searchsorted(own, stretch.shingles), len(own) - 1)] == stretch.shingles]
    if len(shared) < NEEDED or not (shared[NEEDED - 1 :] - shared[: len(shared) - NEEDED + 1] <= RUN + RUN // TOLERANCE - SHINGLE).any():
        return False
    by = item.places()
    here, theirs, b = stretch.longer()
    a = item.longer()[2]
    context = 2 * RUN + MOST_EDITS
    around = lambda ids, p: ids[max(0, p - context) : p + context].tobytes() + bytes([max(0, context - p)])
    seen = set()
    for j, h in zip(here.tolist(), theirs.tolist()):
        for i in by.get(h, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            if len(by[h]) > 1:
                key = (around(item.ids, i), around(stretch.ids, j))
                if key in seen:
                    continue
                seen.add(key)
            k = SHINGLE + 1
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k >= RUN:
                return True
            left, right = _reach(a, i - 1, b, j - 1, -1), _reach(a, i + k, b, j + k, 1)
            for x in range(MOST_EDITS + 1):
                for y in range(MOST_EDITS + 1 - x):
                    if left[x] + k + right[y] >= max(RUN, TOLERANCE * (x + y)):
                        return True
    return False


def _rows(lists: pa.Array) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    return [values[i:j] for i, j in zip(offsets[:-1], offsets[1:])]


#: Texts whose shingles are kept while pairs are verified.
KEPT = 4096


def _verified(items: pa.Array, ids: pa.Array, stretches: pa.Array, state: dict) -> pa.Array:
    """Pairs of neighbouring rows often have a text in common, so its shingles are made once."""
    out = []
    for t, x, y in zip(items.to_pylist(), _rows(ids), _rows(stretches)):
        if (known := state.get(t)) is None:
            if len(state) >= KEPT:
                state.clear()
            w = Words(x)
            known = state[t] = (w, w.own)
        if (stretch := state.get(key := y.tobytes())) is None:
            if len(state) >= KEPT:
                state.clear()
            stretch = state[key] = Words(y)
        out.append(contains_run(*known, stretch))
    return pa.array(out, pa.bool_())


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64()))


def _item_words(batches):
    for b in batches:
        ids = numbers(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), _longs(ids), _longs([np.unique(blocks(x)[1]) for x in ids])], ["item", "ids", "shingles"])


def _item_places(batches):
    for b in batches:
        own = [blocks(np.array(x, np.int64).view(np.uint64)) for x in b.column(1).to_pylist()]
        n = [len(at) for at, _ in own]
        at, h = (np.concatenate([o[i] for o in own]) if own else np.empty(0, np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(own)), n))), pa.array(at, pa.int32()), pa.array(h.view(np.int64), pa.int64())], ["t", "pos", "h"])


def _item_prefixes(batches):
    """The necessary prefix of every item window, of shingles in their order with their counts."""
    width = RUN - SHINGLE + 1
    for b in batches:
        texts, found = [], []
        for t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ranked = [(x["n"], x["h"]) for x in own]
            prefix = {h for i in range(len(ranked) - width + 1) for _, h in sorted(ranked[i : i + width])[:PREFIX]}
            texts += [t] * len(prefix)
            found += prefix
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(found, pa.int64())], ["t", "h"])


def _bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of 2 ^ bits bits with those of the hashes set; at most 2 ^ (bits - 6) rows come to the driver."""
    at = F.col("h").bitwiseAND((1 << bits) - 1)
    rows = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, int((h & {(1 << bits) - 1}) & 63)))").alias("m")).toPandas()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out.view(np.uint64)


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item whose run of words it holds: the two ids.

    NULL and empty texts hold nothing; an item of under RUN words can't leak. Equal documents and equal items each get their
    own rows. Ids must be whole numbers. Other columns are ignored. Documents are read once; neither items nor shingles are gathered.
    """
    spark = documents.sparkSession
    whole = lambda df, id, name: df.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias(name), F.col(text).alias("text"))
    own = whole(items, item, "item").mapInArrow(_item_words, "item long, ids array<long>, shingles array<long>").where(F.size("ids") >= RUN)
    own = stable(own.withColumn("t", F.xxhash64("ids")))
    marks = spark.sparkContext.broadcast(Marks(_bits(own.select(F.explode("ids").alias("h")), WORD_BITS), _bits(own.select(F.explode("shingles").alias("h")), SHINGLE_BITS)))

    def pieces(batches):
        for b in batches:
            texts = b.column(1)
            lengths = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + CHARS_AT_ONCE, side="right")))
                docs, order, ids, own, hits = [], [], [], [], []
                for d, n in zip(b.column(0).slice(at, to - at).to_pylist(), numbers(texts.slice(at, to - at).to_pylist())):
                    n, places, h = marks.value.hits(n)
                    hits.append(h)
                    for k, (part, shingles) in enumerate(marks.value.stretches(n, places, h)):
                        docs.append(d)
                        order.append(k)
                        ids.append(part)
                        own.append(shingles)
                # one row of counts, without a document
                values, counts = np.unique(np.concatenate(hits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([*docs, None], pa.int64()), pa.array([*order, -1], pa.int32()), _longs([*ids, counts.astype(np.int64)]), _longs([*own, values])], ["doc", "k", "ids", "shingles"])
                at = to

    kept = stable(whole(documents, doc, "doc").mapInArrow(pieces, "doc long, k int, ids array<long>, shingles array<long>"))
    stretches = kept.where("k >= 0")
    counted = kept.where("k < 0").select(F.explode(F.arrays_zip("shingles", "ids")).alias("x"))
    rarity = counted.groupBy(F.col("x.shingles").alias("h")).agg(F.sum("x.ids").alias("n"))
    texts = own.select("t", "ids").dropDuplicates(["t"])
    places = texts.mapInArrow(_item_places, "t long, pos int, h long")
    ranked = join_table(places, rarity, ["h"], "left").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "h"))).alias("own"))
    prefix = stable(ranked.mapInArrow(_item_prefixes, "t long, h long"))
    met = join_table(stretches.select("doc", "k", F.explode("shingles").alias("h")), prefix, ["h"]).select("doc", "k", "t").distinct()
    pairs = join_table(met, texts.select("t", F.col("ids").alias("item_ids")), ["t"]).join(stretches.select("doc", "k", "ids"), ["doc", "k"])

    state: dict = {}

    def verify(t: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return _verified(t, a, b, state)

    found = pairs.where(F.arrow_udf(verify, "boolean")("t", "item_ids", "ids")).select("doc", "t").distinct()
    out = join_table(found, own.select("t", "item").distinct(), ["t"])
    return out.select(F.col("doc").alias(doc), F.col("item").alias(item)).distinct()
