"""Garbled text from wrong character encodings, restored by minimum description length.

Each chain of re-encoding steps that can be undone gives a candidate text. A candidate's description is its size under a
zstandard compressor whose dictionary holds text of the language, plus the cost of the chain; the text as it stands is a
candidate with no chain. The shortest description wins, so text that is fine stays unchanged.

Where characters were lost, a candidate is a lexicon word that the bytes left of the text fit, found by an index of the
words' byte pairs; its description is the word's, plus the chain and the loss, against that of the text with its
replacement characters.
"""

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kugiri.operators.lexicon import outside
from kugiri.plans.names import columns, free
from kugiri.plans.shared import stable
from kugiri.plans.skew import join_table

#: Encodings that text is wrongly read in.
WRONG = ("cp1252", "latin-1", "cp437", "koi8-r", "mac-roman", "cp932", "cp949", "gb18030", "big5", "euc-jp", "cp1250", "cp1251", "cp866", "cp850", "iso8859-15", "utf-8")
#: Bits that a chain costs: one text in 2^6 is taken to be garbled, and each step names its encoding.
PRIOR_BITS, STEP_BITS = 6, log2(len(WRONG))
#: Bits that say which of a word's bytes were lost; and those of each replacement character in a text that is taken to be fine.
LOSS_BITS, REPLACED_BITS = 8, 32
#: Steps tried at most.
MOST_STEPS = 3
#: A language's compression dictionary is a sample of its words, by a hash over all of them, of at most so many bytes.
DICTIONARY_BYTES = 110_000
#: Lost text meets the lexicon in cells of about so many words and so many texts.
CELL_WORDS, CELL_TEXTS = 200_000, 20_000
LOST = "\ufffd"
#: Bytes that a replacement character may stand for.
GAP = 3
#: Bytes of a word that are looked at together; longer words are looked at one by one.
WIDTH = 64
#: Descriptions count UTF-16 units, so that no script is dearer than another; words stand between edges.
UNITS, EDGE = "utf-16-le", "\n\n"


@lru_cache(64)
def _codec(name: str) -> str | None:
    try:
        return codecs.lookup(name.strip().replace("_", "-")).name
    except LookupError:
        return None


def codec_of(label: str | None) -> str:
    """Python's codec for an encoding label, however it is spelt; UTF-8 for an unknown one."""
    return _codec(label or "") or _codec(re.sub(r"[^0-9a-z]+", "", (label or "").lower())) or "utf-8"


def _encode(text: str, wrong: str) -> bytes | None:
    try:
        return text.encode(wrong)
    except UnicodeError:
        if wrong != "cp1252":
            return None
    try:  # readers of cp1252 keep its five unused bytes as controls
        return b"".join([c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text])
    except UnicodeError:
        return None


def undo(text: str, right: str, steps: int = MOST_STEPS) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Every text that a chain of wrong readings could have turned into `text` without loss, with its chain."""
    seen, level = {text}, [(text, ())]
    for _ in range(steps):
        after = []
        for t, chain in level:
            for wrong in WRONG:
                raw = _encode(t, wrong)
                if raw is None:
                    continue
                for to in dict.fromkeys((right, "utf-8")):
                    if to == wrong:
                        continue
                    try:
                        got = raw.decode(to)
                    except UnicodeError:
                        continue
                    if got not in seen:
                        seen.add(got)
                        after.append((got, (*chain, wrong)))
                        if to == right:
                            yield got, (*chain, wrong)
        # a longer chain goes on from text that still looks read from bytes
        level = [(t, c) for t, c in after if any(x > "\x7f" for x in t)]
        if not level:
            return


class Describer:
    """Description lengths in bits under a compressor that knows words of a language."""

    def __init__(self, words: list[str]):
        content = (EDGE + EDGE.join(words) + EDGE).encode(UNITS)
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        # the densest strategy and the shortest matches, as texts are a few characters long
        params = zstandard.ZstdCompressionParameters.from_level(3, min_match=3, strategy=zstandard.STRATEGY_BTULTRA, search_log=8, target_length=999, **options)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        self.compressor = zstandard.ZstdCompressor(compression_params=params, **({"dict_data": known} if known else {}))

    def bits(self, text: str) -> int:
        return 8 * len(self.compressor.compress((EDGE + text + EDGE).encode(UNITS, "surrogatepass")))


def chain_bits(chain: tuple[str, ...]) -> float:
    return PRIOR_BITS + STEP_BITS * len(chain) if chain else 0.0


def restore(text: str, right: str, describer: Describer) -> tuple[str | None, str]:
    """The text with the shortest description, and its chain; None when that is the text as it stands."""
    best = (describer.bits(text), 0, None, ())
    for n, (got, chain) in enumerate(undo(text, right), 1):
        best = min(best, (describer.bits(got) + chain_bits(chain), n, got, chain), key=lambda x: x[:2])
    return best[2], ">".join(best[3])


class ByteIndex:
    """The words of one dictionary as bytes, found by pairs of neighbouring bytes; a look-up reads the words of two rare pairs."""

    def __init__(self, words: list[str], right: str):
        self.right = right
        pairs = [(w, b) for w in words if (b := _encode(w, right))]
        self.words, self.raw = [w for w, _ in pairs], [b for _, b in pairs]
        self.sizes = np.array([len(b) for b in self.raw] or [0], np.int64)[: len(self.raw)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        # what follows the last word can be read but belongs to none
        self.blob = np.frombuffer(b"".join(self.raw) + bytes(WIDTH), np.uint8)
        # byte pairs inside words only
        blob = self.blob[:-WIDTH].astype(np.int64)
        owner = np.repeat(np.arange(len(self.raw)), self.sizes)
        code = blob[:-1] << 8 | blob[1:]
        inside = owner[:-1] == owner[1:]
        at = np.arange(len(blob)) - np.repeat(self.starts, self.sizes)
        code, owner, at = code[inside], owner[:-1][inside], at[:-1][inside]
        # by pair, then by the word's size
        key = code << 8 | np.minimum(self.sizes[owner], 255)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.place = key[order], owner[order], at[order]
        self.by_size = np.argsort(self.sizes, kind="stable")
        self.sorted_sizes = self.sizes[self.by_size]
        self._blanked: dict[int, tuple[str, str]] | None = None

    def fitting(self, parts: list[bytes]) -> str | None:
        """A word whose bytes read as `parts` with one to GAP bytes gone at each break, and at most at one further place."""
        known = sum(map(len, parts))
        if known == 0:
            return None
        low, high = known + len(parts) - 1, known + GAP * len(parts)
        spans, before = [], 0
        for k, p in enumerate(parts):
            for i in range(len(p) - 1):
                code = (p[i] << 8 | p[i + 1]) << 8
                a, b = np.searchsorted(self.key, (code | min(low, 255), (code | min(high, 255)) + 1))
                spans.append((int(b - a), int(a), int(b), before + i + k, before + i + GAP * (k + 1)))
            before += len(p)
        if len(spans) > 1:
            # a further loss parts one pair at most
            found = []
            for _, a, b, first, last in sorted(spans)[:2]:
                place = self.place[a:b]
                found.append(self.owner[a:b][(place >= first) & (place <= last)])
            found = np.concatenate(found)
        else:
            found = self.by_size[np.searchsorted(self.sorted_sizes, low) : np.searchsorted(self.sorted_sizes, high, side="right")]
        for at in range(0, len(found), 8192):
            some = found[at : at + 8192]
            hit = self._fits(some, parts)
            if len(hit):
                return self.words[some[hit[0]]]
        return None

    def _fits(self, found: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """Which of the words fit, all at once: the places reached in each word are the bits of a number."""
        if not len(found):
            return found
        sizes = self.sizes[found].astype(np.uint64)
        if int(sizes.max()) >= WIDTH:
            return np.array([i for i, w in enumerate(found) if _fits_one(self.raw[w], parts)], np.int64)
        text = self.blob[self.starts[found][:, None] + np.arange(WIDTH)]
        inside = (np.uint64(1) << sizes) - np.uint64(1)
        plain, further = np.ones(len(found), np.uint64), np.zeros(len(found), np.uint64)
        for i, part in enumerate(parts):
            if i:
                plain, further = _skip(plain), _skip(further)
            for b in part:
                at = np.packbits(text == b, axis=1, bitorder="little").view("<u8")[:, 0] & inside
                further |= _skip(plain)
                plain, further = (plain & at) << np.uint64(1), (further & at) << np.uint64(1)
        further |= _skip(plain)
        return np.flatnonzero((plain | further) >> sizes & np.uint64(1))

    def blanked(self, n: int) -> tuple[str, str] | None:
        """A word of which nothing but n replacement characters is left, and the wrong reading that does so."""
        if self._blanked is None:
            self._blanked = {}
            for w, b in zip(self.words, self.raw):
                if not b.isascii():
                    for wrong in dict.fromkeys(("ascii", "utf-8", *WRONG)):
                        if not (got := b.decode(wrong, "replace")).strip(LOST):
                            self._blanked.setdefault(len(got), (w, wrong))
        return self._blanked.get(n)

    def lost(self, text: str, describer: Describer) -> tuple[float, str] | None:
        """Bits and chain of the shortest description by a word of which `text` is what is left; None when the text's own is shorter."""
        found = []
        if not text.strip(LOST):
            if hit := self.blanked(len(text)):
                found.append((hit[0], (hit[1],)))
        else:
            # of readings as the same bytes the first has the cheapest chain
            readings: dict[tuple[bytes, ...], tuple[str, ...]] = {}
            for chain, parts in sorted(_readings(text, self.right), key=lambda r: len(r[0])):
                readings.setdefault(tuple(parts), chain)
            for parts, chain in readings.items():
                if (word := self.fitting(list(parts))) is not None:
                    found.append((word, chain))
        own = describer.bits(text) + REPLACED_BITS * text.count(LOST)
        best = min(((describer.bits(w) + chain_bits(chain) + LOSS_BITS, n, ">".join(chain)) for n, (w, chain) in enumerate(found)), default=None)
        return (best[0], best[2]) if best and best[0] < own else None


def _skip(places: np.ndarray) -> np.ndarray:
    out = np.zeros_like(places)
    for k in range(1, GAP + 1):
        out |= places << np.uint64(k)
    return out


def _fits_one(word: bytes, parts: list[bytes]) -> bool:
    """ByteIndex._fits for one word of any length."""
    at = {b: sum(1 << i for i, x in enumerate(word) if x == b) for b in set(word)}
    skip = lambda places: places << 1 | places << 2 | places << 3
    plain, further = 1, 0
    for i, part in enumerate(parts):
        if i:
            plain, further = skip(plain), skip(further)
        for b in part:
            further |= skip(plain)
            plain, further = (plain & at.get(b, 0)) << 1, (further & at.get(b, 0)) << 1
    further |= skip(plain)
    return bool((plain | further) >> len(word) & 1)


def _readings(text: str, right: str) -> Iterator[tuple[tuple[str, ...], list[bytes]]]:
    """Chains that may have left `text`, with the word's bytes between the losses."""
    for wrong in dict.fromkeys((right, "ascii", *WRONG)):
        parts = [_encode(p, wrong) for p in text.split(LOST)]
        if None in parts:
            continue
        yield (wrong,), parts
        if wrong != "utf-8" and right != "utf-8" or wrong in ("cp1252", "latin-1"):
            again = b"\xff".join(parts).decode("utf-8", "replace")
            for second in ("cp1252", "latin-1"):
                deeper = [_encode(p, second) for p in again.split(LOST)]
                if None not in deeper:
                    yield (wrong, second), deeper


#: Dictionaries whose encodings, and languages whose samples, are shipped to the workers; more are an error.
MOST_DICTIONARIES, MOST_LANGUAGES = 100_000, 1_000
RESTORED_DDL = "text string, chain string"
RESTORED = pa.struct([("text", pa.string()), ("chain", pa.string())])


def language_samples(lexicon: DataFrame, dictionaries: dict[str, tuple[str, str]]) -> dict[str, list[str]]:
    """For each language group at most DICTIONARY_BYTES of its words: all where they fit, else those of the smallest hashes."""
    spark = lexicon.sparkSession
    groups = spark.createDataFrame([(n, g) for n, (_, g) in dictionaries.items()], "dict_name string, g string")
    words = lexicon.where("surface IS NOT NULL").join(F.broadcast(groups), "dict_name").select(F.coalesce("g", F.lit("")).alias("g"), "surface")
    sized = words.withColumn("n", 2 * F.length("surface") + len(EDGE.encode(UNITS)))
    totals = {r.g: r.n for r in sized.groupBy("g").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return {}
    shares = spark.createDataFrame([(g, min(1.0, DICTIONARY_BYTES / n)) for g, n in totals.items()], "g string, share double")
    hashed = sized.join(F.broadcast(shares), "g").withColumn("h", F.xxhash64("surface")).where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    out: dict[str, list[str]] = {}
    room = dict.fromkeys(totals, DICTIONARY_BYTES)
    for r in sorted(hashed.select("g", "surface", "n", "h").distinct().collect(), key=lambda r: (r.h, r.surface)):
        if room[r.g] >= r.n:
            room[r.g] -= r.n
            out.setdefault(r.g, []).append(r.surface)
    return out


class _Describers(dict):
    """Describers by dict_name, each made when first asked for."""

    def __init__(self, dictionaries: dict[str, tuple[str, str]], samples: dict[str, list[str]]):
        super().__init__()
        self.dictionaries, self.samples, self.by_group = dictionaries, samples, {}

    def __missing__(self, name: str) -> Describer:
        group = self.dictionaries.get(name, ("", ""))[1] or ""
        if group not in self.by_group:
            self.by_group[group] = Describer(self.samples.get(group, []))
        self[name] = self.by_group[group]
        return self[name]


def restore_column(text: Column, dict_name: Column, dictionaries: dict[str, tuple[str, str]], samples) -> Column:
    """A struct (text, chain) for each text. text is NULL when the text stands as it is.

    dictionaries: encoding label and language group by dict_name; samples: a broadcast of sample words by language group.
    """
    state: dict = {}

    def restored(texts: pa.Array, names: pa.Array) -> pa.Array:
        if not state:
            state["by"] = _Describers(dictionaries, samples.value)
        out = []
        for t, name in zip(texts.to_pylist(), names.to_pylist()):
            got = (None, "") if t is None else restore(t, codec_of(dictionaries.get(name, ("utf-8", ""))[0]), state["by"][name])
            out.append(dict(zip(("text", "chain"), got)))
        return pa.array(out, RESTORED)

    return F.arrow_udf(restored, RESTORED_DDL)(text, dict_name)


def _cells(total: int, size: int) -> int:
    return max(1, -(-total // size))


def confirm_lost(texts: DataFrame, lexicon: DataFrame, dictionaries: dict[str, tuple[str, str]], samples) -> DataFrame:
    """dict_name, surface and chain of the texts with lost characters that are what is left of a word of their dictionary.

    Texts and words meet in cells of bounded size (block of words by block of texts of one dictionary), so neither a large
    dictionary nor one that has most of the texts is gathered in one place.
    """
    words = lexicon.select("dict_name", "surface").where("surface IS NOT NULL")
    most = words.groupBy("dict_name").count().agg(F.max("count")).first()[0] or 0
    blocks, salts = _cells(most, CELL_WORDS), _cells(texts.count(), CELL_TEXTS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.select("dict_name", "surface", F.pmod(F.xxhash64("surface"), F.lit(salts)).cast("int").alias("s"), every(blocks).alias("b"))
    right = words.select("dict_name", F.col("surface").alias("word"), F.pmod(F.xxhash64("surface"), F.lit(blocks)).cast("int").alias("b"), every(salts).alias("s"))
    # words of dictionaries without lost texts needn't move
    right = right.join(F.broadcast(texts.select("dict_name").distinct().limit(MOST_DICTIONARIES)), "dict_name", "left_semi")

    def confirmed(some: pa.Table, block: pa.Table) -> pa.Table:
        rows = []
        if some.num_rows and block.num_rows:
            name = some.column("dict_name")[0].as_py()
            index = ByteIndex(block.column("word").to_pylist(), codec_of(dictionaries.get(name, ("utf-8", ""))[0]))
            describer = _Describers(dictionaries, samples.value)[name]
            for t in some.column("surface").to_pylist():
                if hit := index.lost(t, describer):
                    rows.append((name, t, *hit))
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("dict_name", pa.string()), ("surface", pa.string()), ("bits", pa.float64()), ("chain", pa.string())))})

    cell = ("dict_name", "b", "s")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(confirmed, "dict_name string, surface string, bits double, chain string")
    return found.groupBy("dict_name", "surface").agg(F.min_by("chain", F.struct("bits", "chain")).alias("chain"))


def restore_rows(rows: DataFrame, lexicon: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """The rows (dict_name, surface and any others) whose surface is a garbled lexicon word, with word_id and chain.

    word_id is -1 when characters were lost for good. A NULL surface, one without a character beyond ASCII and one that is a
    word of its dictionary are left out. Each distinct surface of a dictionary is restored once; restored text is confirmed
    by an equality join with the lexicon, lost text in cells (confirm_lost). Lexicon and rows may have any size. Where rows has
    columns named like the added ones, an underscore is put behind the new names. An empty table gives no row.
    """
    spark = rows.sparkSession
    known = {r.dict_name: (r.encoding, r.lang_group) for r in dictionaries.select("dict_name", "encoding", "lang_group").limit(MOST_DICTIONARIES + 1).collect()}
    if len(known) > MOST_DICTIONARIES:
        raise ValueError(f"more than {MOST_DICTIONARIES} dictionaries")
    samples = spark.sparkContext.broadcast(language_samples(lexicon, known))
    beyond = rows.where(F.col("surface").rlike(r"[^\x00-\x7F]"))
    texts = stable(outside(beyond.select("dict_name", "surface").distinct(), lexicon))
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = texts.where(~F.col("surface").contains(LOST)).repartition(cores)
    tried = whole.withColumn("__r", restore_column(F.col("surface"), F.col("dict_name"), known, samples)).where("__r.text IS NOT NULL")
    targets = lexicon.select("dict_name", F.col("surface").alias("__text"), F.col("word_id").alias("__word")).dropDuplicates(["dict_name", "__text"])
    back = join_table(tried.select("dict_name", "surface", F.col("__r.text").alias("__text"), F.col("__r.chain").alias("__chain")), targets, ["dict_name", "__text"])
    lost = confirm_lost(texts.where(F.col("surface").contains(LOST)), lexicon, known, samples)
    found = stable(back.select("dict_name", "surface", F.col("__word").cast("long").alias("__word"), "__chain").unionByName(lost.select("dict_name", "surface", F.lit(-1).cast("long").alias("__word"), F.col("chain").alias("__chain"))))
    out = join_table(beyond, found, ["dict_name", "surface"])
    return out.select(*columns(rows), F.col("__word").alias(free(rows, "word_id")), F.col("__chain").alias(free(rows, "chain")))
