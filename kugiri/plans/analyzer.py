"""The analysis chain: character filters, segmentation, token filters, offset correction; on texts and on DataFrames.

On DataFrames the chain is one Arrow pass over the text column: no shuffle, no row-at-a-time function. Token filters at the
end of the chain that Spark can express are left to it as Column expressions.
"""

import json
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, StructType, TimestampType

from kugiri.functions.charfilters import CharacterFilter, character_filter, correct_offsets, size
from kugiri.functions.tokenfilters import ByField, TokenFilter, token_filter
from kugiri.model import TOKEN_DDL, UNKNOWN, AnalysisError, ErrorKind, Mode, Token
from kugiri.operators.lattice import Lattice, sentences
from kugiri.operators.spans import Spans, separable, unbounded
from kugiri.sources.dictionary import Dictionary, UserDictionary, load_dictionary

#: Paths kept by a task, of texts between white space or of sentences, and the longest text kept.
CACHED, CACHED_CHARS = 200_000, 100
#: Paths of a span beyond those asked for that are compared with them.
MOST_TIES = 64
#: Characters of texts whose token rows are made at once.
CHARS_AT_ONCE = 1_000_000
#: Types of columns that go along with flat token rows.
FLAT = (NumericType, StringType, BooleanType, DateType, TimestampType, BinaryType)
TOKEN = pa.struct([("surface", pa.string()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("position", pa.int32()), ("position_length", pa.int32()), ("word_id", pa.int64()), ("lex_type", pa.string()), ("is_unknown", pa.bool_()), ("details", pa.list_(pa.string()))])


class Memo(dict):
    """Results by key, made when first asked for; emptied when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value


class Segmenter:
    """Texts to tokens by one dictionary under one set of options."""

    def __init__(self, dictionary: Dictionary, mode: "Mode | str | dict | None" = None, keep_whitespace: bool = False, max_grouping_len: int | None = None, unknown_word_ladder: bool = True):
        self.dictionary, self.mode = dictionary, Mode.parse(mode)
        self.keep_whitespace, self.max_grouping_len, self.ladder = keep_whitespace, max_grouping_len or None, unknown_word_ladder
        self.reset()

    @classmethod
    def from_config(cls, config: dict) -> "Segmenter":
        if not isinstance(config.get("dictionary"), str):
            raise AnalysisError(ErrorKind.PARSE, "segmenter.dictionary is missing")
        dictionary = load_dictionary(config["dictionary"])
        if isinstance(config.get("user_dictionary"), str):
            dictionary = dictionary.with_user(UserDictionary.load(config["user_dictionary"], dictionary.metadata))
        try:
            mode = Mode.parse(config.get("mode"))
        except AnalysisError as e:
            raise AnalysisError(ErrorKind.PARSE, e.message) from e
        keep = config.get("keep_whitespace") is True
        if not keep and dictionary.categories.space is None:
            raise AnalysisError(ErrorKind.PARSE, "the dictionary has no category SPACE, by which white space is dropped")
        cap = config.get("max_grouping_len")
        return cls(dictionary, mode, keep, cap if isinstance(cap, int) and cap > 0 else None, config.get("unknown_word_ladder") is not False)

    # a session's options may change between texts
    def reset(self) -> None:
        self.lattice = Lattice(self.dictionary, self.mode, self.max_grouping_len, self.ladder)
        self.cache: dict[tuple, list] = {}
        self.gaps = self.lattice.separators()
        if self.gaps:
            self.gap = self.dictionary.unknown[self.dictionary.categories.space][0]

    def set_mode(self, mode) -> None:
        self.mode = Mode.parse(mode)
        self.reset()

    def set_keep_whitespace(self, keep: bool) -> None:
        self.keep_whitespace = keep
        self.reset()

    def set_max_grouping_len(self, n: int | None) -> None:
        self.max_grouping_len = n or None
        self.reset()

    def set_unknown_word_ladder(self, on: bool) -> None:
        self.ladder = on
        self.reset()

    def shrink_to(self, n: int) -> None:
        """Keeps the paths of at most n sentences."""
        while len(self.cache) > n:
            self.cache.pop(next(iter(self.cache)))

    def __getstate__(self):
        return self.dictionary, self.mode, self.keep_whitespace, self.max_grouping_len, self.ladder

    def __setstate__(self, state):
        self.__init__(*state)

    def _path(self, sentence: str) -> list:
        """The best path: each word's text, byte length, id, type and whether it is white space."""
        if self.gaps is None:
            return self._between(sentence, True, True)
        parts = self.gaps.split(sentence)
        if len(parts) == 1:
            return self._between(sentence, True, True)
        out, last = [], len(parts) - 1
        for i, part in enumerate(parts):
            if i & 1:
                out.append(self._forced(part))
            elif part:
                out += self._between(part, i == 0, i == last)
        return out

    def _between(self, text: str, first: bool, last: bool) -> list:
        key = (text, first, last)
        got = self.cache.get(key)
        if got is None:
            path, _ = self.lattice.best(text, 0 if first else self.gap[1], 0 if last else self.gap[0], last)
            got = [self._word(text, *x) for x in path]
            if len(text) <= CACHED_CHARS:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[key] = got
        return got

    def _forced(self, text: str) -> tuple:
        """The word of a run that every path takes whole."""
        kind = self.dictionary.categories.of(text[0])[0]
        return text, size(text), self.dictionary.unknown[kind][0][3], UNKNOWN, kind == self.dictionary.categories.space

    def _word(self, sentence: str, start: int, end: int, word: int, kind: str) -> tuple:
        text = sentence[start:end]
        space = self.dictionary.categories.space
        blank = space is not None and (text == " " or all(space in k for k in map(self.lattice.kinds.get, text) if k is not None))
        return text, size(text), word, kind, blank

    def words(self, text: str):
        """(text, first byte, end byte, word id, type) of every kept word."""
        at = 0
        keep = self.keep_whitespace
        for sentence in sentences(text):
            for surface, n, word, kind, blank in self._path(sentence):
                if keep or not blank:
                    yield surface, at, at + n, word, kind
                at += n

    def segment(self, text: str) -> list[Token]:
        return [Token(s, a, b, i, w, k, self.dictionary) for i, (s, a, b, w, k) in enumerate(self.words(text))]

    def segment_nbest(self, text: str, n: int, unique: bool = False, cost_threshold: int | None = None) -> list[tuple[list[Token], int]]:
        """Candidates by rank. Ranks are joined sentence by sentence, their costs added; a sentence with fewer paths is
        missing from higher ranks. Within a rank, offsets go on from the last kept token."""
        ranks: list[list] = []
        for sentence in sentences(text):
            for rank, (path, cost) in enumerate(self.lattice.nbest(sentence, n, unique, cost_threshold)):
                if rank == len(ranks):
                    ranks.append([[], 0])
                tokens = ranks[rank][0]
                ranks[rank][1] += cost
                at, position = tokens[-1].byte_end if tokens else 0, len(tokens)
                for x in path:
                    surface, length, word, kind, blank = self._word(sentence, *x)
                    if self.keep_whitespace or not blank:
                        tokens.append(Token(surface, at, at + length, position, word, kind, self.dictionary))
                        position += 1
                    at += length
        return [(t, c) for t, c in ranks]


class Pieces:
    """Texts as numbers of pieces (spans between white space, and runs of it), from whose tokens columns are gathered at once.

    A piece has a length in bytes and its kept tokens (number, first and end byte); a token's number stands for its surface, id
    and type, and for what the token filters make of it. All are made when a piece is first seen.
    """

    def __init__(self, tokenizer: "Tokenizer"):
        self.tokenizer, self.segmenter, self.final = tokenizer, tokenizer.segmenter, tokenizer._final()
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.alive, self.surfaces, self.words, self.kinds, self.details = [], [], [], [], []
        self.sizes, self.begins, self.tokens, self.starts, self.ends = [], [0], [], [], []
        memo = lambda first, last: _Numbers(lambda text: self._piece(self.segmenter._between(text, first, last) if text else ()))
        self.spans = {(a, b): memo(a, b) for a in (False, True) for b in (False, True)}
        self.gaps = _Numbers(lambda text: self._piece([self.segmenter._forced(text)]))

    def _piece(self, words) -> int:
        at = 0
        for surface, n, word, kind, blank in words:
            if self.segmenter.keep_whitespace or not blank:
                key = (surface, word, kind)
                number = self.numbers.get(key)
                if number is None:
                    number = self.numbers[key] = len(self.alive)
                    made = self.final[key]
                    self.alive.append(made is not None)
                    self.surfaces.append(made[0] if made else "")
                    self.details.append(made[1] if made else [])
                    self.words.append(word)
                    self.kinds.append(kind)
                self.tokens.append(number)
                self.starts.append(at)
                self.ends.append(at + n)
            at += n
        self.sizes.append(at)
        self.begins.append(len(self.tokens))
        return len(self.sizes) - 1

    def _numbers_of(self, text: str, out: list[int]) -> None:
        whole, begin, end, middle = self.spans[True, True], self.spans[True, False], self.spans[False, True], self.spans[False, False]
        for sentence in sentences(text):
            parts = self.segmenter.gaps.split(sentence)
            if len(parts) == 1:
                out.append(whole[sentence])
                continue
            own = [begin[parts[0]]] * len(parts)
            own[1::2] = map(self.gaps.__getitem__, parts[1::2])
            own[2:-1:2] = map(middle.__getitem__, parts[2:-1:2])
            own[-1] = end[parts[-1]]
            out += own

    def columns(self, texts: list[str | None], with_details: bool) -> tuple[list[int | None], list[pa.Array]]:
        if len(self.sizes) > CACHED:
            self.clear()
        pieces: list[int] = []
        cuts = [0]
        for text in texts:
            if text:
                self._numbers_of(text, pieces)
            cuts.append(len(pieces))
        ids, cut = np.array(pieces, np.int64), np.array(cuts, np.int64)
        begins = np.array(self.begins, np.int64)
        bytes_to = np.concatenate(([0], np.cumsum(np.array(self.sizes or [0], np.int64)[ids])))
        count = begins[ids + 1] - begins[ids]
        tokens_to = np.concatenate(([0], np.cumsum(count)))
        n = int(tokens_to[-1])
        at = np.repeat(begins[ids] - tokens_to[:-1], count) + np.arange(n)
        # the text each piece is of, its first byte and first token
        text_of = np.repeat(np.arange(len(texts)), np.diff(cut))
        base = np.repeat(bytes_to[:-1] - bytes_to[cut[:-1]][text_of], count)
        position = np.arange(n) - np.repeat(tokens_to[cut[:-1]][text_of], count)
        number = np.array(self.tokens, np.int64)[at]
        kept = np.array(self.alive, bool)[number]
        kept_to = np.concatenate(([0], np.cumsum(kept)))[tokens_to[cut]].tolist()
        offsets = [None if t is None else k for t, k in zip(texts, kept_to)]
        number, at, base, position = number[kept], at[kept], base[kept], position[kept]
        places = pa.array(number)
        take = lambda values, kind: pa.array(values, kind).take(places)
        kinds = take(self.kinds, pa.string())
        int32 = lambda x: pa.array(x.astype(np.int32))
        details = take(self.details, pa.list_(pa.string())) if with_details else pa.nulls(len(number), pa.list_(pa.string()))
        arrays = [take(self.surfaces, pa.string()), int32(base + np.array(self.starts, np.int64)[at]), int32(base + np.array(self.ends, np.int64)[at]), int32(position), pa.repeat(pa.scalar(1, pa.int32()), len(number)), take(self.words, pa.int64()), kinds, pc.equal(kinds, UNKNOWN), details]
        return [*offsets, kept_to[-1]], arrays


class Ranks:
    """The n cheapest analyses of texts as costs and joined surfaces, without filters, from the paths of the spans between forced runs.

    A sentence's costs are sums of its spans' costs. Where all paths that count for a span have one text, so have the
    sentence's, in whatever order equal costs come; where a span has several, they are put together too. Only a sentence with
    different texts of equal cost among its ranks is searched as a whole, as the search itself decides their order.
    """

    def __init__(self, segmenter: Segmenter, n: int, separator: str):
        self.segmenter, self.n, self.separator = segmenter, n, separator
        memo = lambda first, last: Memo(lambda text: self._span(text, first, last))
        self.spans = {(a, b): memo(a, b) for a in (False, True) for b in (False, True)}
        self.gaps, self.sums = Memo(self._gap), Memo(self._least)

    @staticmethod
    def fit(segmenter: Segmenter) -> bool:
        return segmenter.gaps is not None and segmenter.mode.penalty is None and unbounded(segmenter.lattice)

    def _joined(self, words) -> str:
        return self.separator.join([w[0] for w in words if self.segmenter.keep_whitespace or not w[4]])

    def _path(self, text: str, path) -> str:
        return self._joined([self.segmenter._word(text, *x) for x in path])

    def _span(self, text: str, first: bool, last: bool) -> tuple[int, str, tuple[int, ...], list[tuple[int, str | None]] | None]:
        """Cost and text of the best path, by how much the next ones cost more; and, where some have another text, all that count with their texts."""
        lattice, gap = self.segmenter.lattice, self.segmenter.gap
        before, after = 0 if first else gap[1], 0 if last else gap[0]
        if not text:
            return lattice.d.costs[after][before], "", (), None
        found: list[tuple[str, int]] = []
        for path, cost in lattice.paths(text, before, after):
            if len(found) >= self.n and cost > found[self.n - 1][1]:
                break
            found.append((self._path(text, path), cost))
            if len(found) == self.n + MOST_TIES:
                return found[0][1], found[0][0], (), []
        (best, least), *rest = found
        others = [(c - least, None if t == best else t) for t, c in rest]
        return least, best, tuple([c for c, _ in others[: self.n - 1]]), others if any(t is not None for _, t in others) else None

    def _gap(self, text: str) -> tuple[int, str, tuple[int, ...], None]:
        d = self.segmenter.dictionary
        return d.unknown[d.categories.of(text[0])[0]][0][2], self._joined([self.segmenter._forced(text)]), (), None

    def _least(self, more: tuple[tuple[int, ...], ...]) -> list[int]:
        """What the second and further of the n least sums cost more than the least, with one number or none of each tuple."""
        sums = [0]
        for own in more:
            sums = sorted([a + b for a in sums for b in (0, *own)])[: self.n]
        return sums[1:]

    def _mixed(self, own: list[tuple]) -> list[tuple[int, tuple]] | None:
        """By rank: what a sentence of these spans costs more, and the texts that change by their places; None where the order is open."""
        found: list[tuple[int, tuple]] = [(0, ())]
        for k, (_, _, more, others) in enumerate(own):
            if others is None:
                others = [(c, None) for c in more]
            elif not others:
                return None
            if not others or len(found) >= self.n and others[0][0] > found[-1][0]:
                continue
            found += [(a + c, changed if t is None else (*changed, (k, t))) for a, changed in found for c, t in others]
            found.sort(key=lambda x: x[0])
            # what costs as much as the last of n stays
            to = self.n
            while self.n < len(found) and to < len(found) and found[to][0] == found[self.n - 1][0]:
                to += 1
            del found[to:]
            if len(found) > self.n + MOST_TIES:
                return None
        return found[: self.n] if all(a[0] != b[0] or a[1] == b[1] for a, b in zip(found, found[1:])) else None

    def of(self, text: str) -> list[tuple[int, str]]:
        """By rank: the cost and the surfaces, as Segmenter.segment_nbest has them."""
        whole, begin, end, middle = self.spans[True, True], self.spans[True, False], self.spans[False, True], self.spans[False, False]
        split, forced, n = self.segmenter.gaps.split, self.gaps.__getitem__, self.n
        costs, texts = [0] * n, [[] for _ in range(n)]
        for sentence in sentences(text):
            parts = split(sentence)
            if len(parts) == 1:
                own = [whole[sentence]]
            else:
                own = [begin[parts[0]]] * len(parts)
                own[1::2] = map(forced, parts[1::2])
                own[2:-1:2] = map(middle.__getitem__, parts[2:-1:2])
                own[-1] = end[parts[-1]]
            least, words, more, others = zip(*own)
            if others.count(None) < len(others):
                mixed = self._mixed(own)
                if mixed is None:
                    for rank, (path, cost) in enumerate(self.segmenter.lattice.nbest(sentence, n)):
                        costs[rank] += cost
                        texts[rank].append(self._path(sentence, path))
                    continue
                cost = sum(least)
                for rank, (extra, changed) in enumerate(mixed):
                    own = list(words)
                    for k, t in changed:
                        own[k] = t
                    costs[rank] += cost + extra
                    texts[rank].append(self.separator.join(filter(None, own)))
                continue
            cost, joined = sum(least), self.separator.join(filter(None, words))
            costs[0] += cost
            texts[0].append(joined)
            # of other spans not even the cheapest change is among the n least
            if more := tuple(sorted(filter(None, more))[: n - 1]):
                for rank, extra in enumerate(self.sums[more], 1):
                    costs[rank] += cost + extra
                    texts[rank].append(joined)
        return [(c, self.separator.join(filter(None, own))) for c, own in zip(costs, texts) if own]


class _Numbers(dict):
    """The number of a piece, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> int:
        number = self.make(text)
        if len(text) <= CACHED_CHARS:
            self[text] = number
        return number


@dataclass
class Tokenizer:
    """A segmenter with filters around it."""

    segmenter: Segmenter
    character_filters: list[CharacterFilter] = field(default_factory=list)
    token_filters: list[TokenFilter] = field(default_factory=list)

    @classmethod
    def from_config(cls, config: dict) -> "Tokenizer":
        """Filter entries without a string `kind` are passed over."""
        if not isinstance(config, dict) or not isinstance(config.get("segmenter"), dict):
            raise AnalysisError(ErrorKind.DESERIALIZE, "segmenter configuration is missing")
        entries = lambda name: [(e["kind"], e.get("args") or {}) for e in config.get(name) or [] if isinstance(e, dict) and isinstance(e.get("kind"), str)]
        return cls(Segmenter.from_config(config["segmenter"]), [character_filter(*e) for e in entries("character_filters")], [token_filter(*e) for e in entries("token_filters")])

    def _filtered(self, text: str) -> tuple[str, list]:
        mappings = []
        for f in self.character_filters:
            text, mapping = f.apply(text)
            if mapping:
                mappings.append(mapping)
        return text, mappings

    def tokenize(self, text: str) -> list[Token]:
        text, mappings = self._filtered(text)
        tokens = self.segmenter.segment(text)
        for f in self.token_filters:
            tokens = f.apply(tokens)
        if mappings:
            correct_offsets(tokens, mappings, size(text))
        return tokens

    def tokenize_nbest(self, text: str, n: int, unique: bool = False, cost_threshold: int | None = None) -> list[tuple[list[Token], int]]:
        text, mappings = self._filtered(text)
        out = []
        for tokens, cost in self.segmenter.segment_nbest(text, n, unique, cost_threshold):
            for f in self.token_filters:
                tokens = f.apply(tokens)
            correct_offsets(tokens, mappings, size(text))
            out.append((tokens, cost))
        return out

    def tokenize_surfaces(self, text: str) -> list[str]:
        """The surfaces of tokenize(). Filters that look at one token alone are applied once to each word."""
        if not all(f.one_by_one for f in self.token_filters):
            return [t.surface for t in self.tokenize(text)]
        text, _ = self._filtered(text)
        s, final = self.segmenter, self._final()
        if s.gaps is None or s.keep_whitespace:
            keep = s.keep_whitespace
            return [f[0] for part in sentences(text) for w in s._path(part) if (keep or not w[4]) and (f := final[w[0], w[2], w[3]]) is not None]
        if s.cache is not self.__dict__.get("_of"):  # new options bring a new cache
            made = lambda first, last: Memo(lambda word: [f[0] for w in (s._between(word, first, last) if word else ()) if not w[4] and (f := final[w[0], w[2], w[3]]) is not None])
            self._of, self._spans = s.cache, {(a, b): made(a, b) for a in (False, True) for b in (False, True)}
            self._runs = Memo(lambda run: [f[0] for w in (s._forced(run),) if not w[4] and (f := final[w[0], w[2], w[3]]) is not None])
        spans, out = self._spans, []
        middle, begin, end, whole, split, forced = spans[False, False], spans[True, False], spans[False, True], spans[True, True], s.gaps.split, self._runs.__getitem__
        for part in sentences(text):
            words = split(part)
            if len(words) == 1:
                out += whole[part]
            else:
                own = [begin[words[0]]] * len(words)
                own[1::2] = map(forced, words[1::2])
                own[2:-1:2] = map(middle.__getitem__, words[2:-1:2])
                own[-1] = end[words[-1]]
                out += chain.from_iterable(own)
        return out

    def _final(self) -> Memo:
        """What the token filters make of a word, by surface, id and type: surface and details, or None."""
        if self.__dict__.get("_made_for") is not self.segmenter:
            dictionary, filters = self.segmenter.dictionary, self.token_filters

            def make(key):
                tokens = [Token(key[0], 0, 0, 0, key[1], key[2], dictionary)]
                for f in filters:
                    tokens = f.apply(tokens)
                return (tokens[0].surface, tokens[0].details) if tokens else None

            self._made_for, self._finals = self.segmenter, Memo(make)
        return self._finals

    def _pieces(self) -> "Pieces":
        if self.segmenter.cache is not self.__dict__.get("_pieces_of"):
            self._pieces_of, self._made_pieces = self.segmenter.cache, Pieces(self)
        return self._made_pieces

    def __getstate__(self):
        return self.segmenter, self.character_filters, self.token_filters

    def __setstate__(self, state):
        self.__init__(*state)

    # DataFrames -----------------------------------------------------------------------------------------------

    def _split(self) -> tuple["Tokenizer", list]:
        """The chain for the Arrow pass, and the trailing filters as Column functions. Identity filters fall away."""
        own = [f for f in self.token_filters if not f.is_identity()]
        columns: list = []
        while own:
            last = own[-1]
            column = last.column_for(self.segmenter.dictionary.schema) if isinstance(last, ByField) else last.column
            # without character filters offsets don't depend on when tokens are dropped
            if column is None:
                break
            columns.append(column)
            own.pop()
        return Tokenizer(self.segmenter, [f for f in self.character_filters if not f.is_identity()], own), columns[::-1]

    def tokens(self, spark: SparkSession, text: Column | str, details: bool = True) -> Column:
        """An array column of token structs; NULL for NULL, an empty array for an empty text.

        Without details they are NULL and don't travel; word_id and lex_type say where they are (operators.entries). Spark can't
        prune what a Python function gives, so this is up to the caller.
        """
        own, columns = self._split() if details else (Tokenizer(self.segmenter, self.character_filters, self.token_filters), [])
        shipped = spark.sparkContext.broadcast(own)

        def tokenize(texts: pa.Array) -> pa.Array:
            own = shipped.value
            if all(f.one_by_one for f in own.token_filters):
                return word_arrays(own, texts.to_pylist(), details)
            return token_arrays([None if t is None else own.tokenize(t) for t in texts.to_pylist()], details)

        out = F.arrow_udf(tokenize, f"array<struct<{TOKEN_DDL.replace(' ', ':').replace(',:', ', ')}>>")(F.col(text) if isinstance(text, str) else text)
        for column in columns:
            out = column(out)
        return out

    def surfaces(self, spark: SparkSession, text: Column | str) -> Column:
        """An array column of surfaces; details are never made."""
        shipped = spark.sparkContext.broadcast(Tokenizer(self.segmenter, [f for f in self.character_filters if not f.is_identity()], [f for f in self.token_filters if not f.is_identity()]))

        def surface(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else shipped.value.tokenize_surfaces(t) for t in texts.to_pylist()], pa.list_(pa.string()))

        return F.arrow_udf(surface, "array<string>")(F.col(text) if isinstance(text, str) else text)

    def nbest(self, spark: SparkSession, text: Column | str, n: int, unique: bool = False, cost_threshold: int | None = None) -> Column:
        """An array column of candidates (rank from 1, cost, tokens); NULL for NULL."""
        shipped = spark.sparkContext.broadcast(self)

        def candidates(texts: pa.Array) -> pa.Array:
            found = [None if t is None else shipped.value.tokenize_nbest(t, n, unique, cost_threshold) for t in texts.to_pylist()]
            flat = [c for own in found if own for c in own]
            inner = pa.StructArray.from_arrays([pa.array([k for own in found if own for k in range(1, len(own) + 1)], pa.int32()), pa.array([c for _, c in flat], pa.int64()), token_arrays([t for t, _ in flat])], ["rank", "cost", "tokens"])
            return _lists(found, inner)

        token = f"struct<{TOKEN_DDL.replace(' ', ':').replace(',:', ', ')}>"
        return F.arrow_udf(candidates, f"array<struct<rank:int, cost:bigint, tokens:array<{token}>>>")(F.col(text) if isinstance(text, str) else text)

    def tokenize_rows(self, df: DataFrame, text: str, into: str = "token", details: bool = True) -> DataFrame:
        """One row per token: df's other columns and the fields of the token, or one struct where names clash.

        Chains whose filters look at one token alone give flat rows right from the Arrow pass, for
        CHARS_AT_ONCE characters or one text at a time.
        """
        rest = [c for c in df.columns if c != text]
        if all(f.one_by_one for f in self.token_filters) and not {f.name.lower() for f in TOKEN} & {c.lower() for c in rest} and all(isinstance(df.schema[c].dataType, FLAT) for c in rest):
            return self._flat_rows(df, rest, text, details)
        rows = df.select(*[F.col(f"`{c}`") for c in rest], F.explode(self.tokens(df.sparkSession, F.col(f"`{text}`"), details)).alias(into))
        if {f.name for f in TOKEN} & set(rest):
            return rows
        return rows.select(*[F.col(f"`{c}`") for c in rest], f"{into}.*")


    def token_lists(self, df: DataFrame, text: str, into: str = "tokens") -> DataFrame:
        """df's other columns and the tokens of the text as tokens() has them, made for CHARS_AT_ONCE characters or one text at a time."""
        rest = [c for c in df.columns if c != text]
        shipped = df.sparkSession.sparkContext.broadcast(Tokenizer(self.segmenter, self.character_filters, [f for f in self.token_filters if not f.is_identity()]))

        def rows(batches):
            for b in batches:
                texts, own = b.column(len(rest)), shipped.value
                for at, to in _at_once(texts):
                    some = texts.slice(at, to - at).to_pylist()
                    found = word_arrays(own, some) if all(f.one_by_one for f in own.token_filters) else token_arrays([None if t is None else own.tokenize(t) for t in some])
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, to - at) for k in range(len(rest))), found], [*rest, into])

        token = f"array<struct<{TOKEN_DDL.replace(' ', ':').replace(',:', ', ')}>>"
        schema = StructType([*(df.schema[c] for c in rest), *StructType.fromDDL(f"`{into}` {token}").fields])
        return df.select(*[F.col(f"`{c}`") for c in (*rest, text)]).mapInArrow(rows, schema)

    def nbest_rows(self, df: DataFrame, text: str, n: int, unique: bool = False, cost_threshold: int | None = None, joined: str | None = None) -> DataFrame:
        """One row per candidate: df's other columns, rank from 1, cost and the surfaces, joined by `joined` if it is given. One text's candidates at a time."""
        rest = [c for c in df.columns if c != text]
        shipped = df.sparkSession.sparkContext.broadcast(self)
        by_spans = joined is not None and n > 0 and not (unique or cost_threshold is not None or self.token_filters or self.character_filters) and Ranks.fit(self.segmenter)
        kind = pa.list_(pa.string()) if joined is None else pa.string()

        def of_tokens(text):
            for tokens, cost in shipped.value.tokenize_nbest(text, n, unique, cost_threshold):
                own = [x.surface for x in tokens]
                yield cost, own if joined is None else joined.join(own)

        def rows(batches):
            ranked = Ranks(shipped.value.segmenter, n, joined).of if by_spans else of_tokens
            for b in batches:
                texts = b.column(len(rest))
                for at, to in _at_once(texts):
                    owner, ranks, costs, surfaces = [], [], [], []
                    for i, t in enumerate(texts.slice(at, to - at).to_pylist(), at):
                        for rank, (cost, own) in enumerate(ranked(t) if t is not None else (), 1):
                            owner.append(i)
                            ranks.append(rank)
                            costs.append(cost)
                            surfaces.append(own)
                    own = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in range(len(rest))), pa.array(ranks, pa.int32()), pa.array(costs, pa.int64()), pa.array(surfaces, kind)], [*rest, "rank", "cost", "surfaces"])

        schema = StructType([*(df.schema[c] for c in rest), *StructType.fromDDL(f"rank int, cost bigint, surfaces {'array<string>' if joined is None else 'string'}").fields])
        return df.select(*[F.col(f"`{c}`") for c in (*rest, text)]).mapInArrow(rows, schema)

    def _flat_rows(self, df: DataFrame, rest: list[str], text: str, details: bool) -> DataFrame:
        filters = [f for f in self.token_filters if not f.is_identity()]
        shipped = df.sparkSession.sparkContext.broadcast(Tokenizer(self.segmenter, [f for f in self.character_filters if not f.is_identity()], filters))
        names = [*rest, *(f.name for f in TOKEN)]

        def rows(batches):
            for b in batches:
                texts = b.column(len(rest))
                for at, to in _at_once(texts):
                    offsets, arrays = word_columns(shipped.value, texts.slice(at, to - at).to_pylist(), details)
                    owner = []
                    starts = [o for o in offsets if o is not None]
                    filled = [i for i, o in enumerate(offsets[:-1]) if o is not None]
                    for i, first, last in zip(filled, starts, starts[1:]):
                        owner += [at + i] * (last - first)
                    own = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in range(len(rest))), *arrays], names)

        schema = StructType([*(df.schema[c] for c in rest), *StructType.fromDDL(TOKEN_DDL).fields])
        return df.select(*[F.col(f"`{c}`") for c in (*rest, text)]).mapInArrow(rows, schema)


def surface_counts(df: DataFrame, text: str, chains: dict[str, Tokenizer], into: str = "name") -> DataFrame:
    """How often each chain makes each surface of the texts: its name, df's other columns, surface and n.

    Where the chains' spans are independent (operators.spans), the texts are read once for all chains, and only distinct spans are
    segmented; else every chain segments every text.
    """
    spark, keys = df.sparkSession, [c for c in df.columns if c != text]
    own = [F.col(f"`{c}`") for c in keys]
    one_by_one = all(f.one_by_one for c in chains.values() for f in c.token_filters) and not any(f for c in chains.values() for f in c.character_filters if not f.is_identity())
    alike = len({c.segmenter.dictionary.char_def for c in chains.values()}) == 1
    if one_by_one and alike and all(isinstance(df.schema[c].dataType, FLAT) for c in keys) and all(separable(c.segmenter.lattice) for c in chains.values()):
        rows = _of_spans(_span_counts(df.select(*own, F.col(f"`{text}`")), [c.segmenter.lattice for c in chains.values()]), chains, into)
        return rows.groupBy(into, *own, "surface").agg(F.sum("n").alias("n"))
    parts = [df.select(F.lit(name).alias(into), *own, F.explode(c.surfaces(spark, F.col(f"`{text}`"))).alias("surface")) for name, c in chains.items()]
    return reduce(DataFrame.unionAll, parts).groupBy(into, *own, "surface").agg(F.count("*").alias("n"))


def _span_counts(df: DataFrame, lattices: list[Lattice]) -> DataFrame:
    """Distinct spans of the last column's texts by the other columns, with their numbers; equal spans stand in one partition."""
    spark, keys = df.sparkSession, df.columns[:-1]
    shipped = spark.sparkContext.broadcast(Spans(lattices))

    def rows(batches):
        spans, counts, kinds = shipped.value, defaultdict(Counter), None
        tails = Memo(spans.tails_of).__getitem__

        def found():
            places = [k for k, own in counts.items() for _ in own]
            columns = [pa.array([p[i] for p in places], kind) for i, kind in enumerate(kinds)]
            made = pa.RecordBatch.from_arrays([*columns, pa.array([s for own in counts.values() for s in own], pa.string()), pa.array([n for own in counts.values() for n in own.values()], pa.int64())], [*keys, "span", "n"])
            counts.clear()
            return made

        for b in batches:
            kinds, texts = [f.type for f in b.schema][:-1], b.column(len(keys))
            for at, to in _at_once(texts):
                owners = zip(*(b.column(i).slice(at, to - at).to_pylist() for i in range(len(keys)))) if keys else iter(lambda: (), None)
                for owner, t in zip(owners, texts.slice(at, to - at).to_pylist()):
                    if t:
                        counts[owner].update(spans.of(t, tails))
                # long spans don't repeat
                if sum(map(len, counts.values())) > CACHED or sum(len(s) for own in counts.values() for s in own if len(s) > CACHED_CHARS) > CHARS_AT_ONCE:
                    yield found()
        if counts:
            yield found()

    schema = StructType([*df.schema.fields[:-1], *StructType.fromDDL("span string, n bigint").fields])
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = df.mapInArrow(rows, schema).repartition(parts, "span")
    return counted.groupBy(*[F.col(f"`{c}`") for c in keys], "span").agg(F.sum("n").alias("n"))


def _of_spans(counted: DataFrame, chains: dict[str, Tokenizer], into: str) -> DataFrame:
    """The surfaces of counted spans by every chain, with the spans' numbers.

    A span that holds no word of some lexicons has the same unknown words by all of these, so it is searched once for them.
    """
    keys = counted.columns[:-2]
    shipped = counted.sparkSession.sparkContext.broadcast({n: Tokenizer(c.segmenter, [], [f for f in c.token_filters if not f.is_identity()]) for n, c in chains.items()})

    def rows(batches):
        chains = shipped.value
        options = {n: repr((s.dictionary.unknown_rows, s.dictionary.matrix[0, 0], s.max_grouping_len, s.ladder, s.keep_whitespace)) for n, c in chains.items() if (s := c.segmenter)}
        for b in batches:
            for at, to in _at_once(b.column(len(keys))):
                part = b.slice(at, to - at)
                spans, unknown = part.column(len(keys)).to_pylist(), {}
                for name, own in chains.items():
                    made, final, segmenter = [], own._final(), own.segmenter
                    paths, holds = unknown.setdefault(options[name], [None] * len(spans)), segmenter.lattice.holds_word
                    for i, span in enumerate(spans):
                        if holds(span):
                            made.append(own.tokenize_surfaces(span))
                            continue
                        if paths[i] is None:
                            paths[i] = [(w[0], w[3], w[4]) for w in segmenter.words(span)]
                        made.append([f[0] for w in paths[i] if (f := final[w]) is not None])
                    places = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), len(places)), *(part.column(i).take(places) for i in range(len(keys))), pa.array(list(chain.from_iterable(made)), pa.string()), part.column(len(keys) + 1).take(places)], [into, *keys, "surface", "n"])

    schema = StructType([*StructType.fromDDL(f"`{into}` string").fields, *counted.schema.fields[:-2], *StructType.fromDDL("surface string, n bigint").fields])
    return counted.mapInArrow(rows, schema)


def _at_once(texts: pa.Array):
    """(first, end) of texts of CHARS_AT_ONCE characters together, or of one longer text."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
    at = 0
    while at < len(texts):
        to = max(at + 1, int(lengths.searchsorted((lengths[at - 1] if at else 0) + CHARS_AT_ONCE, side="right")))
        yield at, to
        at = to


def _lists(found: list, inner: pa.Array) -> pa.Array:
    offsets, at = [], 0
    for own in found:
        offsets.append(None if own is None else at)
        at += len(own or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), inner)


def word_arrays(tokenizer: Tokenizer, texts: list[str | None], with_details: bool = True) -> pa.Array:
    """The tokens of each text by a chain whose filters look at one token alone."""
    offsets, arrays = word_columns(tokenizer, texts, with_details)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(TOKEN)))


def word_columns(tokenizer: Tokenizer, texts: list[str | None], with_details: bool = True) -> tuple[list[int | None], list[pa.Array]]:
    """Where each text's tokens begin (None for no text), with the end of all; and the tokens' columns. Each word's details are made once."""
    if tokenizer.segmenter.gaps is not None and not tokenizer.character_filters:
        return tokenizer._pieces().columns(texts, with_details)
    offsets: list[int | None] = []
    surfaces, starts, ends, positions, words, kinds, own = [], [], [], [], [], [], []
    final, places = tokenizer._final(), {}
    details: list[list[str]] = []
    for text in texts:
        offsets.append(None if text is None else len(surfaces))
        if text is None:
            continue
        text, mappings = tokenizer._filtered(text)
        length = size(text) if mappings else 0
        for position, (surface, start, end, word, kind) in enumerate(tokenizer.segmenter.words(text)):
            made = final[surface, word, kind]
            if made is None:
                continue
            if with_details:
                place = places.get((word, kind))
                if place is None:
                    place = places[word, kind] = len(details)
                    details.append(made[1])
                own.append(place)
            for m in reversed(mappings):
                start, end = m.correct(start, length), m.correct(end, length)
            surfaces.append(made[0])
            starts.append(start)
            ends.append(end)
            positions.append(position)
            words.append(word)
            kinds.append(kind)
    n = len(surfaces)
    kind = pa.array(kinds, pa.string())
    detail = pa.array(details, pa.list_(pa.string())).take(pa.array(own, pa.int32())) if with_details else pa.nulls(n, pa.list_(pa.string()))
    arrays = [pa.array(surfaces, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(positions, pa.int32()), pa.repeat(pa.scalar(1, pa.int32()), n), pa.array(words, pa.int64()), kind, pc.equal(kind, UNKNOWN), detail]
    return [*offsets, n], arrays


def token_arrays(found: list[list[Token] | None], with_details: bool = True) -> pa.Array:
    flat = [t for own in found if own for t in own]
    ints = lambda name: pa.array([getattr(t, name) for t in flat], pa.int32())
    kinds = pa.array([t.lex_type for t in flat], pa.string())
    details = pa.array([t.details for t in flat], pa.list_(pa.string())) if with_details else pa.nulls(len(flat), pa.list_(pa.string()))
    arrays = [pa.array([t.surface for t in flat], pa.string()), *map(ints, ("byte_start", "byte_end", "position", "position_length")), pa.array([t.word_id for t in flat], pa.int64()), kinds, pa.array([t.is_unknown for t in flat], pa.bool_()), details]
    return _lists(found, pa.StructArray.from_arrays(arrays, fields=list(TOKEN)))


class TokenizerBuilder:
    """Collects a configuration and builds a Tokenizer."""

    def __init__(self, config: dict | None = None):
        self.config = config or {"segmenter": {}, "character_filters": [], "token_filters": []}
        self.config.setdefault("segmenter", {})

    @classmethod
    def from_file(cls, path: str | Path) -> "TokenizerBuilder":
        return cls(read_config(path))

    def _set(self, name: str, value) -> "TokenizerBuilder":
        self.config["segmenter"][name] = value
        return self

    def set_mode(self, mode) -> "TokenizerBuilder":
        return self._set("mode", mode)

    def set_dictionary(self, uri: str) -> "TokenizerBuilder":
        return self._set("dictionary", uri)

    def set_user_dictionary(self, uri: str) -> "TokenizerBuilder":
        return self._set("user_dictionary", uri)

    def set_keep_whitespace(self, keep: bool) -> "TokenizerBuilder":
        return self._set("keep_whitespace", keep)

    def set_max_grouping_len(self, n: int) -> "TokenizerBuilder":
        return self._set("max_grouping_len", n)

    def set_unknown_word_ladder(self, on: bool) -> "TokenizerBuilder":
        return self._set("unknown_word_ladder", on)

    def set_use_mmap(self, on: bool) -> "TokenizerBuilder":
        """Kept in the configuration; dictionaries are broadcast, so it changes nothing."""
        return self._set("use_mmap", on)

    def append_character_filter(self, kind: str, args: dict | None = None) -> "TokenizerBuilder":
        self.config.setdefault("character_filters", []).append({"kind": kind, "args": args or {}})
        return self

    def append_token_filter(self, kind: str, args: dict | None = None) -> "TokenizerBuilder":
        self.config.setdefault("token_filters", []).append({"kind": kind, "args": args or {}})
        return self

    def build(self) -> Tokenizer:
        return Tokenizer.from_config(self.config)


def read_config(path: str | Path) -> dict:
    """A YAML or JSON mapping."""
    try:
        text = Path(path).read_text("utf-8")
    except OSError as e:
        raise AnalysisError(ErrorKind.IO, str(e)) from e
    try:
        config = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise AnalysisError(ErrorKind.DESERIALIZE, "YAML can't be read here, use JSON") from e
        try:
            config = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise AnalysisError(ErrorKind.DESERIALIZE, str(e)) from e
    if not isinstance(config, dict):
        raise AnalysisError(ErrorKind.DESERIALIZE, f"{path} holds no mapping")
    return config


def parse_filter_flag(flag: str) -> tuple[str, dict]:
    """KIND:{JSON} of the command line."""
    kind, _, text = flag.partition(":")
    try:
        return kind, json.loads(text)
    except ValueError as e:
        raise AnalysisError(ErrorKind.CONTENT, f"{flag!r}: {e}") from e
