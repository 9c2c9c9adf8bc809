"""Token filters: lists of tokens to lists of tokens, and as Column expressions where Spark can say them.

A filter's `column` takes an array column of token structs and gives the filtered array, so that it stays inside the JVM; it
is None where only `apply` works. Filters that remove tokens don't renumber positions.
"""

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kugiri.functions.charfilters import Mapping
from kugiri.model import AnalysisError, ErrorKind, Schema, Token

FIELDS = ("surface", "byte_start", "byte_end", "position", "position_length", "word_id", "lex_type", "is_unknown", "details")


def with_surface(token: Column, surface: Column) -> Column:
    return F.struct(surface.alias("surface"), *[token[f].alias(f) for f in FIELDS[1:]])


def pad(tag: str) -> str:
    """A tag as the first four details have it."""
    return ",".join((tag.split(",") + ["*"] * 4)[:4])


def tag_of(token: Token) -> str:
    return ",".join(token.details[:4])


class TokenFilter:
    """The base of all filters; one's own filters derive from it and are registered by kind."""

    kind = ""
    column: Callable[[Column], Column] | None = None
    #: Whether a token's fate depends on its surface and word alone, so that it is decided once for all its occurrences.
    one_by_one = False

    def apply(self, tokens: list[Token]) -> list[Token]:
        raise NotImplementedError

    def is_identity(self) -> bool:
        return False


class _Surface(TokenFilter):
    """Changes surfaces one by one."""

    one_by_one = True

    def surface(self, text: str) -> str:
        raise NotImplementedError

    def apply(self, tokens):
        for t in tokens:
            t.surface = self.surface(t.surface)
        return tokens


class _Keep(TokenFilter):
    """Keeps the tokens of which a test is true."""

    one_by_one = True

    def test(self, token: Token) -> bool:
        raise NotImplementedError

    def test_column(self, token: Column) -> Column:
        raise NotImplementedError

    def apply(self, tokens):
        return [t for t in tokens if self.test(t)]

    def column(self, tokens: Column) -> Column:
        return F.filter(tokens, self.test_column)


def _among(value: Column, values) -> Column:
    return value.isin(*sorted(values)) if values else F.lit(False)


class JapaneseTags(_Keep):
    """By the first four details: keep those among the tags, or stop them."""

    def __init__(self, tags, keep: bool):
        self.tags, self.keep = frozenset(map(pad, tags)), keep

    def is_identity(self):
        return not self.tags and not self.keep

    def test(self, token):
        return (tag_of(token) in self.tags) == self.keep if self.tags else not self.keep

    def test_column(self, token):
        hit = _among(F.array_join(F.slice(token["details"], 1, 4), ","), self.tags)
        return hit if self.keep else ~hit


class KoreanTags(_Keep):
    """By the first detail alone."""

    def __init__(self, tags, keep: bool):
        self.tags, self.keep = frozenset(tags), keep

    def is_identity(self):
        return not self.tags and not self.keep

    def test(self, token):
        return ((token.detail(0) or "") in self.tags) == self.keep if self.tags else not self.keep

    def test_column(self, token):
        hit = _among(F.coalesce(F.try_element_at(token["details"], F.lit(1)), F.lit("")), self.tags)
        return hit if self.keep else ~hit


class Words(_Keep):
    def __init__(self, words, keep: bool):
        self.words, self.keep = frozenset(words), keep

    def is_identity(self):
        return not self.words and not self.keep

    def test(self, token):
        return (token.surface in self.words) == self.keep

    def test_column(self, token):
        hit = _among(token["surface"], self.words)
        return hit if self.keep else ~hit


class Length(_Keep):
    """By the number of characters, both ends included."""

    def __init__(self, min: int | None = None, max: int | None = None):
        self.min, self.max = min, max

    def is_identity(self):
        return self.min is None and self.max is None

    def test(self, token):
        n = len(token.surface)
        return (self.min is None or n >= self.min) and (self.max is None or n <= self.max)

    def test_column(self, token):
        n = F.char_length(token["surface"])
        return (F.lit(True) if self.min is None else n >= self.min) & (F.lit(True) if self.max is None else n <= self.max)


class Lowercase(_Surface):
    kind = "lowercase"

    def surface(self, text):
        return text.lower()

    def column(self, tokens):
        return F.transform(tokens, lambda t: with_surface(t, F.lower(t["surface"])))


class Uppercase(_Surface):
    kind = "uppercase"

    def surface(self, text):
        return text.upper()

    def column(self, tokens):
        return F.transform(tokens, lambda t: with_surface(t, F.upper(t["surface"])))


class MapSurface(_Surface):
    kind = "mapping"

    def __init__(self, mapping: dict[str, str]):
        self.filter = Mapping(mapping)

    def is_identity(self):
        return self.filter.is_identity()

    def surface(self, text):
        return self.filter.apply(text)[0]


class ByField(TokenFilter):
    """Known tokens take the value of the first field that has one, field by field."""

    one_by_one = True

    def __init__(self, *fields: str):
        self.fields = fields

    def apply(self, tokens):
        for t in tokens:
            if not t.is_unknown:
                for name in self.fields:
                    value = t.get(name)
                    if value is not None and value != "*":
                        t.surface = value
        return tokens

    def column_for(self, schema: Schema) -> Callable[[Column], Column]:
        places = [i for f in self.fields if (i := schema.detail_index(f)) is not None]

        def one(t: Column) -> Column:
            surface = t["surface"]
            for i in places:
                value = F.try_element_at(t["details"], F.lit(i + 1))
                surface = F.when(~t["is_unknown"] & value.isNotNull() & (value != "*"), value).otherwise(surface)
            return with_surface(t, surface)

        return lambda tokens: F.transform(tokens, one)


class KatakanaStem(_Surface):
    """Takes the final prolonged sound mark from katakana of more than min characters."""

    kind = "japanese_katakana_stem"

    def __init__(self, min: int):
        if not isinstance(min, int) or min <= 0:
            raise AnalysisError(ErrorKind.ARGS, "min must be at least 1")
        self.min = min

    def surface(self, text):
        if text.endswith("ー") and len(text) > self.min and all("゠" <= c <= "ヿ" for c in text):
            return text[:-1]
        return text

    def column(self, tokens):
        def one(t):
            s = t["surface"]
            hit = s.rlike(r"^[゠-ヿ]*ー$") & (F.char_length(s) > self.min)
            return with_surface(t, F.when(hit, F.left(s, F.char_length(s) - 1)).otherwise(s))

        return F.transform(tokens, one)


#: The kana blocks that correspond one to one.
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))


class Kana(_Surface):
    """Between hiragana and katakana; all that has no counterpart stays."""

    kind = "japanese_kana"

    def __init__(self, kind: str):
        if kind not in ("hiragana", "katakana"):
            raise AnalysisError(ErrorKind.ARGS, f"unknown kana {kind!r}")
        self.pair = (KATAKANA, HIRAGANA) if kind == "hiragana" else (HIRAGANA, KATAKANA)
        self.table = str.maketrans(*self.pair)

    def surface(self, text):
        return text.translate(self.table)

    def column(self, tokens):
        return F.transform(tokens, lambda t: with_surface(t, F.translate(t["surface"], *self.pair)))


#: Digits by value, and the zeros of the units; the greater units may precede a unit whose 1 is left out.
DIGITS = {c: str(i) for i, own in enumerate(("0０〇零", "1１一壱", "2２二弐", "3３三参", "4４四", "5５五", "6６六", "7７七", "8８八", "9９九")) for c in own}
SMALL = {"十": 1, "拾": 1, "百": 2, "千": 3}
LARGE = {"万": 4, "億": 8, "兆": 12, "京": 16, "垓": 20}
UNITS = ("百", "千", *LARGE)


def arabic(text: str) -> str:
    """A numeral in Arabic digits, read from its end; what is no numeral stays and starts the units anew."""
    out, base = "", 0
    for i in range(len(text) - 1, -1, -1):
        c = text[i]
        if c in DIGITS:
            out = DIGITS[c] + out
        elif c in SMALL or c in LARGE:
            if c in LARGE:
                base = LARGE[c]
            # what was read so far counts in bytes
            out = "0" * (SMALL.get(c, 0) + base - len(out.encode())) + out
            greater = UNITS if c in "十拾" else UNITS[UNITS.index(c) + 1 :]
            if i == 0 or text[i - 1] in greater:
                out = "1" + out
        else:
            out, base = c + out, 0
    return out


class Number(TokenFilter):
    """Numerals of the tokens with one of the tags, or of all."""

    kind = "japanese_number"
    one_by_one = True

    def __init__(self, tags=None):
        self.tags = None if tags is None else frozenset(map(pad, tags))

    def apply(self, tokens):
        for t in tokens:
            if self.tags is None or tag_of(t) in self.tags:
                t.surface = arabic(t.surface)
        return tokens


class CompoundWord(TokenFilter):
    """Runs of tokens with one of the tags become one token."""

    kind = "japanese_compound_word"

    def __init__(self, tags, new_tag: str | None = None):
        self.tags, self.new = frozenset(map(pad, tags)), new_tag.split(",") if new_tag is not None else ["複合語"]

    def is_identity(self):
        return not self.tags

    def apply(self, tokens):
        out, last = [], None
        for t in tokens:
            hit = tag_of(t) in self.tags
            if hit and last is not None:
                width = len(last.dictionary.schema.custom_fields) if last.dictionary else len(last.details)
                last.surface += t.surface
                last.byte_end = t.byte_end
                last.position_length += t.position_length
                for i, v in enumerate((self.new + ["*"] * width)[:width]):
                    last.set_detail(i, v)
            else:
                out.append(t)
                last = t if hit else None
        return out


#: Marks of kana voicing, combining, spacing and half width.
KANA_MARKS = "゙゚゛゜ﾞﾟ"


class RemoveDiacriticalMark(_Surface):
    kind = "remove_diacritical_mark"

    def __init__(self, japanese: bool = False):
        self.japanese = japanese is True

    def surface(self, text):
        if text.isascii():
            return text
        form = next((f for f in ("NFC", "NFD", "NFKC", "NFKD") if unicodedata.is_normalized(f, text)), "NFD")
        drop = KANA_MARKS if self.japanese else ""
        kept = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ" and c not in drop)
        return unicodedata.normalize(form, kept)


TOKEN_FILTERS: dict[str, Callable[[dict], TokenFilter]] = {}


def register(kind: str, make: Callable[[dict], TokenFilter]) -> None:
    """Makes a filter known by its kind; make gets the arguments of the configuration."""
    TOKEN_FILTERS[kind] = make


def _texts(args: dict, name: str) -> list[str]:
    values = args.get(name)
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise AnalysisError(ErrorKind.DESERIALIZE, f"{name} must be a list of strings")
    return values


def _compound(a: dict) -> CompoundWord:
    if not isinstance(a.get("new_tag", ""), str):
        raise AnalysisError(ErrorKind.DESERIALIZE, "new_tag must be a string")
    return CompoundWord(_texts(a, "tags"), a.get("new_tag"))


register("japanese_base_form", lambda a: ByField("base_form", "orthographic_base_form"))
register("japanese_reading_form", lambda a: ByField("reading"))
register("korean_reading_form", lambda a: ByField("reading"))
register("japanese_compound_word", _compound)
register("japanese_kana", lambda a: Kana(a.get("kind")))
register("japanese_katakana_stem", lambda a: KatakanaStem(a.get("min")))
register("japanese_keep_tags", lambda a: JapaneseTags(_texts(a, "tags"), True))
register("japanese_stop_tags", lambda a: JapaneseTags(_texts(a, "tags"), False))
register("korean_keep_tags", lambda a: KoreanTags(_texts(a, "tags"), True))
register("korean_stop_tags", lambda a: KoreanTags(_texts(a, "tags"), False))
register("japanese_number", lambda a: Number(_texts(a, "tags") if isinstance(a.get("tags"), list) else None))
register("keep_words", lambda a: Words(_texts(a, "words"), True))
register("stop_words", lambda a: Words(_texts(a, "words"), False))
register("length", lambda a: Length(a.get("min"), a.get("max")))
register("lowercase", lambda a: Lowercase())
register("uppercase", lambda a: Uppercase())
register("mapping", lambda a: MapSurface(a.get("mapping") or {}))
register("remove_diacritical_mark", lambda a: RemoveDiacriticalMark(a.get("japanese", False)))


def token_filter(kind: str, args: dict | None = None) -> TokenFilter:
    if kind not in TOKEN_FILTERS:
        raise AnalysisError(ErrorKind.DESERIALIZE, f"unknown token filter {kind!r}")
    return TOKEN_FILTERS[kind](args or {})


__all__ = ["TOKEN_FILTERS", "TokenFilter", "arabic", "register", "token_filter"]
