"""Character filters: text to text, with the mapping that takes byte offsets back."""

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

import regex

from kugiri.model import AnalysisError, ErrorKind

CLUSTER = regex.compile(r"\X")
#: The iteration marks.
KANJI_MARK, KANA_MARKS = "々", "ゝゞヽヾ"


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class OffsetMapping:
    """Replacements that changed a length: (original start, end, filtered start, end) in bytes, in order."""

    def __init__(self, spans: list[tuple[int, int, int, int]] | None = None):
        self.spans, self.ends, self.shifts = [], [], []
        for s in spans or ():
            self.add(*s)

    def add(self, start: int, end: int, filtered_start: int, filtered_end: int) -> None:
        shift = (end - start) - (filtered_end - filtered_start)
        self.spans.append((start, end, filtered_start, filtered_end))
        self.ends.append(filtered_end)
        self.shifts.append(shift + (self.shifts[-1] if self.shifts else 0))

    def __bool__(self) -> bool:
        return bool(self.spans)

    def __add__(self, other: "OffsetMapping") -> "OffsetMapping":
        return OffsetMapping(self.spans + other.spans)

    def correct(self, offset: int, length: int) -> int:
        """The original offset of a filtered one; length is the filtered text's."""
        if not self.spans:
            return offset
        at = min(offset, length)
        i = bisect_left(self.ends, at)
        if i == len(self.spans):
            return at + self.shifts[-1] + max(0, offset - length)
        start, end, low, high = self.spans[i]
        if at < low:
            return at + (self.shifts[i - 1] if i else 0)
        if high == low or end == start:
            return start
        # halves go up
        return start + math.floor((at - low) / (high - low) * (end - start) + 0.5)


class CharacterFilter:
    """The base of all filters; one's own filters derive from it and are registered by kind."""

    kind = ""

    def pieces(self, text: str):
        """(start, end, replacement) of every replaced part, in order."""
        raise NotImplementedError

    def is_identity(self) -> bool:
        return False

    def apply(self, text: str) -> tuple[str, OffsetMapping]:
        mapping, out, last = OffsetMapping(), [], 0
        before = after = 0
        for start, end, new in self.pieces(text):
            gap = text[last:start]
            out += (gap, new)
            n = size(gap)
            before, after = before + n, after + n
            old, fresh = size(text[start:end]), size(new)
            if old != fresh:
                mapping.add(before, before + old, after, after + fresh)
            before, after, last = before + old, after + fresh, end
        return "".join((*out, text[last:])), mapping


class UnicodeNormalize(CharacterFilter):
    kind = "unicode_normalize"

    def __init__(self, kind: str = "nfkc"):
        if str(kind).lower() not in ("nfc", "nfd", "nfkc", "nfkd"):
            raise AnalysisError(ErrorKind.DESERIALIZE, f"unknown normalization {kind!r}")
        self.form = kind.upper()

    def pieces(self, text: str):
        if unicodedata.is_normalized(self.form, text):
            return
        for m in CLUSTER.finditer(text):
            c = m[0]
            if not c.isascii() and not unicodedata.is_normalized(self.form, c):
                yield m.start(), m.end(), unicodedata.normalize(self.form, c)


class Mapping(CharacterFilter):
    kind = "mapping"

    def __init__(self, mapping: dict[str, str]):
        self.mapping = {k: v for k, v in mapping.items() if isinstance(v, str)}
        if "" in self.mapping:
            raise AnalysisError(ErrorKind.ARGS, "an empty key maps nothing")
        keys = sorted(self.mapping, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, keys))) if keys else None

    def is_identity(self) -> bool:
        return self.pattern is None

    def pieces(self, text: str):
        if self.pattern:
            for m in self.pattern.finditer(text):
                yield m.start(), m.end(), self.mapping[m[0]]


class Regex(CharacterFilter):
    """Every match becomes the literal replacement. Look-around and back-references are refused, as the dialect has none."""

    kind = "regex"

    def __init__(self, pattern: str, replacement: str):
        if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!]|P=|\()|\\[1-9])", pattern):
            raise AnalysisError(ErrorKind.ARGS, f"{pattern!r} looks around or refers back")
        try:
            self.pattern = re.compile(pattern)
        except re.error as e:
            raise AnalysisError(ErrorKind.ARGS, f"{pattern!r}: {e}") from e
        self.replacement = replacement

    def pieces(self, text: str):
        last = -1
        for m in self.pattern.finditer(text):
            if m.end() > m.start() or m.start() != last:
                yield m.start(), m.end(), self.replacement
            last = m.end()


def voiced(c: str) -> str:
    """A kana of the か to ほ rows with its voicing mark."""
    v = unicodedata.normalize("NFC", c + "゙")
    return v if len(v) == 1 and ("か" <= c <= "ほ" or "カ" <= c <= "ホ") else c


def unvoiced(c: str) -> str:
    d = unicodedata.normalize("NFD", c)
    return d[0] if ("か" <= c <= "ぽ" or "カ" <= c <= "ポ") and d[1:] == "゙" else c


class IterationMark(CharacterFilter):
    """Repeats what an iteration mark stands for, each kind only if asked for."""

    kind = "japanese_iteration_mark"

    def __init__(self, normalize_kanji: bool = False, normalize_kana: bool = False):
        marks = KANJI_MARK * bool(normalize_kanji) + KANA_MARKS * bool(normalize_kana)
        self.runs = re.compile(f"[{marks}]+") if marks else None

    def is_identity(self) -> bool:
        return self.runs is None

    def pieces(self, text: str):
        if self.runs is None:
            return
        for m in self.runs.finditer(text):
            back = min(m.start(), m.end() - m.start())
            new = []
            for i in range(m.start(), m.end()):
                mark, source = text[i], text[i - back]
                if mark == KANJI_MARK:
                    new.append(source)
                else:
                    same = "ゝゞ" if mark in "ゝゞ" else "ヽヾ"
                    low, high = ("ぁ", "ゖ") if same == "ゝゞ" else ("ァ", "ヶ")
                    new.append((voiced if mark == same[1] else unvoiced)(source) if low <= source <= high else source)
            yield m.start(), m.end(), "".join(new)


CHARACTER_FILTERS: dict[str, Callable[[dict], CharacterFilter]] = {}


def register(kind: str, make: Callable[[dict], CharacterFilter]) -> None:
    """Makes a filter known by its kind; make gets the arguments of the configuration."""
    CHARACTER_FILTERS[kind] = make


def _needed(args: dict, name: str):
    if name not in args:
        raise AnalysisError(ErrorKind.DESERIALIZE, f"argument {name} is missing")
    return args[name]


register("unicode_normalize", lambda a: UnicodeNormalize(_needed(a, "kind")))
register("mapping", lambda a: Mapping(_needed(a, "mapping")))
register("regex", lambda a: Regex(_needed(a, "pattern"), _needed(a, "replacement")))
register("japanese_iteration_mark", lambda a: IterationMark(a.get("normalize_kanji") is True, a.get("normalize_kana") is True))


def character_filter(kind: str, args: dict | None = None) -> CharacterFilter:
    if kind not in CHARACTER_FILTERS:
        raise AnalysisError(ErrorKind.DESERIALIZE, f"unknown character filter {kind!r}")
    return CHARACTER_FILTERS[kind](args or {})


def correct_offsets(tokens, mappings: list[OffsetMapping], length: int) -> None:
    """Takes the tokens' offsets back through the mappings, the last first. length is the last text's, for every mapping."""
    for t in tokens:
        for m in reversed(mappings):
            t.byte_start, t.byte_end = m.correct(t.byte_start, length), m.correct(t.byte_end, length)
