"""Data model: errors, schemas, metadata, modes, tokens."""

import json
from dataclasses import dataclass, field
from enum import StrEnum
from pathlib import Path

FORMAT_VERSION = 2


class ErrorKind(StrEnum):
    ARGS = "Args"
    CONTENT = "Content"
    DECODE = "Decode"
    DESERIALIZE = "Deserialize"
    IO = "Io"
    PARSE = "Parse"
    SERIALIZE = "Serialize"
    COMPRESS = "Compress"
    NOT_FOUND = "NotFound"
    BUILD = "Build"
    DICTIONARY = "Dictionary"
    MODE = "Mode"


class AnalysisError(Exception):
    """The one error of the library; kind says what is wrong."""

    def __init__(self, kind: ErrorKind, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message

    def __reduce__(self):
        return AnalysisError, (self.kind, self.message)


#: The structural fields every dictionary row starts with.
STRUCTURAL = ("surface", "left_context_id", "right_context_id", "cost")
#: The default schema's further fields.
DEFAULT_CUSTOM = ("part_of_speech", "part_of_speech_subcategory_1", "part_of_speech_subcategory_2", "part_of_speech_subcategory_3", "conjugation_form", "conjugation_type", "base_form", "reading", "pronunciation")


@dataclass(frozen=True)
class Schema:
    """Ordered field names; the first four are structural by position."""

    fields: tuple[str, ...] = STRUCTURAL + DEFAULT_CUSTOM

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))

    @property
    def custom_fields(self) -> tuple[str, ...]:
        return self.fields[len(STRUCTURAL) :]

    def index(self, name: str) -> int | None:
        return self.fields.index(name) if name in self.fields else None

    def detail_index(self, name: str) -> int | None:
        """Where a token's details hold the field; None for unknown and structural fields."""
        i = self.index(name)
        return None if i is None or i < len(STRUCTURAL) else i - len(STRUCTURAL)

    def validate(self, row: list[str]) -> None:
        if len(row) < len(self.fields):
            raise AnalysisError(ErrorKind.CONTENT, f"{len(row)} fields where the schema has {len(self.fields)}")
        for name, value in zip(self.fields, row):
            if not value.strip():
                raise AnalysisError(ErrorKind.CONTENT, f"field {name} is blank")

    def ddl(self) -> str:
        return ", ".join(f"`{f}` string" for f in self.fields)


@dataclass
class Metadata:
    """How a dictionary is read and built."""

    name: str = "default"
    encoding: str = "UTF-8"
    default_word_cost: int = -10000
    default_left_context_id: int = 1288
    default_right_context_id: int = 1288
    default_field_value: str = "*"
    flexible_csv: bool = False
    skip_invalid_cost_or_id: bool = False
    normalize_details: bool = False
    dictionary_schema: Schema = field(default_factory=Schema)
    user_dictionary_schema: Schema = field(default_factory=lambda: Schema(("surface", "part_of_speech", "reading")))
    connection_id_mapping: dict | None = None
    format_version: int = FORMAT_VERSION

    def to_json(self) -> str:
        plain = {k: v for k, v in self.__dict__.items() if v is not None}
        for k in ("dictionary_schema", "user_dictionary_schema"):
            plain[k] = {"fields": list(plain[k].fields)}
        return json.dumps(plain, ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> "Metadata":
        try:
            raw = json.loads(text)
            known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
            for k in ("dictionary_schema", "user_dictionary_schema"):
                if k in known:
                    known[k] = Schema(tuple(known[k]["fields"]))
            return cls(**known)
        except (ValueError, TypeError, KeyError) as e:
            raise AnalysisError(ErrorKind.DESERIALIZE, f"metadata: {e}") from e

    @classmethod
    def load(cls, path: str | Path) -> "Metadata":
        try:
            return cls.from_json(Path(path).read_text("utf-8"))
        except OSError as e:
            raise AnalysisError(ErrorKind.IO, str(e)) from e


def _preset(name, custom, user, cost=-10000, *, normalize=False, skip=False, flexible=False) -> Metadata:
    return Metadata(name, "UTF-8", cost, 0, 0, "*", flexible, skip, normalize, Schema(STRUCTURAL + custom), Schema(user))


#: The fields of the common dictionary families.
_JA_LONG = ("part_of_speech", "part_of_speech_subcategory_1", "part_of_speech_subcategory_2", "part_of_speech_subcategory_3", "conjugation_type", "conjugation_form", "reading", "lexeme", "orthographic_surface_form", "phonological_surface_form", "orthographic_base_form", "phonological_base_form", "word_type", "initial_mutation_type", "initial_mutation_form", "final_mutation_type", "final_mutation_form")
_KO = ("part_of_speech_tag", "meaning", "presence_absence", "reading", "type", "first_part_of_speech", "last_part_of_speech", "expression")
_ZH = ("part_of_speech", "part_of_speech_subcategory_1", "part_of_speech_subcategory_2", "part_of_speech_subcategory_3", "pinyin", "traditional", "simplified", "definition")
PRESETS = {
    "ja": lambda: _preset("ja", DEFAULT_CUSTOM, ("surface", "part_of_speech", "reading"), normalize=True, flexible=True),
    "ja-long": lambda: _preset("ja-long", _JA_LONG, ("surface", "part_of_speech", "reading")),
    "ko": lambda: _preset("ko", _KO, ("surface", "part_of_speech_tag", "reading")),
    "zh": lambda: _preset("zh", _ZH, ("surface", "part_of_speech", "pinyin"), skip=True, flexible=True),
    "zh-frequency": lambda: _preset("zh-frequency", _ZH + ("char_count", "freq_band"), ("surface", "part_of_speech", "pinyin"), 1625, skip=True, flexible=True),
}


@dataclass(frozen=True)
class Penalty:
    """What a long word costs in decompose mode."""

    kanji_penalty_length_threshold: int = 2
    kanji_penalty_length_penalty: int = 3000
    other_penalty_length_threshold: int = 7
    other_penalty_length_penalty: int = 1700

    def of(self, length: int, kanji_only: bool) -> int:
        if length <= self.kanji_penalty_length_threshold:
            return 0
        if kanji_only:
            return (length - self.kanji_penalty_length_threshold) * self.kanji_penalty_length_penalty
        if length > self.other_penalty_length_threshold:
            return (length - self.other_penalty_length_threshold) * self.other_penalty_length_penalty
        return 0


@dataclass(frozen=True)
class Mode:
    """normal, or decompose with its penalty."""

    penalty: Penalty | None = None

    @classmethod
    def parse(cls, value: "str | dict | Mode | None") -> "Mode":
        if isinstance(value, Mode):
            return value
        if value in (None, "normal", "Normal"):
            return cls()
        if value == "decompose":
            return cls(Penalty())
        if isinstance(value, dict) and len(value) == 1 and next(iter(value)).lower() == "decompose":
            try:
                return cls(Penalty(**(next(iter(value.values())) or {})))
            except TypeError as e:
                raise AnalysisError(ErrorKind.MODE, str(e)) from e
        raise AnalysisError(ErrorKind.MODE, f"unknown mode {value!r}")

    def __str__(self) -> str:
        return "decompose" if self.penalty else "normal"


#: Word id of a token that has none; fits no INT.
NO_WORD = 4294967295
SYSTEM, USER, UNKNOWN = "System", "User", "Unknown"

TOKEN_DDL = "surface string, byte_start int, byte_end int, position int, position_length int, word_id long, lex_type string, is_unknown boolean, details array<string>"


class Token:
    """A token; its details are read from the dictionary when first asked for."""

    __slots__ = ("surface", "byte_start", "byte_end", "position", "position_length", "word_id", "lex_type", "dictionary", "_details")

    def __init__(self, surface, byte_start, byte_end, position, word_id=NO_WORD, lex_type=UNKNOWN, dictionary=None, details=None, position_length=1):
        self.surface, self.byte_start, self.byte_end = surface, byte_start, byte_end
        self.position, self.position_length = position, position_length
        self.word_id, self.lex_type, self.dictionary, self._details = word_id, lex_type, dictionary, details

    @property
    def is_unknown(self) -> bool:
        return self.lex_type == UNKNOWN

    @property
    def details(self) -> list[str]:
        """Details in the schema's order, short ones padded with the missing value."""
        if self._details is None:
            own = list(self.dictionary.word_details(self.word_id, self.lex_type)) if self.dictionary else []
            width = len(self.dictionary.schema.custom_fields) if self.dictionary else 0
            self._details = own + ["*"] * (width - len(own))
        return self._details

    def detail(self, i: int) -> str | None:
        return self.details[i] if 0 <= i < len(self.details) else None

    def set_detail(self, i: int, value: str) -> None:
        if 0 <= i < len(self.details):
            self.details[i] = value

    def get(self, name: str) -> str | None:
        """A field by name: the surface, or a detail; None for ids, cost and unknown names."""
        if self.dictionary is None:
            return None
        i = self.dictionary.schema.index(name)
        if i is None:
            return None
        return self.surface if i == 0 else None if i < len(STRUCTURAL) else self.detail(i - len(STRUCTURAL))

    def as_value(self) -> dict:
        """The token as JSON has it; details that are numbers become numbers."""
        out = {"surface": self.surface, "byte_start": self.byte_start, "byte_end": self.byte_end, "word_id": self.word_id}
        for name, value in zip(self.dictionary.schema.custom_fields if self.dictionary else (), self.details):
            out[name] = number_or_text(value)
        return out

    def row(self) -> tuple:
        return self.surface, self.byte_start, self.byte_end, self.position, self.position_length, self.word_id, self.lex_type, self.is_unknown, list(self.details)


def number_or_text(value: str) -> int | float | str:
    """An integer that fits 64 bits, else a finite number, else the text."""
    if value.isascii() and value == value.strip() and "_" not in value:
        try:
            n = int(value)
            if -(1 << 63) <= n < 1 << 63:
                return n
        except ValueError:
            pass
        try:
            x = float(value)
            if x == x and abs(x) != float("inf"):
                return x
        except ValueError:
            pass
    return value
