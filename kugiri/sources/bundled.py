"""Dictionaries that come with the library."""

from functools import lru_cache

from kugiri.model import AnalysisError, ErrorKind, Metadata, PRESETS
from kugiri.sources.dictionary import Dictionary

_LATIN = [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)]
_SPACES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x3000, 0x3000)]

#: Category, (invoke, group, length), code points; a word is the longest run of one category.
_SCRIPTS = {
    "DEFAULT": ((0, 1, 0), []),
    "SPACE": ((0, 1, 0), _SPACES),
    "NUMERIC": ((1, 1, 0), [(0x30, 0x39), (0xFF10, 0xFF19)]),
    "ALPHA": ((1, 1, 0), _LATIN),
    "HIRAGANA": ((1, 1, 0), [(0x3041, 0x309F)]),
    "KATAKANA": ((1, 1, 0), [(0x30A1, 0x30FF)]),
    "KANJI": ((0, 1, 0), [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)]),
    "HANGUL": ((1, 1, 0), [(0xAC00, 0xD7A3)]),
}


def char_def() -> str:
    """char.def text of _SCRIPTS."""
    lines = [f"{name} {' '.join(map(str, flags))}" for name, (flags, _) in _SCRIPTS.items()]
    lines += [f"0x{low:04X}..0x{high:04X} {name}" for name, (_, ranges) in _SCRIPTS.items() for low, high in ranges]
    return "\n".join(lines)


def _scripts() -> Dictionary:
    """No words: texts fall into runs of one script."""
    meta = Metadata("scripts", default_word_cost=0, default_left_context_id=0, default_right_context_id=0, flexible_csv=True)
    unk = "\n".join(f"{name},0,0,0,{name},*,*,*,*,*,*,*,*" for name in _SCRIPTS)
    return Dictionary.build(meta, char_def(), unk, "1 1\n0 0 0\n", [])


#: Function words with parts of speech for the small European lexicon, one class a line.
_CLASSES = {
    1: ("DET", -400, "the a an each said one der die das eine jede diese le la les un une ce chaque el los cada este"),
    2: ("ADP", -300, "of in to with by on at from through along von mit im durch neben de du dans par sur en con por"),
    3: ("CONJ", -250, "and or until because while und oder bis weil et ou parce que y o"),
    4: ("PRON", -200, "it which that what sie es qui il lo"),
}


def _function_words() -> Dictionary:
    """Function words with costs and connection costs between their classes; everything else is unknown."""
    meta = Metadata("function-words", default_word_cost=-500, default_left_context_id=5, default_right_context_id=5, flexible_csv=True)
    records, seen = [], set()
    for kind, (name, cost, words) in _CLASSES.items():
        for i, w in enumerate(words.split()):
            if w not in seen:
                seen.add(w)
                records.append([w, str(kind), str(kind), str(cost - 7 * i), name, *["*"] * 5, w, "*", "*"])
    unk = "\n".join(f"{name},5,5,{300 + 40 * i},{name},*,*,*,*,*,*,*,*" for i, name in enumerate(_SCRIPTS))
    size = len(_CLASSES) + 2
    cells = [f"{f} {b} {(f * 37 + b * 53) % 211 - 60}" for f in range(size) for b in range(size)]
    return Dictionary.build(meta, char_def(), unk, f"{size} {size}\n" + "\n".join(cells), records)


BUNDLED = {"scripts": _scripts, "function-words": _function_words}


@lru_cache(None)
def bundled(name: str) -> Dictionary:
    if name not in BUNDLED:
        raise AnalysisError(ErrorKind.DICTIONARY, f"no bundled dictionary {name}; there are {', '.join(BUNDLED)}")
    return BUNDLED[name]()


__all__ = ["BUNDLED", "PRESETS", "bundled", "char_def"]
