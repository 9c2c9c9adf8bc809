"""A small dictionary of our own for tests."""

from kugiri.model import Metadata, Schema, STRUCTURAL
from kugiri.sources.dictionary import Dictionary

CHAR_DEF = """DEFAULT 0 1 0
SPACE 0 1 0
KANJI 0 0 2
HIRAGANA 1 1 0  # comment
KATAKANA 1 1 2
ALPHA 1 1 0
0x0020 SPACE
0x4E00..0x9FFF KANJI
0x3041..0x3096 HIRAGANA
0x30A1..0x30FC KATAKANA
0x0061..0x007A ALPHA
"""
UNK_DEF = "\n".join(f"{n},0,0,{c},{n},*,*" for n, c in [("DEFAULT", 900), ("SPACE", 10), ("KANJI", 1000), ("HIRAGANA", 800), ("KATAKANA", 700), ("ALPHA", 600)])
RECORDS = [
    ["東京", "1", "1", "100", "名詞", "トウキョウ", "東京"],
    ["京都", "1", "1", "120", "名詞", "キョウト", "京都"],
    ["都", "2", "2", "150", "接尾", "ト", "都"],
    ["東", "1", "1", "300", "名詞", "ヒガシ", "東"],
    ["に", "3", "3", "50", "助詞", "ニ", "に"],
    ["いる", "4", "4", "80", "動詞", "イル", "いる"],
    ["すもも", "1", "1", "90", "名詞", "スモモ", "すもも"],
    ["もも", "1", "1", "95", "名詞", "モモ", "もも"],
    ["も", "3", "3", "40", "助詞", "モ", "も"],
]


def matrix(size: int = 5) -> str:
    return f"{size} {size}\n" + "\n".join(f"{f} {b} {(f * 31 + b * 17) % 97 - 20}" for f in range(size) for b in range(size))


def metadata(**more) -> Metadata:
    return Metadata(**{"name": "small", "default_word_cost": -500, "default_left_context_id": 1, "default_right_context_id": 1, "flexible_csv": True, "dictionary_schema": Schema(STRUCTURAL + ("part_of_speech", "reading", "base_form")), **more})


def dictionary(**more) -> Dictionary:
    return Dictionary.build(metadata(**more), CHAR_DEF, UNK_DEF, matrix(), RECORDS)
