"""Output formats: mecab, wakati and json, for token lists and as Column expressions."""

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from kugiri.model import Schema, Token


def mecab(tokens: list[Token]) -> str:
    return "".join(f"{t.surface}\t{','.join(t.details)}\n" for t in tokens) + "EOS\n"


def wakati(tokens: list[Token]) -> str:
    """Nothing at all for no tokens."""
    return " ".join(t.surface for t in tokens) + "\n" if tokens else ""


def to_json(tokens: list[Token]) -> str:
    return json.dumps([t.as_value() for t in tokens], ensure_ascii=False, indent=2) + "\n"


FORMATS = {"mecab": mecab, "wakati": wakati, "json": to_json}


def nbest_header(rank: int, cost: int) -> str:
    return f"NBEST {rank} (cost={cost})\n"


def mecab_column(tokens: Column) -> Column:
    """NULL tokens give NULL."""
    lines = F.array_join(F.transform(tokens, lambda t: F.concat(t["surface"], F.lit("\t"), F.array_join(t["details"], ","), F.lit("\n"))), "")
    return F.concat(lines, F.lit("EOS\n"))


def wakati_column(tokens: Column) -> Column:
    text = F.array_join(F.transform(tokens, lambda t: t["surface"]), " ")
    return F.when(F.size(tokens) > 0, F.concat(text, F.lit("\n"))).when(tokens.isNotNull(), "")


def json_column(tokens: Column, schema: Schema) -> Column:
    """One compact array; details that are numbers become numbers, as Token.as_value has them."""
    integer = r"^[+-]?[0-9]+\z"
    # no blanks, no suffix of a type, no word for infinity or none
    real = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"

    def coerced(value: Column, quoted: Column) -> Column:
        whole, broken = value.try_cast("long"), value.try_cast("double")
        finite = F.abs(broken) < F.lit(float("inf"))
        return F.when(value.rlike(integer) & whole.isNotNull(), whole.cast("string")).when(value.rlike(real) & finite, F.to_json(F.struct(broken.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(broken.alias("v")))) - 6)).otherwise(quoted)

    def one(t: Column) -> Column:
        def pair(i: int, name: str) -> Column:
            value = F.try_element_at(t["details"], F.lit(i + 1))
            quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
            return F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), coerced(value, quoted))

        head = F.regexp_extract(F.to_json(F.struct(t["surface"].alias("surface"), t["byte_start"].alias("byte_start"), t["byte_end"].alias("byte_end"), t["word_id"].alias("word_id"))), r"(?s)^(.*)\}$", 1)
        return F.concat_ws(",", head, *[pair(i, n) for i, n in enumerate(schema.custom_fields)])

    return F.concat(F.lit("["), F.array_join(F.transform(tokens, lambda t: F.concat(one(t), F.lit("}"))), ","), F.lit("]"))
