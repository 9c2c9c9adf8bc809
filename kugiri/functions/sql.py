"""The tokenizer in SQL: scalar functions and a table function."""

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kugiri.model import TOKEN_DDL
from kugiri.plans.analyzer import Tokenizer, token_arrays, word_arrays


def register(spark: SparkSession, tokenizer: Tokenizer, prefix: str = "") -> None:
    """Registers PREFIXtokenize(text), PREFIXtokenize_surfaces(text) and the table function PREFIXtokens(text)."""
    shipped = spark.sparkContext.broadcast(tokenizer)
    struct = f"array<struct<{TOKEN_DDL.replace(' ', ':').replace(',:', ', ')}>>"

    def tokenize(texts: pa.Array) -> pa.Array:
        own = shipped.value
        if all(f.one_by_one for f in own.token_filters):
            return word_arrays(own, texts.to_pylist())
        return token_arrays([None if t is None else own.tokenize(t) for t in texts.to_pylist()])

    def surfaces(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else shipped.value.tokenize_surfaces(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    class Tokens:
        def eval(self, text: str):
            for t in shipped.value.tokenize(text) if text is not None else ():
                yield t.row()

    spark.udf.register(f"{prefix}tokenize", F.arrow_udf(tokenize, struct))
    spark.udf.register(f"{prefix}tokenize_surfaces", F.arrow_udf(surfaces, "array<string>"))
    spark.udtf.register(f"{prefix}tokens", F.udtf(Tokens, returnType=TOKEN_DDL))
