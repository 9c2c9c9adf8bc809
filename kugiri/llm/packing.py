"""Fixed-capacity containers filled with texts by minimum bin slack over a histogram of lengths.

Only the histogram of piece lengths (at most `capacity` rows) comes to the driver. There the largest remaining length opens
a container, and a bitset subset-sum over the remaining lengths with their counts picks the multiset that fills the rest
closest to capacity; its members are found back through the stored bitsets. The pick is repeated as long as the counts last,
so a plan has few runs however many texts there are. The pieces take their places in the plan by their rank within
their length, from a range-partitioned sort by length and id, so that a length may hold any share of all pieces.
"""

import base64
import os
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kugiri.plans.rank import with_rank
from kugiri.plans.shared import stable

#: Fixed value: the pattern that splits text before the merges of the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Default vocabulary; the file must be at the same place on all executors.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(4)
def encoding(vocabulary: str):
    """The tokenizer of a rank file, read once in a worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Id and n_tokens of every text in tokens of a public byte-pair vocabulary; NULL text has 0."""

    def count(batches):
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [id, "n_tokens"])

    return documents.select(id, text).mapInArrow(count, f"`{id}` {documents.schema[id].dataType.simpleString()}, n_tokens long")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is the largest that is at most room."""
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left = min(counts[length], room // length)
        k = 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            out[length] = out.get(length, 0) + k
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Runs of equal containers: first container, how many, and the pieces of each by length."""
    counts, runs, first = {n: c for n, c in counts.items() if c}, [], 0
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        picked = fill(counts, capacity - largest)
        counts[largest] += 1
        picked[largest] = picked.get(largest, 0) + 1
        times = min(counts[n] // k for n, k in picked.items())
        runs.append((first, times, picked))
        first += times
        for n, k in picked.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return runs


def pack(sizes: DataFrame, capacity: int = 2048, id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """One row per piece: id, piece (from 0), first token, n_tokens, container.

    A text over the capacity is cut into full pieces and a rest; any other text is one piece. A text without tokens is a piece
    of length 0 in container 0. A NULL size counts as 0. Repeated ids are texts of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    sizes = sizes.select(F.col(id), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    pieces = stable(sizes.select(id, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece")).select(id, "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("length")))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    zeros = histogram.pop(0, 0)
    table: dict[int, list] = {}
    taken: dict[int, int] = {}
    for first, times, picked in plan(histogram, capacity):
        for n, k in picked.items():
            table.setdefault(n, []).append((taken.get(n, 0), first, k))
            taken[n] = taken.get(n, 0) + k * times
    shipped = spark.sparkContext.broadcast({n: tuple(np.array(x, np.int64) for x in zip(*runs)) for n, runs in table.items()})
    # a length's pieces follow each other in the order, so their ranks are places less those of shorter pieces
    lengths = sorted(table)
    before = dict(zip(lengths, accumulate([zeros, *(taken[n] for n in lengths)])))

    def placed(lengths: pa.Array, places: pa.Array) -> pa.Array:
        n, at = lengths.to_numpy(zero_copy_only=False), places.to_numpy(zero_copy_only=False)
        out = np.zeros(len(n), np.int64)
        for length in np.unique(n[n > 0]).tolist():
            since, first, per = shipped.value[length]
            own = n == length
            rank = at[own] - before[length]
            run = np.searchsorted(since, rank, side="right") - 1
            out[own] = first[run] + (rank - since[run]) // per[run]
        return pa.array(out)

    ranked = with_rank(pieces, ["length", id, "piece"], "__place")
    return ranked.select(id, "piece", "first_token", F.col("length").alias("n_tokens"), F.arrow_udf(placed, "bigint")("length", "__place").alias("container"))
