"""Sharding by a Feistel permutation over global row numbers, with DataFrame functions only.

Rows are numbered 0 to n-1 in the order (id, checksum, size). A Feistel network over pairs (left, right) with
left < a and right < b, a * b just above n, permutes the numbers; results of n and more walk on along their cycle.
The place of a row gives its shard (place mod shards) and its slot there (place div shards), so counts differ by
at most one and slots have no gaps. Anyone who knows n and the key computes the shard and slot of a row number,
and with ``inverse`` the row number of a shard's slot, without the data.

Nulls: a null text has no bytes and the checksum 0; null ids come first. Rows alike in id, checksum and size are
interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

ROUNDS = 6
#: A prime, and per round an addend and a factor below it.
PRIME = 2147483647
ADDENDS = (1013904223, 374761393, 668265263, 1442695041, 951274213, 198491317)
FACTORS = (1103515245, 1664525, 69069, 1812433253, 630360016, 742938285)


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def walk_length(n: int) -> int:
    """Passes that a walk may take. One leaves the range with a chance of (a * b - n) / (a * b), below 1 / sqrt(n): 1 / 4 at
    most, and 1 / 256 from 65,536 rows on. So the odds that a row's walk goes on after the last pass are below 2 ** -128
    for few rows, 2 ** -64 for more (and 2 ** -106 for 10 ** 8), and then an error is raised, never a wrong place."""
    return 64 if n < 1 << 16 else 8


def permuted(x: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """The place of row number ``x`` among ``n`` rows; with ``inverse``, the row number at place ``x``.

    One fold over the rounds of all passes: the pair after a pass that ends outside the range is the next pass's input.
    """
    a, b = sides(n)
    prime, sign = F.lit(PRIME), -1 if inverse else 1
    add, factor = (F.array(*[F.lit(v) for v in vs]) for vs in ([(v + seed * 7919) % PRIME for v in ADDENDS], FACTORS))
    ks = list(reversed(range(ROUNDS))) if inverse else list(range(ROUNDS))
    steps = F.array(*[F.lit(k) for _ in range(walk_length(n)) for k in ks])

    def turn(s: Column, k: Column) -> Column:
        odd = (k % 2) == 1
        y = (F.when(odd, s["l"]).otherwise(s["r"]) + F.element_at(add, k + 1)) % prime
        m = F.shiftright(((y * y) % prime * F.element_at(factor, k + 1) % prime + y) % prime * F.lit(48271) % prime, 3)
        left = F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + sign * m, F.lit(a).cast("long")))
        right = F.when(odd, F.pmod(s["r"] + sign * m, F.lit(b).cast("long"))).otherwise(s["r"])
        return F.when(s["done"], s).otherwise(F.struct(left.alias("l"), right.alias("r"), ((k == ks[-1]) & (right * a + left < n)).alias("done")))

    x = x.cast("long")
    start = F.struct((x % F.lit(a)).cast("long").alias("l"), F.call_function("div", x, F.lit(a).cast("long")).alias("r"), F.lit(False).alias("done"))
    end = lambda s: F.when(s["done"], s["r"] * a + s["l"]).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
    return F.aggregate(steps, start, turn, end)


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    Law ``rows``: the counts of two shards differ by one at most. Only numbers are shuffled, no texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = ranked(rows, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "shard-rows")
    placed = numbered.withColumn("place", permuted(F.col("global_row"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % F.lit(n_shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(n_shards)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "global_row",
    )
