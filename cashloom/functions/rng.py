"""Seeded pseudo-random numbers, one after the other on the driver and by their place in Spark.

The generator's state moves by a constant with each number, so number k needs no other one before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import saved

_MASK = 0xFFFFFFFF
#: fixed value: how far the public 32-bit "mulberry" generator's state moves
_STEP = 0x6D2B79F5
#: Permutations of at most so many items come from the driver, where they take less than a Spark job.
SMALL = 20_000


class CounterRng:
    """The public 32-bit "mulberry" generator, from its ``skip``-th number on."""

    def __init__(self, seed: int, skip: int = 0):
        self.state = (seed + skip * _STEP) & _MASK

    def next(self) -> float:
        self.state = (self.state + _STEP) & _MASK
        x = self.state
        x = ((x ^ (x >> 15)) * (x | 1)) & _MASK
        x ^= (x + ((x ^ (x >> 7)) * (x | 61) & _MASK)) & _MASK
        return ((x ^ (x >> 14)) & _MASK) / 2**32

    def integer(self, low: int, high: int) -> int:
        return low + int(self.next() * (high - low + 1))

    def pick(self, items: Sequence[Any]) -> Any:
        return items[self.integer(0, len(items) - 1)]

    def chance(self, p: float) -> bool:
        return self.next() < p

    def shuffle(self, items: Sequence[Any]) -> list[Any]:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.integer(0, i)
            out[i], out[j] = out[j], out[i]
        return out


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two numbers of 32 bits, without leaving bigint."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(0xFFFF), 16)
    return (a * b.bitwiseAND(0xFFFF) + high).bitwiseAND(_MASK)


def draws(seed: Column | int, places: Column) -> Column:
    """The numbers in [0, 1) at ``places`` (an array of bigints from 0 on) of the seed's sequence, as an array."""
    start = F.lit(seed).cast("bigint") if isinstance(seed, int) else seed.cast("bigint")
    state = F.transform(places, lambda k: (start + F.pmod(k + 1, F.lit(1 << 32)) * _STEP).bitwiseAND(_MASK))
    state = F.transform(state, lambda x: _times(x.bitwiseXOR(F.shiftright(x, 15)), x.bitwiseOR(F.lit(1))))
    state = F.transform(state, lambda x: x.bitwiseXOR((x + _times(x.bitwiseXOR(F.shiftright(x, 7)), x.bitwiseOR(F.lit(61)))).bitwiseAND(_MASK)))
    return F.transform(state, lambda x: x.bitwiseXOR(F.shiftright(x, 14)).cast("double") / float(1 << 32))


def draw(seed: Column | int, place: Column) -> Column:
    return F.get(draws(seed, F.array(place.cast("bigint"))), F.lit(0))


def within(u: Column, low: int, high: int | Column) -> Column:
    """The integer in [low, high] that the number ``u`` picks."""
    return F.lit(low) + F.floor(u * (high - F.lit(low) + 1))


def permutation(spark: SparkSession, n: int, seed: int, first: int = 0, small: int = SMALL) -> DataFrame:
    """pos, item: the order in which ``n`` items 0, 1, ... leave a shuffle that starts at number ``first``.

    The shuffle swaps place i, from the last on down, with a place j(i) up to i. What stands at a place k
    when its turn comes was put there by the next turn after it that drew k, if any did: following these
    links, of which no two lead to one turn, says what each turn moves. Links are doubled until all have
    ended, so a permutation of any size takes a few joins.
    """
    if n <= small:
        return spark.createDataFrame(list(enumerate(CounterRng(seed, first).shuffle(range(n)))), "pos bigint, item bigint")
    place = F.lit(first + n - 1) - F.col("id")
    turn = F.when(F.col("id") > 0, F.floor(draw(seed, F.greatest(F.lit(0), place)) * (F.col("id") + 1))).otherwise(F.lit(0))
    turns = saved(spark.range(n).select(F.col("id").alias("i"), turn.cast("bigint").alias("j")), "turns")
    links = turns.where("i > j").groupBy(F.col("j").alias("k")).agg(F.min("i").alias("to"))
    ends = saved(spark.range(n).select(F.col("id").alias("k")).join(links, "k", "left").select("k", F.coalesce("to", "k").alias("to")), "links")
    while True:
        further = ends.select(F.col("k").alias("to"), F.col("to").alias("_end"))
        step = saved(ends.join(further, "to").select("k", F.col("_end").alias("to"), (F.col("to") != F.col("_end")).alias("moved")), "links")
        ends = step.select("k", "to")
        if step.where("moved").isEmpty():
            break
    later = turns.withColumn("k", F.lead("i").over(W.partitionBy("j").orderBy("i")))
    return later.join(ends, "k", "left").select(F.col("i").alias("pos"), F.coalesce("to", "j").alias("item"))
