"""Substring joins by equality: needles are indexed by one of their q-grams, texts give all theirs.

A needle of at least 6 characters has a 6-gram as its key, one of at least 3 a 3-gram, a shorter one itself.
Only texts that share the key are compared with the needle (``contains``), so cost grows with the
texts and with what they share, not with texts times needles. The key is the needle's gram of the least
hash, which spreads needles that share words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (1, 2, 3, 6)
#: Rows of the index up to which it is broadcast; beyond it the join shuffles on grams.
BROADCAST_NEEDLES = 200_000


def grams(text: str | Column, sizes=SIZES) -> Column:
    """The distinct q-grams of a text for all q of ``sizes``, found by one linear pass for each q."""
    found = [F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * q + "))"), 1) for q in sizes]
    return F.array_distinct(F.flatten(F.array(*found)))


def gram_key(needle: str | Column) -> Column:
    """The gram by which a needle is found; null for empty ones."""
    c = F.col(needle) if isinstance(needle, str) else needle
    of = lambda q: F.get(F.array_sort(F.transform(grams(c, (q,)), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), F.lit(0))["g"]
    return F.when(F.length(c) >= 6, of(6)).when(F.length(c) >= 3, of(3)).when(F.length(c) > 0, c)


def sizes_of(needles: DataFrame, needle: str) -> tuple[int, ...]:
    """Which q the needles need; one small aggregate."""
    n = F.length(needle)
    q = F.when(n >= 6, 6).when(n >= 3, 3).when(n > 0, n)
    return tuple(sorted(x for x in needles.agg(F.collect_set(q)).first()[0]))


def join_substrings(rows: DataFrame, text: str, needles: DataFrame, needle: str, sizes: tuple[int, ...] | None = None, hint: bool = True) -> DataFrame:
    """``rows`` joined with ``needles`` where the text contains the needle; column names must not clash.

    Empty and null needles, and null texts, match nothing. With ``hint`` the index is broadcast when its counted
    rows are few.
    """
    sizes = sizes_of(needles, needle) if sizes is None else sizes
    if not sizes:
        return rows.join(needles.limit(0), F.lit(True))
    index = needles.withColumn("_gram", gram_key(needle)).where("_gram is not null")
    if hint and index.limit(BROADCAST_NEEDLES + 1).count() <= BROADCAST_NEEDLES:
        index = F.broadcast(index)
    cut = rows.withColumn("_gram", F.explode(grams(text, sizes)))
    return cut.join(index, "_gram").where(F.contains(text, F.col(needle))).drop("_gram")
