"""Mixing sources to target weights, with DataFrame functions only.

A source's weight is its share of the tokens to the power alpha, normalised. alpha in [0, 1] is
bisected until the weights' entropy is the target, or until no source is repeated more than
the limit against the least repeated one; of both, the greater alpha (less change) holds. The
weights are realised as epochs over random blocks of a source: all whole epochs give each
document once, and in the last, broken epoch each block takes, in the order of its own
permutation, documents up to its share of the token budget. Blocks hold about BLOCK documents,
so no source, however hot, meets in one task, and what rounding costs is at most half a
document a block.

Without a budget the least total is taken that gives every document at least once. Mix says
whether each target was met: an entropy below that of the shares can't be, as weights never
grow more unequal than the shares.

Defined results: null texts have no tokens; a null source counts as source ""; blocks and
permutations go by a hash of id and text, so rows without an id and rows that share one are
dealt like others, and rows equal in both are copies of one another, which the broken epoch
takes or leaves together; with one source
or none the weights are the shares; an empty table has an empty plan; other columns, whatever
their names, pass through unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.llm.common import WORD, fresh, looked_up, stored, text_or_empty

BLOCK = 512  # documents of a block, about
BITS_PER_JOB, JOBS = 5, 8  # midpoints are tried 2**5 - 1 at a time: 40 halvings


@dataclass(frozen=True)
class Mix:
    alpha: float
    entropy: float
    budget: float
    total: int
    plan: DataFrame  # source, docs, tokens, weight, target_tokens, epochs
    repetition: float = 1.0  # of the most repeated source against the least repeated one
    met_entropy: bool = True
    met_repetition: bool = True


def n_tokens(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and key of each row: all that plan() and assignments() need, in one pass over the texts."""
    return docs.select("doc_id", "source", n_tokens("text").alias("n_tokens"), _key().alias("key"))


def _key() -> Column:
    """What stands for a row in blocks and permutations; absent values take part as their kind's own."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty("text"))


def by_source(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """source, docs, tokens; partial sums before the shuffle."""
    n = n_tokens("text") if tokens is None else tokens
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"))


def _measured(sources: DataFrame, total: int, alphas: list[float]) -> list[tuple[float, float, float]]:
    """(alpha, entropy of the weights, most against least repetition): sums only reach the driver."""
    p = F.col("tokens") / F.lit(float(total))
    row = sources.where("tokens > 0").agg(
        F.min(p).alias("low"),
        F.max(p).alias("high"),
        *(F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(alphas)),
        *(F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{i}") for i, a in enumerate(alphas)),
    ).first()
    return [(a, math.log(row[f"z{i}"]) - a * row[f"s{i}"] / row[f"z{i}"], (row["low"] / row["high"]) ** (a - 1)) for i, a in enumerate(alphas)]


def bisected(sources: DataFrame, total: int, met) -> float:
    """The least alpha in [0, 1] at which met(entropy, repetition) holds; it must hold from some alpha on."""
    low, high = 0.0, 1.0
    if met(*_measured(sources, total, [0.0])[0][1:]):
        return 0.0
    for _ in range(JOBS):
        steps = 2**BITS_PER_JOB
        tried = _measured(sources, total, [low + (high - low) * k / steps for k in range(1, steps)])
        ok = [a for a, h, r in tried if met(h, r)]
        no = [a for a, h, r in tried if not met(h, r)]
        low, high = max(no, default=low), min(ok, default=high)
    return high


def plan(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget_tokens: float | None = None, tokens: Column | None = None) -> Mix:
    """target_entropy: of the weights, as a share of ln(number of sources); tokens: of a row, where they are counted."""
    sources = stored(by_source(docs, tokens), "sources")
    row = sources.agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") > 0).alias("k")).first()
    total, k = row["t"] or 0, row["k"]
    alpha = 1.0
    if total and k > 1:
        goals = []
        if target_entropy is not None:
            goal = target_entropy * math.log(k)
            goals.append(bisected(sources, total, lambda h, r: h <= goal))
        if max_repetition is not None:
            goals.append(bisected(sources, total, lambda h, r: r <= max_repetition))
        alpha = max(goals, default=1.0)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("weight", power / F.lit(z))
    if budget_tokens is None:
        budget = weighted.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    else:
        budget = float(budget_tokens)
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * budget / F.col("tokens")).otherwise(1.0)
    # what arithmetic leaves of a whole epoch is a whole epoch
    epochs = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    out = weighted.select("source", "docs", "tokens", "weight", (F.col("weight") * budget).alias("target_tokens"), epochs.alias("epochs"))
    if not total:
        return Mix(alpha, 0.0, budget, total, out)
    _, entropy, repetition = _measured(sources, total, [alpha])[0]
    goal = None if target_entropy is None else target_entropy * math.log(k)
    return Mix(alpha, entropy, budget, total, out, repetition, goal is None or abs(entropy - goal) <= 1e-6, max_repetition is None or repetition <= max_repetition * (1 + 1e-9))


def _placed(rows: DataFrame, mix: Mix, seed: int, source: str, key: Column, names: list[str]) -> DataFrame:
    """rows with the columns `names`: epochs of the source and block. source: a column without nulls."""
    epochs, blocks, block = names
    p = mix.plan.select(F.col("source").alias(source), F.col("epochs").alias(epochs), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).alias(blocks), F.col("docs").alias(block))
    out = looked_up(rows, p, [source], key, count=block, how="inner").drop(block)
    return out.withColumn(block, F.pmod(F.xxhash64(F.lit(seed), key), F.col(blocks))).drop(blocks)


def _in_part(n: Column, epochs: Column, order: Window, whole: Window) -> Column:
    """Whether the broken epoch takes a row: its middle lies in the block's share of the budget. order: a range, so
    that equal rows are taken together."""
    share = (epochs - F.floor(epochs)) * F.sum(n).over(whole)
    return F.sum(n).over(order) - n / 2 < share


def _rank(seed: int, epoch: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("bigint"), key)


def mixed(docs: DataFrame, mix: Mix, seed: int = 1, rows: DataFrame | None = None) -> DataFrame:
    """docs, each row as often as the plan gives it; columns and texts unchanged. rows: narrow(docs), where it is
    stored. The permutations are made of these alone: of each block they give the last place that the broken epoch
    takes, by which each document knows its share. Texts are shuffled only if the blocks' places exceed a broadcast."""
    few = narrow(docs) if rows is None else rows
    few = _placed(few.select("n_tokens", "key", F.coalesce("source", F.lit("")).alias("of")), mix, seed, "of", F.col("key"), ["epochs", "blocks", "block"])
    few = few.where(F.col("epochs") > F.floor("epochs")).withColumn("rank", _rank(seed, F.floor("epochs") + 1, F.col("key")))
    whole = Window.partitionBy("of", "block")
    order = whole.orderBy("rank", "key").rangeBetween(Window.unboundedPreceding, 0)
    taken = few.withColumns({"taken": _in_part(F.col("n_tokens"), F.col("epochs"), order, whole), "docs": F.lit(1)})
    last = stored(taken.groupBy("of", "block").agg(F.max(F.when(F.col("taken"), F.struct("rank", "key"))).alias("last"), F.count("*").alias("docs")), "last")

    source, key, times, copy, epochs, blocks, block, size, upto = fresh(docs.columns, "source", "key", "times", "copy", "epochs", "blocks", "block", "size", "upto")
    placed = _placed(docs.withColumns({source: F.coalesce("source", F.lit("")), key: _key()}), mix, seed, source, F.col(key), [epochs, blocks, block])
    placed = looked_up(placed, last.toDF(source, block, upto, size), [source, block], F.col(key), count=size)
    here = F.struct(_rank(seed, F.floor(epochs) + 1, F.col(key)).alias("rank"), F.col(key).alias("key"))
    often = F.floor(epochs).cast("int") + F.coalesce(here <= F.col(upto), F.lit(False)).cast("int")
    return placed.withColumn(times, often).where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def assignments(rows: DataFrame, mix: Mix, seed: int = 1) -> DataFrame:
    """Every place of every row of narrow(): doc_id, source, n_tokens, epoch (from 1), block, position in the block's
    permutation of that epoch. Reading epoch by epoch, blocks in any order, gives the mixed stream."""
    named = rows.select("doc_id", "source", "n_tokens", "key", F.coalesce("source", F.lit("")).alias("of"))
    every = _placed(named, mix, seed, "of", F.col("key"), ["epochs", "blocks", "block"]).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil("epochs").cast("int"))))
    every = every.withColumn("rank", _rank(seed, F.col("epoch"), F.col("key")))
    whole = Window.partitionBy("of", "block", "epoch")
    order = whole.orderBy("rank", "key")
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    placed = every.withColumns({"position": F.row_number().over(order), "taken": _in_part(F.col("n_tokens"), F.col("epochs"), upto, whole)})
    return placed.where((F.col("epoch") <= F.col("epochs")) | F.col("taken")).select("doc_id", "source", "n_tokens", "epoch", "block", "position")
