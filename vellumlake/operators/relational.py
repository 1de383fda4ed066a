"""Joins and multisets with the rules for ties and absences that the measures need."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by a total order. Ties of the order are broken by nothing else, so it has to
    name an ordinal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def pick_by(df: DataFrame, keys: list[str], order: Column, values: list[str], *, last: bool = False) -> DataFrame:
    """The same by a partial aggregate instead of a sort: the values at the least (or greatest) order."""
    row = F.struct(order.alias("_o"), *values)
    return df.groupBy(*keys).agg((F.max if last else F.min)(row).alias("_r")).select(*keys, *(F.col(f"_r.{v}").alias(v) for v in values))


def paired(before: DataFrame, after: DataFrame, keys: list[str], ordinal: str, values: list[str]) -> DataFrame:
    """before joined with after by key; of several rows after, the last by ordinal counts."""
    return before.join(pick_by(after, keys, F.col(ordinal), values, last=True), keys)


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str, values: list[str]) -> DataFrame:
    """left joined with the first row by ordinal for its key; null where there is none."""
    return left.join(pick_by(right, keys, F.col(ordinal), values), keys, "left")


def evidence_status(required: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: ok, missing, duplicate or unexpected."""
    r = required.groupBy(*keys).agg(F.count("*").alias("_r"))
    e = evidence.groupBy(*keys).agg(F.count("*").alias("_e"))
    status = F.when(F.col("_r").isNull(), "unexpected").when(F.col("_e").isNull(), "missing").when(F.col("_e") > 1, "duplicate").otherwise("ok")
    return r.join(e, keys, "full_outer").select(*keys, status.alias("status"))


def multiset(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """key, token, n of an array column's elements."""
    return df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def multiset_missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """key, token, expected, found (at most expected), missing."""
    t = target.withColumnRenamed("n", "_t")
    found = F.least(F.col("n"), F.coalesce("_t", F.lit(0)))
    return source.join(t, [*keys, "token"], "left").select(*keys, "token", F.col("n").alias("expected"), found.alias("found"), (F.col("n") - found).alias("missing"))


def symmetric_difference(a: DataFrame, b: DataFrame, side: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Rows of one set that the other lacks, with the side they are on."""
    return a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit(side[0])).unionByName(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit(side[1])))


def first_mismatch(a: Column, b: Column) -> Column:
    """Index from 0 at which two arrays differ first; null if they are equal. The end of the shorter one differs."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1)


def is_prefix(a: Column, b: Column) -> Column:
    return (F.size(a) <= F.size(b)) & (F.slice(b, 1, F.size(a)) == a)


def merged(user: DataFrame, auto: DataFrame, key: str, value: str) -> DataFrame:
    """Union by key; the user's value rules."""
    return user.withColumnRenamed(value, "_u").join(auto.withColumnRenamed(value, "_a"), key, "full_outer").select(key, F.coalesce("_u", "_a").alias(value))


def term_occurrences(texts: DataFrame, terms: DataFrame, text: str, term: str, *, most_terms: int = 10_000, most_bytes: int = 1 << 20) -> DataFrame:
    """Each text with each different term that it contains and how often; empty terms are in no text. Terms are measured
    first: a glossary of checked size is one array that each text filters, so there is neither a join nor a shuffle of
    texts. Beyond it, texts meet terms by the terms' first three characters (or all of a shorter one), as hashes and
    grams; only texts that hold a term's beginning are joined with it."""
    from vellumlake.functions.text import occurrences

    words = terms.select(term).where(F.length(term) > 0).distinct()
    size = F.least(F.length(term), F.lit(3))
    n, n_bytes, sizes = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(term)), F.lit(0)), F.collect_set(size)).first()
    if n <= most_terms and n_bytes <= most_bytes:
        listed = json.dumps(sorted(r[0] for r in words.collect()), ensure_ascii=False)
        # one literal, which is folded to an array once
        found = F.filter(F.from_json(F.lit(listed), "array<string>"), lambda t: F.contains(F.col(text), t))
        return texts.withColumn(term, F.explode(found)).withColumn("n", occurrences(F.col(text), F.col(term)))
    t = F.col(text)
    grams = [F.when(F.length(t) >= k, F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substr(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>")) for k in sorted(sizes)]  # noqa: B023
    met = texts.select(F.xxhash64(t).alias("_h"), F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("_g")).distinct()
    keyed = words.select(term, F.substr(F.col(term), F.lit(1), size).alias("_g"))
    pairs = met.join(keyed, "_g").select("_h", term).distinct()
    return texts.withColumn("_h", F.xxhash64(t)).join(pairs, "_h").drop("_h").where(F.contains(t, F.col(term))).withColumn("n", occurrences(t, F.col(term)))


def code_ranges(codes: DataFrame, exact: DataFrame, ranges: DataFrame) -> DataFrame:
    """code -> cid: an exact entry first, else the first listed range (ord, low, high, first, bytes) of the code's
    byte length that holds it. Ranges meet codes by blocks of 256 codes, not by a cross join."""
    blocks = ranges.withColumn("_b", F.explode(F.sequence(F.shiftright(F.col("low"), 8), F.shiftright(F.col("high"), 8))))
    hit = codes.withColumn("_b", F.shiftright(F.col("code"), 8)).join(blocks, ["font", "bytes", "_b"]).where("code between low and high")
    ranged = hit.groupBy("font", "code", "bytes").agg(F.min(F.struct("ord", (F.col("first") + F.col("code") - F.col("low")).alias("cid"))).alias("r")).select("font", "code", "bytes", F.col("r.cid").alias("_ranged"))
    return codes.join(exact.withColumnRenamed("cid", "_exact"), ["font", "code"], "left").join(ranged, ["font", "code", "bytes"], "left").select("font", "code", "bytes", F.coalesce("_exact", "_ranged").alias("cid"))


def unique_owners(matches: DataFrame, item: list[str], owner: str) -> DataFrame:
    """item, owner where exactly one owner matches the item."""
    return matches.groupBy(*item).agg(F.min(owner).alias(owner), F.count_distinct(owner).alias("_n")).where("_n = 1").drop("_n")


def mutually_unique(matches: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose two sides have no other partner."""
    pairs = matches.select(left, right).distinct()
    l, r = Window.partitionBy(left), Window.partitionBy(right)
    return pairs.withColumns({"_l": F.count("*").over(l), "_r": F.count("*").over(r)}).where("_l = 1 and _r = 1").select(left, right)
