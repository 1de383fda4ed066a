"""TOML inputs: glossaries, manifests, adjudications. Files are read by Spark, parsed where they lie."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def toml_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json.dumps(tomllib.loads(t), default=str))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and the TOML file as JSON text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.toml").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), toml_json("value").alias("json"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """source, target; the version must be 1, sources and targets non-empty, sources unique."""
    d = documents(spark, path).select(F.from_json("json", "version int, terms array<struct<source:string,target:string>>").alias("g"))
    t = d.select("g.version", F.explode_outer("g.terms").alias("t")).select("version", "t.source", "t.target")
    bad = (F.col("version") != 1) | (F.coalesce(F.trim("source"), F.lit("")) == "") | (F.coalesce(F.trim("target"), F.lit("")) == "")
    counted = t.groupBy("source").agg(F.min("target").alias("target"), F.count("*").alias("n"), F.bool_or(bad).alias("bad"))
    ok = F.when((F.col("n") == 1) & ~F.col("bad"), True).otherwise(F.raise_error(F.concat(F.lit("invalid glossary term: "), F.coalesce("source", F.lit("")))).cast("boolean"))
    return counted.where(ok).select("source", "target")


def glossary_toml(terms: DataFrame) -> DataFrame:
    """The canonical text of a glossary and its fingerprint: terms sorted by source."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    entry = F.concat(F.lit("\n[[terms]]\nsource = "), quoted("source"), F.lit("\ntarget = "), quoted("target"), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("source", entry.alias("entry"))))
    text = F.concat(F.lit("version = 1\n"), F.array_join(F.transform(rows, lambda r: r["entry"]), ""))
    return terms.agg(text.alias("toml")).withColumn("fingerprint", F.sha2("toml", 256))


BLOCK = "struct<key:string,page:int,column:int,draw_order:int,reading_order:int,text:string,visual_text:string,unicode_semantic:boolean,visible:boolean,baseline_origin:array<double>,metric_box:array<double>,visual_bbox:array<double>>"
MANIFEST = f"schema_version int, identity struct<id:string,name:string,class:string,legality:string,cases:array<string>,priority:string>, source struct<method:string,pdf:string,pdf_sha256:string>, page array<struct<index:int,media_box:array<double>,crop_box:array<double>,rotate:int>>, expected struct<tolerance_pt:double,structure:struct<pages:int,blocks:int,columns:int>,block:array<{BLOCK}>,degradation:array<struct<scope:string,page:int,paragraph:int,reason:string>>>, oracle struct<checks:array<string>>, `group` struct<name:string,raster_identical_with:array<string>>"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest, in order of its path when sorted by it."""
    return documents(spark, path).where("path like '%manifest.toml'").select("path", F.from_json("json", MANIFEST).alias("m")).select("path", "m.*")


def expected_blocks(manifests_: DataFrame) -> DataFrame:
    b = manifests_.select(F.col("identity.id").alias("fixture"), F.col("expected.tolerance_pt").alias("tolerance_pt"), F.explode("expected.block").alias("b"))
    return b.select("fixture", "tolerance_pt", "b.key", "b.page", "b.reading_order", "b.draw_order", "b.text", F.coalesce("b.visible", F.lit(True)).alias("visible"), F.coalesce("b.unicode_semantic", F.lit(True)).alias("unicode_semantic"), "b.metric_box", "b.visual_bbox", "b.baseline_origin")


def differences(expected: DataFrame, found: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """key, field, expected, found of every field that differs, tolerance-free; a missing row differs in all."""
    e, f = (d.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(side)) for c in fields))).alias("x")).select(*keys, "x.*") for d, side in ((expected, "expected"), (found, "found")))
    return e.join(f, [*keys, "field"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("found")))
