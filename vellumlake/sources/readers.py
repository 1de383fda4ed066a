"""Readers: snapshots, recordings, event logs, process logs and resource reports, as normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions.numeric import finite
from vellumlake.functions.text import valid_sha256
from vellumlake.sources import schemas as S


def _document_id() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]+)*$", 1)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row a document; malformed files fail the job."""
    return spark.read.schema(S.DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("document", _document_id())


def pages(documents: DataFrame) -> DataFrame:
    p = documents.select("document", F.explode("pages").alias("p"))
    return p.select("document", F.col("p.index").alias("page_index"), "p.geometry.*", F.size("p.paragraphs").alias("paragraphs"))


def paragraphs(documents: DataFrame) -> DataFrame:
    p = documents.select("document", F.explode("pages").alias("p")).select("document", F.col("p.index").alias("page_index"), F.explode("p.paragraphs").alias("q"))
    return p.select("document", "page_index", "q.reading_order", "q.bounds", "q.first_line_indent", F.col("q.text.chars").alias("chars"), "q.translated_text", "q.translation_conservation", preserved_reason(F.col("q.preserved")).alias("preserved"))


def characters(paragraphs: DataFrame) -> DataFrame:
    """One row a character with its position; absent flags get their defaults."""
    c = paragraphs.select("document", "page_index", "reading_order", F.posexplode("chars").alias("pos", "c"))
    default = lambda name, value: F.coalesce(F.col(f"c.{name}"), F.lit(value)).alias(name)
    return c.select("document", "page_index", "reading_order", "pos", "c.unicode", "c.unicode_source", "c.code", default("visible", True), default("implicit_space_before", False), default("bbox_estimated", False), "c.font_size", "c.baseline_origin", "c.box", "c.visual_bbox", "c.text_transform", "c.layout", "c.passthrough")


def publication_ink(documents: DataFrame) -> DataFrame:
    k = documents.select("document", F.explode("publication_ink").alias("k"))
    return k.select("document", "k.page_index", "k.reading_order", "k.crop_box", "k.admissible_container", F.posexplode("k.components").alias("component_index", "c")).select("document", "page_index", "reading_order", "crop_box", "admissible_container", "component_index", "c.*")


def preserved_reason(value: Column) -> Column:
    """The reason of an object {"reason": ...} or the scalar itself."""
    return F.coalesce(F.get_json_object(value, "$.reason"), value)


def evidence_complete(e: Column) -> Column:
    return valid_sha256(e["request_sha256"]) & valid_sha256(e["response_sha256"]) & (F.size(e["source_tokens"]) == e["source_token_types"]) & (F.size(e["target_tokens"]) == e["target_token_types"])


_ALLOWED = {"": {"schema_version", "pages"}, "page": {"page_index", "geometry", "regions"}, "region": {"bounds", "reading_order", "label", "source", "confidence"}}


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Layout regions of recordings, one row each; unknown keys, other versions, repeated pages or orders and regions
    without area fail the job."""
    raw = spark.read.text(path, wholetext=True).withColumn("document", _document_id())
    v = F.parse_json("value")
    only = lambda keys, allowed: F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*(F.lit(k) for k in sorted(allowed))))) == 0
    keys = only(F.json_object_keys("value"), _ALLOWED[""])
    pages_ = F.variant_get(v, "$.pages", "array<variant>")
    text = lambda x: F.to_json(x)
    page_ok = F.forall(pages_, lambda p: only(F.json_object_keys(text(p)), _ALLOWED["page"]))
    region_ok = F.forall(pages_, lambda p: F.forall(F.coalesce(F.variant_get(p, "$.regions", "array<variant>"), F.array().cast("array<variant>")), lambda r: only(F.json_object_keys(text(r)), _ALLOWED["region"])))
    d = F.from_json("value", S.RECORDING)
    checked = raw.withColumn("ok", keys & page_ok & region_ok).withColumn("d", d)
    p = checked.select("document", "ok", F.col("d.schema_version").alias("version"), F.explode("d.pages").alias("p"), F.transform("d.pages", lambda x: x["page_index"]).alias("indices"))
    orders = F.transform("p.regions", lambda r: r["reading_order"])
    unique = (F.size(F.array_distinct("indices")) == F.size("indices")) & (F.size(F.array_distinct(orders)) == F.size(orders))
    rows = p.withColumn("good", F.coalesce(F.col("ok") & (F.col("version") == 1) & unique, F.lit(False)))
    r = rows.select("document", "good", F.col("p.page_index").alias("page_index"), F.col("p.geometry").alias("geometry"), F.explode_outer("p.regions").alias("r"))
    b = F.col("r.bounds")
    region = F.col("r").isNull() | (finite(b["left"]) & finite(b["bottom"]) & finite(b["right"]) & finite(b["top"]) & (b["right"] > b["left"]) & (b["top"] > b["bottom"]) & F.col("r.confidence").between(0, 1))
    fail = F.when(F.col("good") & region, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid layout recording: "), "document")).cast("boolean"))
    return r.where(fail).select("document", "page_index", "geometry", F.col("r.reading_order").alias("reading_order"), F.col("r.label").alias("label"), F.col("r.source").alias("source"), F.col("r.confidence").alias("confidence"), b.alias("bounds"))


def looked_up_regions(pages_: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions of each page; a page without a recording or with another geometry fails the job."""
    known = regions.select("document", "page_index", F.col("geometry").alias("_g"), "reading_order", "label", "confidence", "bounds")
    out = pages_.join(known, ["document", "page_index"], "left")
    same = F.col("_g").isNotNull() & (F.col("_g.width") == F.col("width")) & (F.col("_g.height") == F.col("height")) & (F.col("_g.rotate_degrees") == F.col("rotate_degrees"))
    return out.where(F.when(same, True).otherwise(F.raise_error(F.lit("no recording of this page and geometry")).cast("boolean"))).drop("_g")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Protocol events with the number of their line in the file, from 0; empty lines are skipped, and counted. A run's
    log is one file and read whole, as the order of its lines is what terminal checks, budgets and pairs rest on."""
    logs = spark.read.text(path, wholetext=True).withColumn("run", _document_id())
    lines = logs.select("run", F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "line")).where("trim(line) <> ''")
    return lines.select("run", F.col("ordinal").cast("bigint").alias("ordinal"), F.from_json("line", S.EVENT).alias("e")).select("run", "ordinal", "e.*")


def extracted_terms(answers: DataFrame, json: str = "value") -> DataFrame:
    """source, target of each term in a backend's answer {"terms": [...]}, with the answer's other columns; terms
    without a source or a target don't count, and an answer that can't be read has none."""
    rest = [c for c in answers.columns if c != json]
    t = answers.select(*rest, F.explode(F.from_json(json, "terms array<struct<source:string,target:string>>")["terms"]).alias("t"))
    return t.select(*rest, "t.source", "t.target").where("trim(source) <> '' and trim(target) <> ''")


def text_boxes(reports: DataFrame, json: str = "value") -> DataFrame:
    """page, block, line and box (x, y downward, w, h) of a structured-text report, with the report's other columns."""
    box = "bbox struct<x:double,y:double,w:double,h:double>"
    rest = [c for c in reports.columns if c != json]
    d = reports.select(*rest, F.from_json(json, f"pages array<struct<blocks:array<struct<type:string,{box.replace(' ', ':', 1)},lines:array<struct<text:string,{box.replace(' ', ':', 1)}>>>>>>").alias("d"))
    p = d.select(*rest, F.posexplode("d.pages").alias("page", "p"))
    b = p.select(*rest, "page", F.posexplode("p.blocks").alias("block", "b")).where("coalesce(b.type, 'text') = 'text'")
    return b.select(*rest, "page", "block", F.posexplode("b.lines").alias("line", "l")).select(*rest, "page", "block", "line", "l.text", "l.bbox.*")


def resource_usage(spark: SparkSession, path: str) -> DataFrame:
    """wall seconds and peak bytes of a run; number and name come in either order."""
    t = spark.read.text(path, wholetext=True)
    wall = F.coalesce(F.nullif(F.regexp_extract("value", r"(?m)^\s*real\s+([0-9.]+)", 1), F.lit("")), F.nullif(F.regexp_extract("value", r"(?m)^\s*([0-9.]+)\s+real\b", 1), F.lit("")))
    peak = F.coalesce(F.nullif(F.regexp_extract("value", r"(?m)^\s*([0-9]+)\s+maximum resident set size", 1), F.lit("")), F.nullif(F.regexp_extract("value", r"(?m)maximum resident set size\D*([0-9]+)", 1), F.lit("")))
    return t.select(_document_id().alias("run"), wall.cast("double").alias("wall_time_seconds"), peak.cast("bigint").alias("peak_rss_bytes"))


def content_objects(reports: DataFrame, json: str = "value") -> DataFrame:
    """document, object of each "N G R" reference in a page's /Contents, a single one or an array."""
    v = F.parse_json(json)
    objects = F.variant_get(v, "$.pages", "array<variant>")
    one = reports.select("document", F.posexplode(objects).alias("page_index", "p"))
    refs = F.regexp_extract_all(F.to_json(F.variant_get("p", "$.contents", "variant")), F.lit(r"(\d+) \d+ R"), F.lit(1))
    return one.select("document", "page_index", F.explode(refs).alias("object")).withColumn("object", F.col("object").cast("bigint"))


def json_names(df: DataFrame, json: str, names: list[str], most: int = 12) -> DataFrame:
    """How often each name stands in a JSON text as a key or a string value, with or without a leading slash, down to
    `most` levels. The value is opened level by level, so names inside other texts don't count."""
    items = F.array(F.struct(F.lit(None).cast("string").alias("k"), F.parse_json(json).alias("v")))
    said = []

    def below(x):
        inner = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        each = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda e: F.struct(F.lit(None).cast("string").alias("k"), e.alias("v")))
        return F.coalesce(inner, each, F.slice(F.array(x), 1, 0))

    for _ in range(most + 1):
        said.append(F.flatten(F.transform(items, lambda x: F.array(x["k"], F.try_variant_get(x["v"], "$", "string")))))
        items = F.flatten(F.transform(items, below))
    words = F.transform(F.concat(*said), lambda w: F.regexp_replace(w, "^/", ""))
    return df.select("document", F.explode(F.filter(words, lambda w: w.isin(*names))).alias("name")).groupBy("document", "name").agg(F.count("*").alias("n"))


def xref_offsets(report: Column) -> Column:
    """object, offset of each line "N/G: uncompressed; offset = X"."""
    return F.transform(F.regexp_extract_all(report, F.lit(r"(\d+)/\d+: uncompressed; offset = (\d+)"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"^(\d+)", 1).cast("bigint").alias("object"), F.regexp_extract(m, r"(\d+)$", 1).cast("bigint").alias("offset")))
