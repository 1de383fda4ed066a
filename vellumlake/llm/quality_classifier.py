"""Quality by hierarchical empirical Bayes.

A logistic classifier over text statistics gives each document's own evidence. Grouped
aggregation of that evidence over all rows gives posteriors of hosts and of paths within hosts:
a host's is shrunk toward the global mean, a path's toward its host's, by strengths that the
method of moments takes from the spread between hosts and between paths. A document's
posterior adds its path's log-odds against the global ones, its own share taken out, to its own.
The threshold best separates the labelled rows among those that keep KEEP of the good ones.

The classifier and the threshold use every labelled row, aggregates and scores every row. Without labels of both kinds every document has probability 1 and is kept.

Documents have source and language as host and path; web pages, judged along with them, those
of their address, and their markup is left out.

Defined results: null and empty texts are scored as empty; a null host or path is the host or
path ""; equal texts of one path have equal results, so ties and repeated rows are alike; an id
that is repeated counts once among the labelled rows; rows without an id are judged, and match
no label; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumlake.llm.common import fresh, looked_up, map_arrow, pieces, stored
from vellumlake.llm.language_id import host_of, plain
from vellumlake.llm.quality_rules import KEEP, statistics

STRIPES = 128  # of one unit of log-odds, in which the threshold counts
LOW, HIGH = 0.001, 0.999
SHIFT = 3.0  # log-odds that a path may add or take at most


def logit(p):
    return np.log(p) - np.log1p(-p)


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def prob(self, x: Column) -> Column:
        """The probability of good quality of statistics, an array column."""
        z = [F.least(F.greatest((x[i] - float(m)) / float(c), F.lit(-8.0)), F.lit(8.0)) for i, (m, c) in enumerate(zip(self.mean, self.scale))]
        log_odds = F.lit(float(self.beta[0]))
        for b, v in zip(self.beta[1:], [*z, *(v * v for v in z)]):
            log_odds = log_odds + float(b) * v
        p = 1 / (1 + F.exp(-F.least(F.greatest(log_odds, F.lit(-30.0)), F.lit(30.0))))
        return F.least(F.greatest(p, F.lit(LOW)), F.lit(HIGH))


def _design(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.column_stack([np.ones(len(z)), z, z * z])


def fit_classifier(known: DataFrame, ridge: float = 1.0) -> Classifier | None:
    """known: y (0 or 1) and x (statistics) of every labelled row; None without rows of both kinds. Each step of Newton's
    method is a sum over all rows: tasks give theirs, the driver sees one row of each."""
    count = known.groupBy("y").agg(F.count("*").alias("n"), F.first(F.size("x")).alias("d")).collect()
    if len(count) < 2:
        return None
    x = [F.col("x")[i] for i in range(count[0]["d"])]
    r = known.agg(*map(F.avg, x), *map(F.stddev_pop, x)).first()
    mean, scale = np.array(r[: len(x)]), np.maximum(np.array(r[len(x) :]), 1e-6)
    total = sum(c["n"] for c in count)
    weight = {int(c["y"]): 0.5 * total / c["n"] for c in count}  # both kinds weigh alike
    width = 1 + 2 * len(x)

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            out = np.zeros(width * (width + 1))
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(0).to_numpy()
                    z = _design((batch.column(1).flatten().to_numpy().reshape(-1, width // 2) - mean) / scale)
                    w = np.where(y == 1, weight[1], weight[0])
                    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                    out += np.concatenate([((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z).ravel(), z.T @ (w * (y - p))])
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["s"])

        parts = sorted(r["s"] for r in known.select("y", "x").mapInArrow(run, "s array<double>").collect())
        s = np.sum(parts, axis=0)
        return s[: width * width].reshape(width, width), s[width * width :]

    beta, pull = np.zeros(width), np.diag([1e-6, *[ridge] * (width - 1)])
    for _ in range(60):
        curve, slope = sums(beta)
        step = np.linalg.solve(curve + pull, slope - pull @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    return Classifier(mean, scale, beta)


def described(df: DataFrame, html: str | None = None) -> DataFrame:
    """df (text and more) with _x, the statistics of the text, instead of it; `html`: a boolean column, true for texts
    with markup."""
    at, marked = df.columns.index("text"), df.columns.index(html) if html else None
    rest = [i for i in range(len(df.columns)) if i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in rest), T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def run(whole: pa.RecordBatch):
        for batch in pieces(whole):
            texts = batch.column(at).to_pylist()
            if marked is not None:
                texts = [plain(t) if h and t else t for t, h in zip(texts, batch.column(marked).to_pylist())]
            x = pa.array([statistics(t or "")[1] for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), x], names=[*(batch.schema.names[i] for i in rest), "_x"])

    return map_arrow(df, run, schema)


def labelled(every: DataFrame, labels: DataFrame, value: str = "quality") -> DataFrame:
    """y, x, _host, _path, one row for each labelled id of every (_id, _x, _host, _path): the least by these where an id
    is repeated; of several labels of an id the greatest counts. No text is shuffled."""
    given = labels.where(F.col(value).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(value).cast("int").alias("y"))
    rows = looked_up(every.select("_id", F.struct(F.col("_x").alias("x"), "_host", "_path").alias("v")), given, ["_id"], F.xxhash64("v"), how="inner")
    return rows.groupBy("_id").agg(F.min("v").alias("v"), F.max("y").alias("y")).select("y", "v.*")


def strength(between: float, mu: float) -> float:
    """Pseudo-counts of a beta prior whose means spread by the variance `between` around mu."""
    return float(np.clip(mu * (1 - mu) / max(between, 1e-9) - 1, 1.0, 1e4))


@dataclass(frozen=True)
class Sites:
    paths: DataFrame  # _host, _path, _k, _n (of the path), _hk, _hn (of the host)
    mu: float
    host_strength: float
    path_strength: float


def sites(evidence: DataFrame) -> Sites:
    """evidence: _host, _path, _p of every row. Sums by path, then by host; partial sums before each shuffle."""
    paths = stored(evidence.groupBy("_host", "_path").agg(F.sum("_p").alias("_k"), F.count("*").alias("_n"), F.sum(F.col("_p") * F.col("_p")).alias("_s")), "paths")
    hosts = stored(paths.groupBy("_host").agg(F.sum("_k").alias("_hk"), F.sum("_n").alias("_hn"), F.count("*").alias("_paths")), "hosts")
    both = stored(looked_up(paths, hosts, ["_host"], F.col("_path"), count="_paths").drop("_paths"), "sites")
    g = both.agg(F.sum("_k").alias("k"), F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
    if not g["n"]:
        return Sites(both, 0.5, 1.0, 1.0)
    mu = min(max(g["k"] / g["n"], LOW), HIGH)
    var = max(g["s"] / g["n"] - mu * mu, 1e-9)  # of one document's evidence

    def spread(mean: Column, around: Column, n: Column, rows: DataFrame) -> float:
        """Variance between groups beyond what groups of their sizes show by chance."""
        r = rows.agg(F.sum(n * (mean - around) * (mean - around)).alias("ss"), F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(n * n).alias("nn")).first()
        room = r["n"] - r["nn"] / r["n"]
        return max(0.0, (r["ss"] - var * max(0, r["g"] - 1)) / room) if room > 0 else 0.0

    c = F.col
    by_host = spread(c("_hk") / c("_hn"), F.lit(mu), c("_hn"), hosts)
    by_path = spread(c("_k") / c("_n"), c("_hk") / c("_hn"), c("_n"), both)
    return Sites(both.drop("_s"), mu, strength(by_host, mu), strength(by_path, mu))


def with_posterior(rows: DataFrame, s: Sites) -> DataFrame:
    """rows (_host, _path, _p and more) with _host_post, _path_post and _posterior; the row's own evidence is taken
    out of its site's."""
    out = looked_up(rows, s.paths, ["_host", "_path"], F.col("_p"), count="_n")
    own = F.col("_p")
    host = (F.greatest(F.col("_hk") - own, F.lit(0.0)) + s.host_strength * s.mu) / (F.col("_hn") - 1 + s.host_strength)
    out = out.withColumn("_host_post", F.coalesce(host, F.lit(s.mu)))
    path = (F.greatest(F.col("_k") - own, F.lit(0.0)) + s.path_strength * F.col("_host_post")) / (F.col("_n") - 1 + s.path_strength)
    out = out.withColumn("_path_post", F.least(F.greatest(F.coalesce(path, F.col("_host_post")), F.lit(LOW)), F.lit(HIGH)))
    odds = lambda p: F.log(p / (1 - p))
    shift = F.least(F.greatest(odds(F.col("_path_post")) - odds(F.lit(s.mu)), F.lit(-SHIFT)), F.lit(SHIFT))
    return out.withColumn("_posterior", 1 / (1 + F.exp(-(odds(own) + shift)))).drop("_k", "_n", "_hk", "_hn")


def threshold(rows: DataFrame, keep: float = KEEP) -> float:
    """rows: y and _posterior of every labelled row. Rows at or above the threshold are kept: at least so many of the good
    ones, and else the best separation. Counts below each value are sums within a stripe of log-odds and of the stripes
    below it, so no task sorts all values and the driver sees stripes only."""
    p = F.col("_posterior")
    values = rows.groupBy(p).agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    values = stored(values.withColumn("stripe", F.floor(STRIPES * F.log(p / (1 - p))).cast("int")), "values")
    stripes = sorted(values.groupBy("stripe").agg(F.sum("good"), F.sum("bad")).collect())
    below = np.cumsum([(0, 0), *((g, b) for _, g, b in stripes)], axis=0).tolist()
    good, bad = below[-1]
    before = rows.sparkSession.createDataFrame([(s[0], *n) for s, n in zip(stripes, below)], "stripe int, good_below bigint, bad_below bigint")
    earlier = Window.partitionBy("stripe").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    lost, caught = (F.col(f"{k}_below") + F.coalesce(F.sum(k).over(earlier), F.lit(0)) for k in ("good", "bad"))
    kept = 1 - lost / max(1, good)
    gains = stored(values.join(F.broadcast(before), "stripe").select(p, kept.alias("kept"), (caught / max(1, bad)).alias("caught")).where(F.col("kept") >= keep).select(p, (F.col("kept") + F.col("caught")).alias("gain")), "gains")
    best = gains.where(F.col("gain") == gains.agg(F.max("gain")).first()[0])
    at = best.orderBy(p).offset(best.count() // 2).first()["_posterior"]
    under = values.where(p < at).agg(F.max(p)).first()[0]
    return at if under is None else (at + under) / 2


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def places(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, doc_id, page_id, host, path, text, html of documents and pages: of an address, the host and the first
    part of its path."""
    null = F.lit(None).cast("bigint")
    d = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("bigint").alias("doc_id"), null.alias("page_id"), F.col("source").alias("host"), F.col("lang").alias("path"), "text", F.lit(False).alias("html"))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    return d.unionAll(pages.select(F.lit("page"), null, F.col("page_id").cast("bigint"), host_of(F.col("url")), path, F.col("html"), F.lit(True)))


def judged(rows: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", *, keep: list[str] | None = None, html: str | None = None) -> DataFrame:
    """The columns `keep` of rows (by default all) with _p, _host_post, _path_post, _posterior and _kept; their names get
    more underscores where rows has them. rows need doc_id and text. Statistics of a text are made once, and what is
    kept of a row is written with them; no text is shuffled."""
    keep = rows.columns if keep is None else keep
    names = fresh(rows.columns, "p", "host_post", "path_post", "posterior", "kept")
    out = lambda df, values: df.select("_row.*", *(v.alias(n) for n, v in zip(names, values)))
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row")
    inner = rows.select(kept, F.col("doc_id").alias("_id"), "text", _key(F.col(f"`{host}`")).alias("_host"), _key(F.col(f"`{path}`")).alias("_path"), *([F.col(f"`{html}`").alias("_html")] if html else []))
    every = stored(described(inner, "_html" if html else None), "described")
    known = stored(labelled(every, labels), "labelled")
    classifier = fit_classifier(known)
    if classifier is None:
        one = F.lit(1.0)
        return out(every, (one, one, one, one, F.lit(True)))
    every = every.withColumn("_p", classifier.prob(F.col("_x"))).drop("_x")
    s = sites(every.select("_host", "_path", "_p"))
    cut = threshold(with_posterior(known.select("y", "_host", "_path", classifier.prob(F.col("x")).alias("_p")), s).select("y", "_posterior"))
    done = with_posterior(every, s)
    return out(done, (*(F.col(c) for c in ("_p", "_host_post", "_path_post", "_posterior")), F.col("_posterior") >= cut))
