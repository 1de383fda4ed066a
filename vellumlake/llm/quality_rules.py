"""Rule statistics of texts, and an isolation forest over them.

A document is kept if it meets the base rules and its mean path length over random splits is
not that of an anomaly. The forest grows on labelled rows of good quality; the threshold is
the score that best separates the labelled rows, among those that keep at least KEEP of the
good ones. Both use a bounded sample of labelled rows (SAMPLE, by a hash of the id); scores
cover every row.

Defined results: null and empty texts have no words and fail the base rules; without labelled
rows of both kinds nothing is called an anomaly; equal texts have equal results, so ties and
repeated rows are alike; an id that is repeated counts once among the labelled rows; columns
besides id and text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.llm.common import map_arrow, pieces, text_or_empty

SAMPLE = 20_000  # labelled rows that fit the forest and its threshold, at most
TREES, SUBSAMPLE = 100, 256
KEEP = 0.985  # share of the good labelled rows that the threshold must keep
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
N_FEATURES = 9


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of so many words that occur twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, n)
    if len(table) == n:
        return 0
    code, top, bits = ids, len(table), max(1, (len(table) - 1).bit_length())
    if bits * width <= 62:
        code = ids[: n - width + 1].copy()
        for k in range(1, width):
            code = code << bits | ids[k : n - width + 1 + k]
    else:
        for k in range(1, width):  # exact for any vocabulary: pairs get new small ids each time
            code = code[: n - k] * top + ids[k:]
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(code), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The base counts, and the features that the forest splits on."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    n = len(words)
    blank = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    chars = len(text) - blank
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=5) if raw else np.zeros(5, int)
    letters, upper, digits, marks = int(kinds[0]), int(kinds[1]), int(kinds[2]), int(kinds[3])
    size = max(1, len(raw))
    feats = [
        math.log1p(n),
        chars / max(1, n),
        symbols / max(1, n),
        dup / max(1, len(lines)),
        repeat / max(1, n),
        upper / max(1, letters + upper),
        digits / size,
        marks / max(1, n),
        math.log((len(set(words)) + 1) / (n + 1)),
    ]
    return (n, chars, symbols, dup, repeat), feats


_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"]] = 3


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1: a leaf
    split: np.ndarray
    path: np.ndarray  # depth of a leaf and the mean rest of its points
    depth: int
    psi: int

    @classmethod
    def grown(cls, x: np.ndarray, seed: int = 7, trees: int = TREES, psi: int = SUBSAMPLE) -> Forest:
        rng = np.random.default_rng(seed)
        psi = min(psi, len(x))
        depth = max(1, math.ceil(math.log2(max(2, psi))))
        nodes = 2 ** (depth + 1) - 1
        feature, split, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, x[rng.choice(len(x), psi, replace=False)], 0)]
            while todo:
                k, part, d = todo.pop()
                low, high = part.min(0), part.max(0)
                free = np.flatnonzero(high > low)
                if d == depth or len(part) <= 1 or not len(free):
                    path[t, k] = d + _c(len(part))
                    continue
                f = rng.choice(free)
                at = rng.uniform(low[f], high[f])
                feature[t, k], split[t, k] = f, at
                left = part[:, f] < at
                todo += [(2 * k + 1, part[left], d + 1), (2 * k + 2, part[~left], d + 1)]
        return cls(feature, split, path, depth, psi)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, s, p in zip(self.feature, self.split, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                g = f[node]
                inner = g >= 0
                go = 2 * node + 1 + (x[rows, np.maximum(g, 0)] >= s[node])
                node = np.where(inner, go, node)
            total += p[node]
        return 2 ** (-total / len(self.path) / max(_c(self.psi), 1e-9))


@dataclass
class RuleModel:
    forest: Forest | None
    threshold: float

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(x) if self.forest is not None and len(x) else np.zeros(len(x))


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, most: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """At most so many labelled rows (doc_id, text, extra columns, _value): the smallest ids by hash, one row for each,
    the least by text and extra columns where an id is repeated. The ids are few by that bound, so the join broadcasts
    them; of several labels of an id the greatest counts."""
    few = labels.where(F.col(value).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(value).cast("int").alias("_value"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = docs.select("doc_id", F.struct(text_or_empty("text").alias("text"), *extra).alias("_row")).join(F.broadcast(few), "doc_id")
    return known.groupBy("doc_id").agg(F.min("_row").alias("_row"), F.max("_value").alias("_value")).select("doc_id", "_row.*", "_value")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    def run(whole: pa.RecordBatch):
        for batch in pieces(whole):
            got = [statistics(t or "")[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.list_(pa.float64()))], names=["y", "x"])

    rows = map_arrow(labelled_sample(docs, labels, "quality", sample).select("text", F.col("_value")), run, "y int, x array<double>").toPandas()
    if not len(rows) or rows.y.nunique() < 2:
        return RuleModel(None, 1.0)
    x, y = np.array(rows.x.tolist(), float), rows.y.to_numpy()
    order = np.lexsort((*x.T, y))  # the same forest whatever order the rows came in
    x, y = x[order], y[order]
    good = x[y == 1]
    forest = Forest.grown(good)
    s = forest.score(x)
    cuts = np.unique(s)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1])
    kept = np.searchsorted(np.sort(s[y == 1]), cuts, "right") / max(1, (y == 1).sum())
    caught = 1 - np.searchsorted(np.sort(s[y == 0]), cuts, "right") / max(1, (y == 0).sum())
    gain = np.where(kept >= KEEP, kept + caught, -1)
    best = np.flatnonzero(gain == gain.max())
    return RuleModel(forest, float(cuts[best[len(best) // 2]]))  # amid equals: as far from one kind as from the other


def judge(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed, kept and the anomaly score of every row; no shuffle."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # trees x nodes numbers: fixed size
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in BASE)}, base_failed boolean, kept boolean, anomaly double"

    def run(whole: pa.RecordBatch):
        m = shared.value
        for batch in pieces(whole):
            got = [statistics(t) for t in batch.column(1).to_pylist()]
            base = np.array([g[0] for g in got], np.int64).reshape(len(got), len(BASE))
            score = m.anomaly(np.array([g[1] for g in got], float).reshape(len(got), N_FEATURES))
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            kept = ~failed & (score <= m.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(score)], names=[id_col, *BASE, "base_failed", "kept", "anomaly"])

    return map_arrow(df.select(F.col(id_col), text_or_empty(text_col).alias("_text")), run, schema)
