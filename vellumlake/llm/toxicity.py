"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digit and sign substitutions, invisible characters), one
Aho-Corasick pass finds the lexicon's words and word beginnings at word borders, hits inside
exception phrases don't count, and the weights' sum, also per word, gives the score through a
logistic curve. The lexicon is SEEDS plus what labelled rows show: words and word beginnings
that explain toxic rows that nothing else explains yet, beyond what chance gives among so
many candidates. Both are learned from at most SAMPLE labelled rows whose crc32(doc_id) mod 3
is not 1; all rows are scored.

Defined results: null and empty texts have the score of a text without hits; without labelled
rows of both kinds the seeds alone decide; equal texts have equal scores, whatever their other
columns; a row without an id is scored and not held out; a label of a repeated id counts for
one of its rows; work is linear in a text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.llm.common import map_arrow, pieces, text_or_empty
from vellumlake.llm.quality_rules import labelled_sample

SAMPLE = 12_000  # labelled rows that the lexicon and the curve are learned from, at most
PREFIXES = (4, 5, 6, 7)  # lengths of word beginnings that may become patterns
MOST_PATTERNS = 2_000
MOST_CANDIDATES = 10_000  # patterns that are weighed against each other, at most: the driver holds their numbers by toxic sample row
SEEDS = ("bastard", "clown", "disgusting", "dumb", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("circus clown", "clown fish", "recycling trash", "stupid question", "take out the trash", "trash bag", "trash bin", "trash can")
CUT = 0.7
FALSE_COST = 3  # how much a clean row called toxic weighs against a toxic row missed, when the cut is set

#: Homoglyphs (Cyrillic, Greek, full-width by rule) and substitutions, to plain letters.
_PAIRS = ("аa", "еe", "оo", "рp", "сc", "уy", "хx", "іi", "ѕs", "ԁd", "ɡg", "ɩi", "αa", "εe", "ιi", "κk", "νv", "οo", "ρp", "τt", "υu", "χx", "ı" "i", "0o", "1i", "3e", "4a", "5s", "7t", "@a", "$s")
_FOLD = {ord(p[0]): p[1] for p in _PAIRS} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_WORDS = re.compile(r"[^\W_]+").findall


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Lexicon:
    whole: dict[str, float] = field(default_factory=dict)
    prefix: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-4.0, 2.5, 1.0)
    cut: float = 0.5  # value of the curve that becomes CUT
    _automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a, found = ahocorasick.Automaton(), {}
            for kind, words in (("w", self.whole), ("p", self.prefix)):
                for w, weight in words.items():
                    found.setdefault(w, []).append((kind, weight, len(w)))
            for p in EXCEPTIONS:
                found.setdefault(fold(p), []).append(("x", 0.0, len(fold(p))))
            for w, x in found.items():
                a.add_word(w, x)
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str) -> tuple[float, int]:
        """Sum of the weights of what is found, and the number of words."""
        s = fold(text)
        hits, free, n = [], [], len(s)
        for end, found in self.automaton().iter(s):
            end += 1
            for kind, weight, size in found:
                start = end - size
                if start and s[start - 1].isalnum():
                    continue
                if kind != "p" and end < n and s[end].isalnum():
                    continue
                (free if kind == "x" else hits).append((start, end, weight))
        best: dict[int, float] = {}
        for start, end, weight in hits:
            if not any(a <= start and end <= b for a, b, _ in free):
                best[start] = max(best.get(start, 0.0), weight)
        return sum(best.values()), len(s.split())

    def score(self, weights: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        raw = 1 / (1 + np.exp(-np.clip(a + features(weights, words) @ np.array([b, c]), -30, 30)))
        return np.where(raw < self.cut, CUT * raw / self.cut * 0.999, CUT + (1 - CUT) * (raw - self.cut) / max(1e-12, 1 - self.cut))


def features(weights: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(weights), np.log1p(100 * weights / np.maximum(words, 1))], 1)


def _surprise(a, n, q):
    """Log-likelihood ratio of a toxic rows among n, against a share of q."""
    b = n - a
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(a > 0, a * np.log(a / (n * q)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - q))), 0)
    return np.where(a > n * q, g, 0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    rows = labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "toxic", sample)
    texts = rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("_value").alias("y"))  # copies count once

    def count(whole: pa.RecordBatch):
        tally = ({}, {})
        for batch in pieces(whole):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(_WORDS(fold(text))):
                    if 4 <= len(w) <= 30:
                        tally[y][w] = tally[y].get(w, 0) + 1
        every = sorted(tally[0].keys() | tally[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([tally[1].get(w, 0) for w in every], pa.int64()), pa.array([tally[0].get(w, 0) for w in every], pa.int64())], names=["w", "a", "b"])

    seeds = Lexicon(whole=dict.fromkeys(SEEDS, SEED_WEIGHT))
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return seeds
    words = map_arrow(texts.select("text", F.coalesce("y", F.lit(0)).alias("y")), count, "w string, a bigint, b bigint").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    beginnings = words.select(F.explode(F.array(*(F.when(F.length("w") > k, F.substring("w", 1, k)) for k in PREFIXES))).alias("p"), "a", "b").where("p is not null")
    patterns = words.select(F.concat(F.lit("w"), "w").alias("p"), "a", "b").unionAll(beginnings.select(F.concat(F.lit("p"), "p").alias("p"), "a", "b")).groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    q = n[1] / (n[0] + n[1])
    likely = patterns.where((F.col("a") >= 4) & (F.col("a") > 4 * F.col("b"))).orderBy(F.desc("a"), "b", "p").limit(MOST_CANDIDATES).toPandas()
    lexicon = _cover(texts, likely, q, math.log(patterns.count() + 1) + 3)
    for w in SEEDS:
        lexicon.whole.setdefault(w, SEED_WEIGHT)
    return _fit_curve(lexicon, texts)


def _cover(texts: DataFrame, likely: pd.DataFrame, q: float, bound: float) -> Lexicon:
    """The patterns that explain toxic rows, best first; what a chosen pattern explains supports no other.
    bound: the surprise that chance doesn't reach among all the candidates."""
    out = Lexicon()
    if not len(likely):
        return out
    known = {p: i for i, p in enumerate(likely.p)}

    def listed(whole: pa.RecordBatch):
        for batch in pieces(whole):
            got = []
            for text in batch.column(0).to_pylist():
                found = set()
                for w in set(_WORDS(fold(text))):
                    found.update(known[p] for p in ("w" + w, *("p" + w[:k] for k in PREFIXES if len(w) > k)) if p in known)
                got.append(np.array(sorted(found), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["p"])

    # at most SAMPLE rows of MOST_CANDIDATES numbers of four bytes; copies were one row before
    rows = sorted(bytes(r["p"]) for r in map_arrow(texts.where("y = 1").select("text"), listed, "p binary").collect())
    rows = [[likely.p[i] for i in np.frombuffer(r, "<i4")] for r in rows]
    at: dict[str, set[int]] = {}
    for i, found in enumerate(rows):
        for p in found:
            at.setdefault(p, set()).add(i)
    b = dict(zip(likely.p, likely.b))
    left = {p: len(x) for p, x in at.items()}
    done: set[int] = set()
    while left and len(out.whole) + len(out.prefix) < MOST_PATTERNS:
        names = list(left)
        a = np.array([left[p] for p in names], float)
        g = _surprise(a, a + np.array([b[p] for p in names]), q)
        top = g.max()
        if top < bound:
            break
        best = max((names[i] for i in np.flatnonzero(g >= top - 1e-9)), key=lambda p: (p[0] == "w", len(p), p))
        support = len(at[best])
        weight = math.log((support + 0.5) / (b[best] + 0.5)) + math.log((1 - q) / q)
        (out.whole if best[0] == "w" else out.prefix)[best[1:]] = round(weight, 4)
        new = at[best] - done
        done |= new
        lost = Counter(p for i in new for p in rows[i])
        for p, k in lost.items():
            if p in left:
                left[p] -= k
                if left[p] <= 0:
                    del left[p]
        left.pop(best, None)
    return out


def _fit_curve(lexicon: Lexicon, texts: DataFrame) -> Lexicon:
    def weigh(whole: pa.RecordBatch):
        for batch in pieces(whole):
            got = [lexicon.weigh(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["y", "w", "n"])

    rows = map_arrow(texts.select("text", F.col("y")), weigh, "y int, w double, n bigint").toPandas().sort_values(["y", "w", "n"])
    x = features(rows.w.to_numpy(), rows.n.to_numpy())
    x = np.column_stack([np.ones(len(x)), x])
    y, beta = rows.y.to_numpy(float), np.array([-3.0, 1.0, 0.5])
    ridge = np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):  # Newton's method; the ridge keeps separable rows finite
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    beta[1:] = np.maximum(beta[1:], 0.01)  # more hits never lower a score
    raw = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    none = 1 / (1 + np.exp(-beta[0]))
    cuts = np.unique(raw)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1])
    cuts = cuts[(cuts > none) & (cuts < 1)]
    if len(cuts):
        right = FALSE_COST * np.searchsorted(np.sort(raw[y == 0]), cuts) / (y == 0).sum() + 1 - np.searchsorted(np.sort(raw[y == 1]), cuts) / (y == 1).sum()
        lexicon.cut = float(np.clip(cuts[int(np.argmax(right))], 1e-6, 1 - 1e-6))
    lexicon.curve = tuple(float(v) for v in beta)
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, toxic_weight and n_words of every row; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # at most MOST_PATTERNS patterns
    kind = df.schema[id_col].dataType.simpleString()

    def run(whole: pa.RecordBatch):
        lex = shared.value
        for batch in pieces(whole):
            got = [lex.weigh(t) for t in batch.column(2).to_pylist()]
            w, n = np.array([g[0] for g in got], float), np.array([g[1] for g in got], np.int64)
            s = lex.score(w, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(w), pa.array(n)], names=[id_col, "held_out", "score", "predicted", "toxic_weight", "n_words"])

    return map_arrow(df.select(F.col(id_col), held_out(F.col(id_col)).alias("_held"), text_or_empty(text_col).alias("_text")), run, f"{id_col} {kind}, held_out boolean, score double, predicted int, toxic_weight double, n_words bigint")
