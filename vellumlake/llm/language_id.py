"""Language identification by Bayesian evidence fusion.

Evidence: the words and letters of the text (naive Bayes, tempered for long texts), the
language that markup declares, the address suffix (a country's top domain or a path segment
such as /fr/), and the host. What declared and suffix values mean is a smoothed confusion
table; a host's prior is shrunk toward its domain's, and that toward the global one. Tables and
priors are grouped sums of the text posteriors over all rows, a row's own share taken out of
its host's.

The word model is learned from at most SAMPLE different documents with a language column, those
with the least hashes, so it doesn't depend on the order of rows; it has every language and
every letter of the sample, and as many words as CELLS allows.

Defined results: null and empty texts have no text evidence; a missing declaration, suffix or
host is no evidence; declared values count by their primary subtag in lower case; without
training rows there is no language and nothing is found; of equally likely languages the first
by name is given; repeated rows are alike, and copies count once in the sample; other columns
are not looked at; work on a text is linear in its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.llm.common import looked_up, map_arrow, pieces, stored

SAMPLE = 8_000  # documents that the word model is learned from, at most
WORDS = 20_000  # words of the model, at most
CELLS = 4_000_000  # numbers of the word table, at most: with more than 200 languages it has fewer words
TEMPER = 40.0  # words beyond so many count as so many: neighbouring words aren't independent
SMOOTH_HOST, SMOOTH_DOMAIN = 8.0, 20.0

_ENTITY = re.compile(r"&[a-zA-Z]+;|&#\d+;")
_HIDDEN = {name: (re.compile(rf"<{name}\b", re.I), re.compile(rf"</{name}\s*>", re.I)) for name in ("script", "style")}
_LANG = r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})"
_META = r"(?i)<meta\b[^<>]*>"
_META_LANG, _META_VALUE = r"(?i)http-equiv\s*=\s*[\"']?content-language\b", r"(?i)\bcontent\s*=\s*[\"']?([A-Za-z]{2,3})"


@dataclass(frozen=True)
class WordModel:
    languages: tuple[str, ...]
    words: dict[bytes, int]
    table: np.ndarray  # words x languages: log P(word | language)
    letters: tuple[str, ...]
    letter_table: np.ndarray

    @cached_property
    def codes(self) -> np.ndarray:
        return np.array([ord(c) for c in self.letters], np.uint32)

    def likelihood(self, text: str) -> np.ndarray:
        """log P(text | language), tempered, up to a constant."""
        low = text.lower()
        known = [i for i in map(self.words.get, low.encode("utf-8", "surrogatepass").split()) if i is not None]
        out = np.zeros(len(self.languages))
        if known:
            n = len(known)
            out += np.bincount(known, minlength=len(self.table)) @ self.table / max(1.0, n / TEMPER)
        if self.letters and not low.isascii():
            codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
            at = np.searchsorted(self.codes, codes := codes[codes > 127])
            at, counts = np.unique(at[self.codes.take(at, mode="clip") == codes], return_counts=True)
            if len(at):
                out += counts @ self.letter_table[at] / max(1.0, counts.sum() / TEMPER)
        return out


def plain(html: str) -> str:
    """Text without tags, comments, scripts and styles. One pass; what never ends is looked for once only."""
    out, at, missing = [], 0, set()

    def after(key, find) -> int:
        """Where something ends that begins at the tag; -1 if it doesn't. Beyond this place it won't later either."""
        if key in missing:
            return -1
        end = find()
        if end < 0:
            missing.add(key)
        return end

    while True:
        tag = html.find("<", at)
        if tag < 0:
            break
        out.append(html[at:tag])
        end = -1
        if html.startswith("<!--", tag):
            end = after("-->", lambda: html.find("-->", tag + 4))  # noqa: B023
            end = end + 3 if end >= 0 else -1
        else:
            for name, (begin, close) in _HIDDEN.items():
                if begin.match(html, tag):
                    start = after(">", lambda: html.find(">", tag))  # noqa: B023
                    m = [None]

                    def search(close=close, start=start, m=m):
                        m[0] = close.search(html, start + 1)
                        return m[0].end() if m[0] else -1

                    end = after(name, search) if start >= 0 else -1
                    break
        if end < 0:
            end = after(">", lambda: html.find(">", tag))  # noqa: B023
            end = end + 1 if end >= 0 else -1
        if end < 0:  # nothing ends any more: the rest is text
            at = tag
            break
        out.append(" ")
        at = end
    out.append(html[at:])
    return _ENTITY.sub(" ", "".join(out))


def learn(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> WordModel:
    """From at most `sample` different rows (text, lang), the least by a hash of both."""
    rows = docs.where("lang is not null and text is not null").select("text", F.lower(F.split("lang", "[-_]")[0]).alias("lang"))
    few = _least(rows, sample)
    counted = stored(few.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n")), "words")
    langs = tuple(sorted(r[0] for r in counted.select("lang").distinct().collect()))  # no more than sample rows have
    if not langs:
        return WordModel((), {}, np.zeros((0, 0)), (), np.zeros((0, 0)))
    top = counted.groupBy("w").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "w").limit(max(1, min(words, CELLS // len(langs))))
    got = counted.join(F.broadcast(top.select("w")), "w").toPandas().sort_values(["w", "lang"])  # at most CELLS rows
    vocabulary = {w: i for i, w in enumerate(sorted(set(got.w)))}
    table = np.full((len(vocabulary), len(langs)), 0.5)
    np.add.at(table, (got.w.map(vocabulary).to_numpy(), got.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()), got.n.to_numpy(float))
    table = np.log(table / table.sum(0))
    letters: dict[str, np.ndarray] = {}
    number = {x: i for i, x in enumerate(langs)}
    # of all words, also of those beyond the model: at most the letters of Unicode
    seen = counted.select("lang", "n", F.explode(F.split("w", "")).alias("c")).where(F.col("c").rlike(r"[^\x00-\x7F]"))
    for lang, c, n in seen.groupBy("lang", "c").agg(F.sum("n").alias("n")).collect():
        if c.isalpha():
            letters.setdefault(c, np.full(len(langs), 0.5))[number[lang]] += n
    names = tuple(sorted(letters))
    matrix = np.array([letters[c] for c in names]) if names else np.zeros((0, len(langs)))
    if names:
        matrix = np.log(matrix / (matrix.sum(1, keepdims=True)))  # P(language | letter): rare letters don't dominate
    return WordModel(langs, {w.encode("utf-8", "surrogatepass"): i for w, i in vocabulary.items()}, table, names, matrix)


def _least(rows: DataFrame, sample: int) -> DataFrame:
    """At most `sample` different rows, those with the least hashes: the same ones in whatever order rows come. The
    hashes alone are ranked, among a share that holds enough of them."""
    hashed = rows.select(F.xxhash64("text", "lang").alias("h"))
    n, share = hashed.agg(F.approx_count_distinct("h")).first()[0], 1.5
    while True:
        part = share * sample / max(1, n)
        low = hashed if part >= 1 else hashed.where(F.col("h") <= F.lit(int(part * 2**64) - 2**63))
        found = low.distinct().orderBy("h").limit(sample).agg(F.count("*").alias("n"), F.max("h").alias("h")).first()
        if part >= 1 or found["n"] == sample:
            break
        share *= 8
    if not found["n"]:
        return rows.limit(0)
    return rows.withColumn("h", F.xxhash64("text", "lang")).where(F.col("h") <= F.lit(found["h"])).groupBy("h").agg(F.min(F.struct("text", "lang")).alias("x")).select("x.*")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels; "" for a single one."""
    return F.when(host.isNull() | host.rlike(r"[^.]\.[^.]"), F.substring_index(host, ".", -2)).otherwise("")


def suffix_of(url: Column) -> Column:
    """A path segment or leading label that looks like a language, else the top domain."""
    segment = F.regexp_extract(url, r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?=[/?#]|$)", 1)
    top = F.regexp_extract(host_of(url), r"\.([a-z]{2,})$", 1)
    return F.lower(F.when(segment != "", F.concat(F.lit("/"), segment)).when(top != "", F.concat(F.lit("."), top)))


def evidence(docs: DataFrame, pages: DataFrame | None, model: WordModel) -> DataFrame:
    """kind, doc_id, page_id, host, domain, declared, suffix and the text's log-likelihoods, for every row."""
    null = F.lit(None)
    d = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("bigint").alias("doc_id"), null.cast("bigint").alias("page_id"), F.col("source").alias("host"), null.cast("string").alias("domain"), null.cast("string").alias("declared"), null.cast("string").alias("suffix"), F.col("text").alias("raw"))
    if pages is not None:
        meta = F.filter(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda t: t.rlike(_META_LANG) & t.rlike(_META_VALUE))
        declared = F.lower(F.coalesce(F.nullif(F.regexp_extract("html", _LANG, 1), F.lit("")), F.regexp_extract(F.try_element_at(meta, F.lit(1)), _META_VALUE, 1)))
        host = F.nullif(host_of(F.col("url")), F.lit(""))
        p = pages.select(F.lit("page").alias("kind"), null.cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), domain_of(host).alias("domain"), declared.alias("declared"), suffix_of(F.col("url")).alias("suffix"), F.col("html").alias("raw"))
        d = d.unionAll(p)
    shared = d.sparkSession.sparkContext.broadcast(model)  # at most WORDS x LANGUAGES numbers

    def run(whole: pa.RecordBatch):
        m = shared.value
        for batch in pieces(whole):
            got = [m.likelihood(plain(t) if k == "page" else t) if t else np.zeros(len(m.languages)) for k, t in zip(batch.column(0).to_pylist(), batch.column(7).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(got, pa.list_(pa.float64()))], names=[*batch.schema.names[:7], "text_ll"])

    return map_arrow(d, run, "kind string, doc_id bigint, page_id bigint, host string, domain string, declared string, suffix string, text_ll array<double>")


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Counts, as `rows`, and sums of the text posteriors by keys, as s0, s1, ... : partial sums before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(n)))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return looked_up(rows, table, keys, F.xxhash64("doc_id", "page_id"), count="rows").drop("rows")


def fused(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """evidence() with lang, confidence and the part that each kind of evidence had in it."""
    n = len(languages)
    if not n:
        return rows.select("kind", "doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "declared", "suffix", F.lit(None).cast("string").alias("text_lang"))
    rows = stored(rows, "evidence")
    top = F.array_max("text_ll")
    e = F.transform("text_ll", lambda x: F.exp(x - top))
    with_e = rows.withColumn("e", e).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    post = with_e.withColumn("post", F.transform("e", lambda x: x / F.col("z"))).drop("e", "z")
    g = post.agg(*(F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(n))).first()
    total = sum((g[i] or 0.0) for i in range(n))
    prior = [((g[i] or 0.0) + 1.0) / (total + n) for i in range(n)]

    def logs(table: DataFrame, key: str, strength: float = 2.0) -> DataFrame:
        """key -> log P(key | language) up to a constant, smoothed toward telling nothing."""
        s = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
        return table.select(key, "rows", F.array(*(F.log((F.col(f"s{i}") + strength * prior[i]) / (s + strength) / prior[i]) for i in range(n))).alias(f"{key}_ll"))

    declared = stored(logs(_sums(post.where("declared is not null"), ["declared"], n), "declared"), "declared")
    suffix = stored(logs(_sums(post.where("suffix is not null"), ["suffix"], n), "suffix"), "suffix")
    # hosts shrink toward their domains, domains toward the whole
    domains = _sums(post.where("domain is not null"), ["domain"], n)
    d_total = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    domains = stored(domains.select("domain", "rows", F.array(*((F.col(f"s{i}") + SMOOTH_DOMAIN * prior[i]) / (d_total + SMOOTH_DOMAIN) for i in range(n))).alias("d_prior")), "domains")
    hosts = stored(_sums(post.where("host is not null"), ["kind", "host"], n).select("kind", "host", "rows", F.array(*(F.col(f"s{i}") for i in range(n))).alias("h")), "hosts")
    out = _joined(_joined(_joined(_joined(post, declared, ["declared"]), suffix, ["suffix"]), domains, ["domain"]), hosts, ["kind", "host"])
    base = F.coalesce("d_prior", F.array(*(F.lit(p) for p in prior)))
    own = F.greatest(F.aggregate("h", F.lit(0.0), lambda a, b: a + b) - 1.0, F.lit(0.0))
    host = [F.log((F.greatest(F.coalesce(F.col("h")[i], F.lit(0.0)) - F.when(F.col("h").isNotNull(), F.col("post")[i]).otherwise(0.0), F.lit(0.0)) + SMOOTH_HOST * F.col("base")[i]) / (F.coalesce(F.col("own"), F.lit(0.0)) + SMOOTH_HOST)) for i in range(n)]
    out = out.withColumns({"base": base, "own": own})
    total_ll = F.array(*(F.col("text_ll")[i] - F.array_max("text_ll") + F.coalesce(F.col("declared_ll")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_ll")[i], F.lit(0.0)) + host[i] for i in range(n)))
    out = out.withColumn("ll", total_ll).withColumn("top", F.array_max("ll"))
    names = F.array(*(F.lit(x) for x in languages))
    z = F.aggregate(F.transform("ll", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    best = F.element_at(names, F.array_position("ll", F.col("top")).cast("int"))
    said = F.when(F.array_max("text_ll") > F.array_min("text_ll"), F.element_at(names, F.array_position("text_ll", F.array_max("text_ll")).cast("int")))
    return out.select("kind", "doc_id", "page_id", best.alias("lang"), (1 / z).alias("confidence"), "declared", "suffix", said.alias("text_lang"))
