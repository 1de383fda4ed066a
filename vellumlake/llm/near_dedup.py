"""Near-duplicate components by one-permutation MinHash.

One pass hashes each text's shingles; texts with equal sets form a class. A class has one
one-permutation sketch: the hashes' top bits name a bin, the least hash stays in each bin,
empty bins copy a bin that a 2-universal rule names (optimal densification). Rows of the sketch
are banded into buckets; each bucket is a star around its least member, so it gives as many
candidate edges as it has members, however large it is. Edges are confirmed on the full sets.
Buckets with the same members count once. Where much of a bucket is outside its largest component,
further stars around other members follow, each again with as many edges as members. What is left
apart then is compared pair by pair within tasks, so no candidate pair that would join two
components stays unseen; only members that may have a link, and links that join components,
become rows, so these grow with members and not with pairs.

Components come from alternating large-star and small-star steps over the confirmed edges.
Nothing about documents is collected to the driver: it sees counts only.

Defined results: a text with fewer words than a shingle has its whole sequence as one shingle;
null and empty texts have none and are linked with nothing; rows without an id take part in
groups of equal sets only; rows that share an id count as one document; columns besides id and
text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.llm.common import discard, looked_up, map_arrow, pieces, stored, text_or_empty

BINS, BANDS, ROWS = 128, 32, 4  # a pair of similarity 0.8 shares no bucket with probability 5e-8
SIMILARITY = 80  # per cent
FEW = 2_000_000  # ids that are broadcast at most (16 MB); more are joined by a shuffle
SALTS = 256  # edges of one document that one task confirms, about
BITMAP = 32  # longs of the bitmap that bounds what two sets can share
BLOCK = 256  # members of a bucket that one task holds of each side, about
ROUNDS = 2  # of further stars, at most, before the pairs that remain are compared
PAIRS_PER_MEMBER = 4  # remaining pairs for each member of a bucket, in blocks, that are compared without further stars
MOST_BLOCKS = 16  # blocks of a bucket outside its largest component that all its members are sent to, at most
WORDS = 200_000  # entries of a worker's table of word hashes; a cache only

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_RULE = (mix(np.arange(2048 * BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64).reshape(2048, BINS)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_BAND_ODD = (mix(np.arange(1000, 1000 + BINS, dtype=np.uint64)) | np.uint64(1)).reshape(BANDS, ROWS)
_BAND_SEED = mix(np.arange(5000, 5000 + BANDS, dtype=np.uint64))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: words apart at \\x20 and \\x09-\\x0D, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=n)], np.uint64) if n else np.empty(0, np.uint64)
    table = _words
    h = np.fromiter((table[w] for w in words), np.uint64, n)
    s = h[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        s = s + h[k : n - width + 1 + k] * _ODD[k]
    return np.unique(mix(s))


def bands(h: np.ndarray) -> np.ndarray:
    """Bucket keys of a sorted, non-empty set of hashes."""
    at = np.searchsorted(h, _EDGES)
    first = h[np.minimum(at, len(h) - 1)]
    full = (at < len(h)) & (first >> np.uint64(57) == np.arange(BINS, dtype=np.uint64))
    sketch = first.copy()
    empty = np.flatnonzero(~full)
    for rule in _RULE:
        if not len(empty):
            break
        source = rule[empty]
        ok = full[source]
        sketch[empty[ok]] = first[source[ok]]
        empty = empty[~ok]
    if len(empty):
        sketch[empty] = h[0]
    return mix((sketch.reshape(BANDS, ROWS) * _BAND_ODD).sum(1, dtype=np.uint64) ^ _BAND_SEED)


def bitmap(h: np.ndarray) -> np.ndarray:
    """One bit for each hash. Two sets differ in at least as many elements as their bitmaps in bits."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[h & np.uint64(64 * BITMAP - 1)] = 1
    return np.packbits(bits).view(np.int64)


def _sketched(df: DataFrame, width: int) -> DataFrame:
    """id, n, cls (digest of the set; null: no shingles) and the bucket keys of every row."""

    def run(whole: pa.RecordBatch):
        for batch in pieces(whole):
            n, cls, keys = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, width)
                n.append(len(h))
                cls.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                keys.append(bands(h).view(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "cls", "keys"])

    return map_arrow(df.select("id", "text"), run, "id bigint, n bigint, cls binary, keys array<bigint>")


def _sets(df: DataFrame, width: int) -> DataFrame:
    def run(whole: pa.RecordBatch):
        for batch in pieces(whole, 2 << 20):
            got = [shingles(t, width) for t in batch.column(1).to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h in got], longs), pa.array([bitmap(h) for h in got], longs)], names=["id", "h", "bits"])

    return map_arrow(df.select("id", "text"), run, "id bigint, h array<bigint>, bits array<bigint>")


def _member_sets(buckets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The full sets of the members of buckets, once. They are few against all rows; up to FEW ids the texts
    need no shuffle to be found."""
    ids = buckets.select("id").distinct()
    few = ids.count() <= FEW
    wanted = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    # rows that share an id: the greatest class stands for it
    return stored(_sets(wanted, width).groupBy("id").agg(F.max(F.struct("h", "bits")).alias("x")).select("id", "x.h", "x.bits"), "sets")


def _confirmed(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough. Either end may have many edges: its set goes to as many
    salts as it has edges for."""
    salts = F.ceil(F.col("d") / SALTS).cast("int")
    many = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d")).where(F.col("d") > SALTS).select("id", "d", salts.alias("salts")), "many")
    copies = looked_up(sets.select("id", "h"), many, ["id"], F.col("id")).select("id", "h", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = edges
    for end, other in (("a", "b"), ("b", "a")):
        busy = many.select(F.col("id").alias(end), "d", "salts")
        both = looked_up(both, busy, [end], F.col(other), count="d").drop("d").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
        both = both.join(copies.select(F.col("id").alias(end), F.col("h").alias("h" + end), "salt"), [end, "salt"]).drop("salt")
    shared = both.select("a", "b", (F.size("ha") + F.size("hb")).alias("total"), F.size(F.array_intersect("ha", "hb")).alias("common"))
    out = stored(shared.where(100 * F.col("common") >= similarity * (F.col("total") - F.col("common"))).select("a", "b"), "links")
    discard(many)
    return out


def connected(links: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for each node of links (a, b) that is not its own root."""
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    state = None
    while True:
        # large star: the greater neighbours of u go to the least node around u
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lesser neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(now)
        now = new
        r = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if state == (r[0], r[1]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (r[0], r[1])


def _possible(x, y, similarity: int):
    """Whether two members can be similar enough, by their sizes and by the bits in which their bitmaps differ:
    an exact bound, so no link is lost. x, y: the columns of a name."""
    differ = F.bit_count(x("bits")[0].bitwiseXOR(y("bits")[0]))
    for k in range(1, BITMAP):
        differ = differ + F.bit_count(x("bits")[k].bitwiseXOR(y("bits")[k]))
    total = x("n") + y("n")
    # common <= (total - differ) / 2, and 100 * common >= similarity * (total - common)
    return (100 * F.least(x("n"), y("n")) >= similarity * F.greatest(x("n"), y("n"))) & ((100 + similarity) * (total - differ) >= 2 * similarity * total)


def _marked(placed: DataFrame) -> DataFrame:
    """placed (key, id, root and more) where a bucket holds more than one component: with its members m, the members r
    outside its largest component, and whether a row is of that one."""
    shares = placed.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("k"), F.sum("m").alias("m")).where("k > 1").select("key", "m", (F.col("m") - F.col("top.m")).alias("r"), F.col("top.root").alias("main"))
    shares = stored(shares, "shares")
    return looked_up(placed, shares, ["key"], F.col("id"), count="m", how="inner", bound=0).withColumn("is_main", F.col("root") == F.col("main")).drop("main")


def _apart(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with the bucket's largest component marked and
    the bitmaps of their sets. Components only grow, so the next turn's members are among this one's."""
    fields = [c for c in ("key", "id", "n", "bits") if c in members.columns]
    placed = stored(members.select(*fields).join(roots.withColumnRenamed("node", "id"), "id", "left").select(*fields, F.coalesce("root", "id").alias("root")), "placed")
    out = _marked(placed)
    out = stored(out if "bits" in fields else out.join(sets.select("id", "bits"), "id"), "apart")
    discard(placed)
    return out


def _new_stars(apart: DataFrame, turn: int, similarity: int) -> DataFrame:
    """Two more stars in each bucket: around a member of its largest component and around one of the others."""
    member = F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("h"), "id", "n", "root", "bits")
    centres = stored(apart.groupBy("key").agg(F.min(F.when(F.col("is_main"), member)).alias("c"), F.min(F.when(~F.col("is_main"), member)).alias("d"), F.max("m").alias("size")), "centres")
    spokes = looked_up(apart.select("key", F.struct("id", "n", "root", "bits").alias("x")), centres, ["key"], F.col("x.id"), count="size", how="inner", bound=0)
    here = lambda c: F.col("x." + c)

    def star(centre: str) -> DataFrame:
        there = lambda c: F.col(f"{centre}.{c}")
        return spokes.where((here("root") != there("root")) & _possible(here, there, similarity)).select(here("id").alias("a"), there("id").alias("b"))

    return star("c").unionAll(star("d"))


def _refined(apart: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The members of large buckets, dealt anew: key, m, id, n, root, bits. Of two sets that are similar enough, the
    first n - ceil(similarity * n / 100) + 1 elements of each, rarest first, share one at least; so members meet by
    each of these elements, and no pair of a bucket is lost."""
    members = stored(apart.dropDuplicates(["id"]).select("id", "n", "root", "bits"), "members")
    elements = stored(members.select("id").join(sets.select("id", "h"), "id").select("id", F.explode("h").alias("e")), "elements")
    counts = stored(elements.groupBy("e").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    rare_first = F.array_sort(F.collect_list(F.struct(F.coalesce("m", F.lit(1)).alias("m"), "e")))
    ranked = looked_up(elements, counts, ["e"], F.col("id"), count="m", bound=0).groupBy("id").agg(rare_first.alias("s"))
    n = F.size("s")
    first = F.slice("s", F.lit(1), n - F.floor((similarity * n + 99) / 100).cast("int") + 1)
    met = ranked.select("id", F.explode(F.filter(first, lambda x: x["m"] > 1)).alias("x")).select("id", F.col("x.e").alias("key"))
    sizes = stored(met.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    met = looked_up(met, sizes, ["key"], F.col("id"), count="m", how="inner", bound=0).select("key", "id")
    return _marked(stored(met.join(members, "id").select("key", "id", "n", "root", "bits"), "met"))


def _tiles(members: DataFrame, size: int) -> DataFrame:
    """members (key, id, m, r, is_main and more), dealt so that each of a bucket's r meets each of its m in one tile
    (key, i, j): of about `size` rows on the left, which are outside the largest component, and on the right."""
    fields = [c for c in members.columns if c not in ("m", "r")]
    across, down = (F.ceil(F.col(c) / size).cast("int") for c in ("m", "r"))
    block = lambda n, salt: F.pmod(F.xxhash64("key", "id", F.lit(salt)), n).cast("int")
    own = members.select("*", across.alias("across"), down.alias("down")).withColumn("oi", F.when(~F.col("is_main"), block(F.col("down"), 0))).withColumn("oj", block(F.col("across"), 1))
    left = own.where(~F.col("is_main")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).withColumn("i", F.col("oi"))
    right = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).where("is_main or i <> oi").withColumn("j", F.col("oj"))
    out = left.select("i", "j", F.lit(True).alias("l"), (F.col("j") == F.col("oj")).alias("r"), *fields).unionAll(right.select("i", "j", F.lit(False).alias("l"), F.lit(True).alias("r"), *fields))
    return out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _by_tile(tiles: DataFrame, compare, schema: str) -> DataFrame:
    """compare over the rows of each tile, as one Arrow table; it gives arrays of longs, one for each column."""
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held: pa.Table | None = None
        for batch in _and_none(batches):
            out: list = []
            if batch is not None and batch.num_rows:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is not None and held.num_rows:
                k, i, j = (held[c].to_numpy() for c in ("key", "i", "j"))
                change = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                start = 0
                for end in [*change.tolist(), *([len(k)] if batch is None else [])]:
                    out.append(compare(held.slice(start, end - start).combine_chunks()))
                    start = end
                held = held.slice(start)
            cols = (np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(len(fields)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=fields)

    return tiles.mapInArrow(run, schema)


def _longs(tile: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays of longs: their elements in one array, and where each begins and ends in it."""
    c = tile[name].combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])


def _candidates(tile: dict[str, np.ndarray], similarity: int):
    """Pairs (p, q) of rows of a tile, left and right, of two components, that sizes and bitmaps allow; some at a time.
    Two rows outside the largest component meet in two tiles and are paired in one."""
    left, right = np.flatnonzero(tile["l"]), np.flatnonzero(tile["r"])
    n, root, ids, bits = (tile[c] for c in ("n", "root", "id", "bits"))
    step = max(1, 262_144 // max(1, len(right)))
    for k in range(0, len(left), step):
        x = left[k : k + step, None]
        ok = (root[x] != root[right]) & (100 * np.minimum(n[x], n[right]) >= similarity * np.maximum(n[x], n[right]))
        p, q = np.nonzero(ok & (tile["is_main"][right] | (ids[x] < ids[right])))
        p, q = left[k + p], right[q]
        differ = np.zeros(len(p), np.int64)
        for w in range(BITMAP):
            differ += np.bitwise_count(bits[p, w] ^ bits[q, w])
        size = n[p] + n[q]
        hit = (100 + similarity) * (size - differ) >= 2 * similarity * size
        yield p[hit], q[hit]


def _columns(tile: pa.Table, *names: str) -> dict[str, np.ndarray]:
    return {c: tile[c].to_numpy() for c in names}


def _doubtful(apart: DataFrame, similarity: int) -> DataFrame:
    """The members (key, id, root, is_main, m, r) of buckets that sizes and bitmaps allow a link to another component:
    a row for each member, never for a pair. Buckets that are left with the same members are compared once."""

    def compare(table: pa.Table):
        tile = _columns(table, "key", "l", "r", "is_main", "id", "n", "root")
        tile["bits"] = _longs(table, "bits")[0].reshape(-1, BITMAP)  # unsigned: counts of signed numbers drop the sign
        met = np.zeros(len(tile["id"]), bool)
        for p, q in _candidates(tile, similarity):
            met[p] = met[q] = True
        return tuple(tile[c][met].astype(np.int64) for c in ("key", "id", "root", "is_main"))

    found = _by_tile(_tiles(apart, BLOCK), compare, "key bigint, id bigint, root bigint, main bigint").distinct()
    found = stored(found, "doubtful")
    kept = _once(found.groupBy("key").agg(F.count("*").alias("m"), F.sum(1 - F.col("main")).alias("r"), *_signature()), "m", "r")
    return looked_up(found, kept, ["key"], F.col("id"), count="m", how="inner", bound=0).withColumn("is_main", F.col("main") == 1).drop("main")


def _joined(doubtful: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between the roots of components, from the full sets: of each tile only those that join two
    components that its earlier links have not joined, so fewer than it has rows."""

    def compare(table: pa.Table):
        tile = _columns(table, "l", "r", "is_main", "id", "root")
        h, at = _longs(table, "h")
        n = tile["n"] = np.diff(at)
        tile["bits"] = np.stack([bitmap(h[at[k] : at[k + 1]]) for k in range(len(n))]).view(np.uint64)
        names, node = np.unique(tile["root"], return_inverse=True)
        top, out = np.arange(len(names)), []  # of each component, the one that it is part of now
        codes = shared = None
        for p, q in _candidates(tile, similarity):
            for x in np.unique(p).tolist():
                others = q[p == x]
                while len(others := others[top[node[others]] != top[node[x]]]):
                    if codes is None:
                        codes = np.unique(h, return_inverse=True)[1]
                        shared = np.zeros(codes.max() + 1, np.int64)
                    some, others = others[:32], others[32:]
                    shared[codes[at[x] : at[x + 1]]] = 1
                    common = np.array([shared[codes[at[y] : at[y + 1]]].sum() for y in some.tolist()])
                    shared[codes[at[x] : at[x + 1]]] = 0
                    for y in some[100 * common >= similarity * (n[x] + n[some] - common)].tolist():
                        if top[node[x]] != top[node[y]]:
                            out.append((tile["root"][x], tile["root"][y]))
                            top[top == top[node[y]]] = top[node[x]]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return a, b

    tiles = _tiles(doubtful.join(sets.select("id", "h"), "id"), max(1, BLOCK // 4))
    return stored(_by_tile(tiles, compare, "a bigint, b bigint").distinct(), "joined")


def _rest_links(apart: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links that join all components that a pair of some bucket links. Every pair of a bucket that lies in two components
    is compared in a task, and only members and joining links become rows. Members of buckets with many blocks outside
    the largest component meet by their rarest elements instead."""
    large = F.col("r") > MOST_BLOCKS * BLOCK
    if not apart.where(large).isEmpty():
        fields = ["key", "id", "n", "root", "bits", "m", "r", "is_main"]
        apart = apart.where(~large).select(*fields).unionAll(stored(_refined(apart.where(large), sets, similarity).select(*fields), "refined"))
    return _joined(_doubtful(apart, similarity), sets, similarity)


def _signature() -> list:
    """Aggregates of id that tell sets of members apart, 128 bits."""
    return [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(c) for k, c in enumerate(("s0", "s1"))]


def _once(buckets: DataFrame, *what: str) -> DataFrame:
    """key and the columns `what` of one of the buckets that have the same members."""
    first = buckets.groupBy("s0", "s1", *what).agg(F.min("key").alias("key"))
    return stored(first.select("key", *what), "once")


def _and_none(batches):
    yield from batches
    yield None


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable) and kept, of every row."""
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    rows = stored(_sketched(docs, width), "sketches")
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "classes")
    spread = classes.where("id is not null").select("id", "n", F.explode("keys").alias("key"))
    stars = spread.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("m"), *_signature()).where("m > 1").select("key", F.col("c.id").alias("c"), F.col("c.n").alias("cn"), "m", "s0", "s1")
    stars = _once(stars, "c", "cn", "m")
    buckets = stored(looked_up(spread, stars, ["key"], F.col("id"), count="m", how="inner", bound=0).select("key", "id", "n", "c", "cn", "m"), "buckets")
    discard(stars)
    near = lambda x, y: 100 * F.least(x, y) >= similarity * F.greatest(x, y)
    edges = stored(buckets.where("id <> c").where(near(F.col("n"), F.col("cn"))).select(F.col("id").alias("a"), F.col("c").alias("b")).distinct(), "edges")
    sets = _member_sets(buckets, docs, width)
    links = _confirmed(edges, sets, similarity)
    roots = connected(links)

    # what the stars left apart: more stars around other members where that is much, then the pairs that remain
    tested, worth, apart = [edges], True, buckets.where("m > 2")  # the star of two is their pair
    for turn in range(ROUNDS + 1):
        before, apart = apart, _apart(apart, roots, sets)
        discard(before)
        spare = apart.groupBy("key").agg(F.count("*").alias("m"), F.count_if(~F.col("is_main")).alias("r")).agg(F.sum(F.col("m") * F.col("r")), F.sum("m")).first()
        if turn == ROUNDS or not worth or (spare[0] or 0) <= PAIRS_PER_MEMBER * BLOCK * (spare[1] or 0):
            break
        known = tested[0]
        for t in tested[1:]:
            known = known.unionAll(t)
        pairs = _new_stars(apart, turn, similarity).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        more = stored(pairs.join(known, ["a", "b"], "left_anti"), "edges")
        found, asked = 0, more.count()
        if asked:
            late = _confirmed(more, sets, similarity)
            found = late.count()
            if found:
                links, old = links.unionAll(late), roots
                roots = connected(links)
                discard(old)
        worth = 20 * found > asked and found >= 50
        tested.append(more)
    joined = _rest_links(apart, sets, similarity)
    for t in (apart, buckets, sets, *tested):
        discard(t)
    if not joined.isEmpty():
        over = connected(joined)  # of roots, and of members that were alone
        higher = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
        roots = stored(higher.unionAll(over.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")

    heads = stored(classes.select("cls", "copies", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("cls", "copies", F.coalesce("root", "id").alias("component")), "heads")
    out = looked_up(rows.select("id", "n", "cls"), heads, ["cls"], F.col("id"), count="copies", bound=0)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
