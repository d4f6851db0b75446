"""Grouped prefix join: components of documents whose shingle sets are alike.

Two sets with Jaccard similarity s or more share a shingle among the first
n - ceil(s * n) + 1 of each in any common order; the order here puts shingles
from rarely hit hash buckets first.  Documents with the same prefix and size
form a group; groups that share a prefix shingle, and the members of one group,
are candidates.  Candidates are expanded to members and compared on whole sets.

A large set of near copies is not compared pair by pair.  Members are first held
against a few of their fellows, which joins most of them; then only pairs that
are still in different components are left.  Bits of their shingles bound what
two sets can share; pairs that pass are compared on whole sets, all of them.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlab.llm.common import shared_folder, tidy, written

#: Similarity in percent, words of a shingle.
SIMILARITY, WORDS = 80, 5
#: Hash buckets whose hits order the shingles: two bytes each, whatever the corpus.
BUCKET_BITS = 23
_SLICES = 64
#: Keys of so many sets are first thinned out, in some rounds, by so many fellows for each set.
LARGE, ROUNDS, FELLOWS = 64, 5, 4
#: All pairs are compared once large keys have so many left for each row, or a round leaves this share of them.
PAIRS, LEFT = 4, 0.9
#: Bits of a set for each shingle of the largest one in its band, and the most bits of a set, as powers of two.
SPREAD_BITS, MOST_BITS = 2, 14
#: Rows of a large key are dealt into blocks of about so many; two blocks meet in a task.
BLOCK = 512

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    """Hashes of words, each taken when it is first looked up."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: _Known, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, sorted."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(known) > 300_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
    return np.unique(out ^ (out >> np.uint64(32)))


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _buckets(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sliced(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = [zlib.compress(np.minimum(p, 65535).astype(np.uint16).tobytes(), 1) for p in np.split(total, _SLICES)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "hits"]
    )


@tidy
def _hits(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that hit each bucket, each set of the task once, in slices."""
    total, seen, known = np.zeros(1 << BUCKET_BITS, np.int32), set(), _Known()
    for batch in batches:
        for text in batch.column(0):
            x = shingles(text.as_py(), known, words)
            d = _digest(x.tobytes())
            if d not in seen:
                seen.add(d)
                total[_buckets(x)] += 1  # a set counts once in a bucket
    yield from _sliced(total)


@tidy
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices of a task; there are _SLICES slices at most."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.uint16).astype(np.int32)
            total[k] = np.minimum(total[k] + x, 65535) if k in total else x
    data = [zlib.compress(x.astype(np.uint16).tobytes(), 1) for x in total.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array(data, pa.binary())], names=["slice", "hits"]
    )


def bucket_hits(texts: DataFrame, words: int) -> np.ndarray:
    """How often each hash bucket is hit over all texts, up to 65535: an order of shingles, nothing else.

    Whatever the hits are, results are the same; rare shingles first makes fewer candidates.
    """
    rows = texts.mapInArrow(functools.partial(_hits, words), "slice int, hits binary")
    rows = rows.repartition(_SLICES, "slice").mapInArrow(_added, "slice int, hits binary")
    out = np.zeros((_SLICES, (1 << BUCKET_BITS) // _SLICES), np.uint16)
    for r in rows.toLocalIterator():
        out[r["slice"]] = np.frombuffer(zlib.decompress(bytes(r["hits"])), np.uint16)
    return out.ravel()


def prefix_length(n: int, percent: int) -> int:
    return n - math.ceil(percent * n / 100) + 1


@tidy
def _prefixes(hits, percent: int, words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: key, text. Adds set digest, size, group, and the prefix of each group's first row."""
    hits, known = hits.value, _Known()
    seen: set[bytes] = set()
    for batch in batches:
        nodes, sizes, groups, prefixes = [], [], [], []
        for text in batch.column(1):
            x = shingles(text.as_py(), known, words)
            sizes.append(len(x))
            if not len(x):
                nodes.append(None)
                groups.append(None)
                prefixes.append(None)
                continue
            order = np.lexsort((x, hits[_buckets(x)]))[: prefix_length(len(x), percent)]
            prefix = x[order]
            group = _digest(len(x).to_bytes(8, "little"), prefix.tobytes())
            nodes.append(_digest(x.tobytes()))
            groups.append(int.from_bytes(group[:8], "little", signed=True))
            prefixes.append(None if group in seen else prefix.view(np.int64))
            seen.add(group)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(groups, pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())),
            ],
            names=["k", "node", "n", "grp", "prefix"],
        )


@tidy
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix shingles of a task's groups and their places. One row of each shingle is compared across tasks.

    Shingles that two groups of the task share are settled, all their rows, so a
    shingle that a third of all groups hold is one compared row of each task.
    """
    shingle, group, place, held = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, g, p = (np.concatenate(x) for x in (shingle, group, place))
        order = np.lexsort((g, h))
        h, g, p = h[order], g[order], p[order]
        head = np.r_[True, h[1:] != h[:-1]]
        several = np.where(head, np.r_[~head[1:], False], True)
        # Of a shared shingle the head is sent to be compared, and all its rows as settled.
        at = np.r_[np.flatnonzero(head), np.flatnonzero(several)]
        settled = np.arange(len(at)) >= head.sum()
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            columns = [pa.array(x) for x in (h[part], g[part], p[part], settled[a : a + 100_000])]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "grp", "place", "settled"])

    for batch in batches:
        for g, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            p = p.values.to_numpy()
            shingle.append(p)
            group.append(np.full(len(p), g, np.int64))
            place.append(np.arange(len(p), dtype=np.int32))
            held += len(p)
        if held > 2_000_000:
            yield from flush()
            shingle, group, place, held = [], [], [], 0
    if held:
        yield from flush()


def marks(x: np.ndarray, band: int, percent: int) -> np.ndarray:
    """A set as bits at the hashes of its shingles, as many for all sets of a band."""
    power = min(max(math.ceil((band + 1) * math.log2(100 / percent)) + SPREAD_BITS, 6), MOST_BITS)
    on = np.zeros(1 << power, np.uint8)
    on[(x & np.uint64((1 << power) - 1)).astype(np.int64)] = 1
    return np.packbits(on).view(np.int64)


@tidy
def _sets(words: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: node, text, band. The set, and if a band is given its bits in this band and in the next one."""
    known, longs = _Known(), pa.list_(pa.int64())
    for batch in batches:
        sets = [shingles(t.as_py(), known, words) for t in batch.column(1)]
        bands = batch.column(2).to_pylist()
        both = list(zip(sets, bands, strict=True))
        own, up = ([None if b is None else marks(x, b + more, percent) for x, b in both] for more in (0, 1))
        columns = [pa.array(x, longs) for x in ([s.view(np.int64) for s in sets], own, up)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "s", "own", "up"])


def _close(percent: int, tile: pa.Table) -> pa.Table:
    """Pairs of two blocks of a key, of different components, that places and bits let be alike.

    A bit that only one of two sets has stands for a shingle that the other lacks.
    """
    get = {c: tile.column(c).to_pylist() for c in ("node", "comp", "bits")}
    n, place, up, block = (tile.column(c).to_numpy() for c in ("n", "place", "up", "block"))
    comps = {c: k for k, c in enumerate(sorted(set(get["comp"])))}
    comp = np.array([comps[c] for c in get["comp"]])
    # Sets of a key have the same number of bits.
    bits = np.zeros((len(n), max(len(x or ()) for x in get["bits"])), np.uint64)
    for k, x in enumerate(get["bits"]):
        bits[k, : len(x or ())] = np.array(x or (), np.int64).view(np.uint64)
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    i, j = (tile.column(c)[0].as_py() for c in ("i", "j"))
    first, second, found = np.flatnonzero(block == i), np.flatnonzero(block == j), []
    for k, a in enumerate(first):
        b = second[k + 1 :] if i == j else second
        b = b[(comp[b] != comp[a]) & ~(up[b] & up[a])]
        least = percent * (n[b] + n[a])
        fits = (100 + percent) * np.minimum(n[b] - place[b], n[a] - place[a]) >= least
        b, least = b[fits], least[fits]
        both = np.bitwise_count(bits[b] & bits[a]).sum(1, dtype=np.int64)
        b = b[(100 + percent) * (np.minimum(n[b] - ones[b], n[a] - ones[a]) + both) >= least]
        found += [(a, x) if get["node"][a] < get["node"][x] else (x, a) for x in b.tolist()]
    ends = {"a": ("node", 0), "b": ("node", 1), "ca": ("comp", 0), "cb": ("comp", 1)}
    return pa.table({x: pa.array([get[c][pair[side]] for pair in found], pa.binary()) for x, (c, side) in ends.items()})


def _key(id_col: str, text_col: str) -> Column:
    """Rows equal in id and text are one."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col))


class _Join:
    """The tables of one run, in a folder that all executors reach."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> None:
        self.spark, self.percent, self.words = docs.sparkSession, percent, words
        self.folder = shared_folder(self.spark)
        self.given = docs.select(
            F.col(id_col).alias("id"), _key(id_col, text_col).alias("k"), F.col(text_col).alias("text")
        )
        self.tables = 0

    def kept(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return written(df, self.folder, str(self.tables))

    def rows(self) -> DataFrame:
        """id, k, node, n, grp of every row, and the prefixes of groups."""
        texts = self.given.filter(F.col("text").isNotNull())
        hits = self.spark.sparkContext.broadcast(bucket_hits(texts.select("text"), self.words))
        carried = self.given.select(F.struct("id", "k").alias("k"), "text")
        schema = T.StructType(
            [
                carried.schema["k"],
                T.StructField("node", T.BinaryType()),
                T.StructField("n", T.LongType()),
                T.StructField("grp", T.LongType()),
                T.StructField("prefix", T.ArrayType(T.LongType())),
            ]
        )
        found = carried.mapInArrow(functools.partial(_prefixes, hits, self.percent, self.words), schema)
        return self.kept(found.select("k.id", "k.k", "node", "n", "grp", "prefix"))

    def candidates(self, rows: DataFrame) -> DataFrame:
        """(key, node, n, place, up): sets under one key may be alike; keys with one set are left out.

        A key is a shared shingle, or a group of several sets, with a band of
        sizes. Each set stands in its own band and, marked up, in the next one,
        so sets of sizes that can be alike meet once.
        """
        prefixes = rows.filter(F.col("prefix").isNotNull()).select("grp", "prefix")
        posts = prefixes.mapInArrow(_postings, "h long, grp long, place int, settled boolean")
        by_shingle = Window.partitionBy("h", F.when(F.col("settled"), F.col("grp")))
        posts = posts.withColumn("_same", F.min("grp").over(by_shingle) == F.max("grp").over(by_shingle))
        shared = posts.filter(F.col("settled") | ~F.col("_same")).select("h", "grp", "place").distinct()
        sets = rows.filter("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("grp").alias("grp"))
        several = sets.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 1")
        several = several.select(F.col("grp").alias("h"), "grp", F.lit(0).alias("place"))
        members = shared.unionByName(several).join(sets, "grp")
        band = self.band()
        own = F.struct(band.alias("b"), F.lit(False).alias("up"))
        both = F.explode(F.array(own, F.struct((band + 1).alias("b"), F.lit(True).alias("up"))))
        keyed = members.select(both.alias("x"), "h", "node", "n", "place")
        keyed = self.kept(keyed.select(F.xxhash64("h", "x.b").alias("key"), "node", "n", "place", "x.up"))
        return keyed.join(self.meeting(keyed), "key")

    def band(self) -> Column:
        """The band of sizes of a set of size n."""
        return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent) - 1e-9)

    @staticmethod
    def meeting(keyed: DataFrame) -> DataFrame:
        """Keys of two sets or more of which one is in its own band."""
        n, own = F.count("*").alias("c"), F.max(~F.col("up")).alias("own")
        return keyed.groupBy("key").agg(n, own).filter("c > 1 AND own").select("key")

    def sets_of(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, s, own, up): the whole set of each node, from one row that has it; bits of those marked big."""
        one = rows.filter("n > 0").groupBy("node").agg(F.min("k").alias("k"), F.min("n").alias("n")).join(nodes, "node")
        one = one.select("k", "node", F.when(F.col("big"), self.band()).alias("band"))
        texts = self.given.select("k", "text").join(one, "k").groupBy("k")
        texts = texts.agg(*[F.first(c).alias(c) for c in ("node", "text", "band")]).select("node", "text", "band")
        schema = "node binary, s array<long>, own array<long>, up array<long>"
        return texts.mapInArrow(functools.partial(_sets, self.words, self.percent), schema)

    def alike(self, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) and whether their whole sets are alike."""
        a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in ("a", "b"))
        both = pairs.join(a, "a").join(b, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - common
        linked = (100 * common >= self.percent * union).alias("linked")
        return self.kept(both.select("a", "b", "ca", "cb", linked))

    @staticmethod
    def bits_of(sets: DataFrame) -> DataFrame:
        """(node, up, bits): the bits of a set for keys of its own band and of the next one."""
        each = [F.struct(F.lit(up).alias("up"), F.col(c).alias("bits")) for up, c in ((False, "own"), (True, "up"))]
        marked = sets.filter("own IS NOT NULL").select("node", F.explode(F.array(*each)).alias("x"))
        return marked.select("node", "x.up", "x.bits")

    def components(self, rows: DataFrame) -> DataFrame:
        """(node, comp) of all nodes with candidates."""
        keyed = self.kept(self.candidates(rows))
        large = keyed.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= LARGE).select("key")
        # Rounds look at rows of large keys alone; all keys come in the last one.
        big = self.kept(keyed.join(large, "key"))
        comp = self.kept(keyed.select("node").distinct().withColumn("comp", F.col("node")))
        marked = big.select("node").distinct().withColumn("big", F.lit(True))
        nodes = comp.select("node").join(marked, "node", "left").select("node", F.coalesce("big", F.lit(False)).alias("big"))
        # Made once for all rounds, as the texts of all documents are shuffled for it.
        sets = self.kept(self.sets_of(rows, nodes))
        tried, before = None, math.inf
        for turn in range(ROUNDS + 1):
            now = big.join(comp, "node")
            sizes = self.kept(self.across(now).filter(F.col("m") >= LARGE))
            total = sizes.agg(F.sum("p").alias("p"), F.sum("m").alias("m")).first()
            # All pairs, once large keys have few left for their rows, or rounds join no more.
            few = total["p"] is None or total["p"] <= PAIRS * total["m"]
            last = turn == ROUNDS or few or total["p"] >= LEFT * before
            before = total["p"]
            if last:
                pairs = self.pairs_left(keyed.join(large, "key", "left_anti"), big, comp, self.bits_of(sets))
            else:
                pairs = self.fellows(now.join(sizes, "key"), turn)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            found = self.alike(sets, self.kept(pairs))
            links = found.filter("linked").select("ca", "cb").distinct()
            moved = connected(links, "ca", "cb", self.kept)
            new = comp.join(moved, comp["comp"] == moved["v"], "left")
            comp = self.kept(new.select("node", F.coalesce("l", "comp").alias("comp")))
            if last:
                return comp
            failed = found.filter("NOT linked").select("a", "b")
            tried = failed if tried is None else tried.unionByName(failed)
        raise AssertionError

    @staticmethod
    def across(now: DataFrame) -> DataFrame:
        """(key, m, p) of keys with several components: their rows, and the pairs of different components."""
        sizes = now.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
        sizes = sizes.agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).filter("m * m > q")
        return sizes.select("key", "m", ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("p"))

    def fits(self) -> Column:
        """Can sets that first meet at these places of their prefixes be alike?"""
        most = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
        return (100 + self.percent) * most >= self.percent * (F.col("na") + F.col("nb"))

    def fellows(self, now: DataFrame, turn: int) -> DataFrame:
        """Each set with a few sets of its fullest key, the same few for all of a key.

        One is the set that meets most others, the rest change from turn to turn.
        """
        met = now.groupBy("node").agg(F.sum("m").alias("met"), F.max(F.struct("m", "key")).alias("x"))
        now = now.join(met, "node")
        some = [F.xxhash64(F.lit(FELLOWS * turn + k), "node") for k in range(FELLOWS)]
        some = [F.struct("met", "node"), *some[1:]] if turn == 0 else some
        chosen = F.struct("node", "comp", "n")
        hubs = now.groupBy("key").agg(F.array(*[F.max_by(chosen, x) for x in some]).alias("f"))
        mine = now.filter("x.key = key").select("key", "node", "comp", "n").join(hubs, "key")
        mine = mine.select("node", "comp", "n", F.explode("f").alias("f")).filter("comp <> f.comp")
        mine = mine.filter(100 * F.least("n", "f.n") >= self.percent * F.greatest("n", "f.n"))
        first = F.col("node") < F.col("f.node")
        ends = {"a": ("node", "f.node"), "b": ("f.node", "node"), "ca": ("comp", "f.comp"), "cb": ("f.comp", "comp")}
        ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(e) for e, (x, y) in ends.items()]
        return mine.select(*ends).distinct()

    def pairs_left(self, small: DataFrame, large: DataFrame, comp: DataFrame, bits: DataFrame) -> DataFrame:
        """All pairs of different components that meet under a key and can be alike.

        Rows of large keys carry bits of their sets and meet in tiles, two blocks
        of rows each, so pairs without enough in common are never made. Small keys
        have few pairs a row.
        """

        def met(keyed: DataFrame) -> DataFrame:
            now = keyed.join(comp, "node")
            return now.join(self.across(now).select("key", "m"), "key")

        def side(df: DataFrame, x: str) -> DataFrame:
            return df.select(*[F.col(c).alias({"key": c, "node": x}.get(c, c + x)) for c in df.columns])

        now = met(small).drop("m")
        few = side(now, "a").join(side(now, "b"), "key").filter("a < b AND compa <> compb AND NOT (upa AND upb)")
        few = few.filter(self.fits()).select("a", "b", F.col("compa").alias("ca"), F.col("compb").alias("cb"))
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        rows = met(large).join(bits, ["node", "up"], "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        tiles = tiles.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        percent = self.percent
        tiles = tiles.select("key", "i", "j", "block", "node", "comp", "n", "place", "up", "bits").groupBy("key", "i", "j")
        many = tiles.applyInArrow(lambda x: _close(percent, x), "a binary, b binary, ca binary, cb binary")
        return few.unionByName(many).distinct()


def connected(edges: DataFrame, a: str, b: str, kept) -> DataFrame:
    """(v, l): each vertex of the edges and the smallest vertex it is connected with.

    Labels take the smallest of their neighbours' and then their label's label,
    until none changes; every round is written, so nothing is recomputed.
    """
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("w"))
    both = kept(both.union(both.select("w", "v")).distinct())
    label = kept(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("l")))
    while True:
        seen = both.join(label.select(F.col("v").alias("w"), F.col("l").alias("lw")), "w")
        low = seen.groupBy("v").agg(F.min("lw").alias("m")).join(label, "v")
        low = low.select("v", F.least("m", "l").alias("m"), "l")
        jump = label.select(F.col("v").alias("m"), F.col("l").alias("lm"))
        new = kept(low.join(jump, "m").select("v", F.least("m", "lm").alias("x"), "l"))
        changed = not new.filter("x <> l").isEmpty()
        label = new.select("v", F.col("x").alias("l"))
        if not changed:
            return label


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY, words: int = WORDS
) -> DataFrame:
    """(id, k, n_shingles, component_id) per row of `docs`; k is a hash of id and text.

    component_id is the smallest id a document is linked with, directly or over
    others; equal sets are linked. Null and wordless texts have no shingles and
    are linked with nothing: they keep their own id. Null ids take part, and get
    null only if no document of their component has an id. Rows repeated in full
    get a row each, alike. Other columns are not looked at; no documents give no
    rows. Shingles are compared by 64-bit hashes, whole sets by 128 bits.
    """
    join = _Join(docs, id_col, text_col, percent, words)
    rows = join.rows()
    comp = join.components(rows)
    placed = rows.select("id", "k", "node", "n").join(comp, "node", "left")
    placed = placed.withColumn("c", F.coalesce("comp", "node"))
    first = placed.filter("n > 0").groupBy("c").agg(F.min("id").alias("first"))
    out = placed.join(first, "c", "left")
    mine = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id"))
    return out.select("id", "k", F.col("n").alias("n_shingles"), mine.alias("component_id"), "c")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the smallest id."""
    found = near_components(docs, id_col, text_col, **options)
    stay = found.filter("n_shingles > 0").groupBy("c").agg(F.min(F.struct("id", "k")).alias("x")).select("x.k")
    alone = found.filter("n_shingles = 0").select("k").distinct().withColumn("alone", F.lit(True))
    stay = stay.distinct().withColumn("alone", F.lit(False)).unionByName(alone)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), _key(id_col, text_col).alias("k")).join(stay, "k")
    # Rows repeated in full share a key; one of them stays, but all of those without words.
    nth = F.row_number().over(Window.partitionBy("k").orderBy("alone"))
    return rows.withColumn("nth", nth).filter("alone OR nth = 1").select("row.*")
