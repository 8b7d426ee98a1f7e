"""Near duplicates: exact Jaccard join of word 5-shingle sets with a count-vector R-tree.

1. A first pass counts all shingles in a sketch whose size follows the corpus (SLOTS to MOST_SLOTS counters, a byte each
   where they are sent), which gives shingles a common order: shingles of crowded slots (boilerplate, shared passages)
   last.
2. Two sets that link share at least one of the first |A| - ceil(0.8 |A|) + 1 shingles of that order (prefix filter).
   Documents with one and the same set stand as one node from here on. A shingle in at most PAIRED prefixes ties its
   nodes in pairs, and a pair is dropped if a bound on the overlap (shingle counts in hash groups, as many as the set is
   large) rules a link out: unrelated texts share a few shingles by chance, the more the larger the corpus, and would
   chain all texts into one part. For a shingle in more prefixes,
   its nodes are walked in order of set size; where the sizes of neighbours differ by more than the threshold allows,
   the walk is cut. Each node is tied to the first of its stretch: a star, so a shingle with n nodes makes n rows, not
   n * n pairs. Every link lies inside one connected part of these ties. A shingle that the sketch counts more than HOT
   times is walked in as many hash shares as it takes; the stretches of the shares (first node, least and greatest
   size) are then walked themselves, and tied where they touch.
3. Each part is joined by an R-tree. A set is the point of its shingle counts in GROUPS hash groups; a node of the tree
   keeps the largest count in each group and the smallest set size below it; the sum over groups of the smaller count
   bounds the overlap from above, for a point as for a whole node. Pairs that survive are verified on the shingles.
   Pairs that already hang together need no verification, as only the components are asked for.
4. A part of more than PART nodes is dealt out exactly: size bands (a link never skips one), each cut into tiles of
   about PART / 2 nodes by hash, and each pair of tiles is joined by an R-tree of its own, giving a spanning set of
   links; their components are the result. So a task never holds more than about PART sets, and a family of many near
   copies is many tasks. The pairs of tiles grow with the square of such a part's size within a band: that is the price
   of exactness there.

Shingles are 64-bit hashes; sets are told apart by 128 bits more. Cases: a text with fewer than five words is one
shingle of all its words; without words or text a document has no shingle and links with nothing; repeated rows and
equal sets are linked; rows with a null doc_id get n_shingles and a null component_id and join nothing; other columns
are ignored. Ids are whole numbers; a text that is none stops the job.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, join_rows, slices, stash, tokens

WORDS = 5
SLOTS = 1 << 22
MOST_SLOTS = 1 << 26
#: Bytes of text for which the sketch has one counter: about 16 shingles.
BYTES_A_SLOT = 112
#: Prefixes that a shingle may be in to tie its nodes in pairs.
PAIRED = 16
GROUPS = 128
LEAF = 32
PART = 1000
#: Sets that a task remembers having told.
TOLD = 200_000
#: Uses of a shingle that one task walks.
HOT = 20_000
#: Bits of the filter that keeps texts without a tie from being cut into shingles again.
FILTER_BITS = 1 << 23

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MIX3 = np.uint64(0x94D049BB133111EB)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for up to `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    found = tokens(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out *= _MIX
        out += h[i : n + i]
    return np.unique(_scramble(out))


def slots_of(x: np.ndarray, slots: int) -> np.ndarray:
    return (x >> np.uint64(38)).astype(np.uint32) & np.uint32(slots - 1)


def slots_for(docs: DataFrame) -> int:
    """Counters for the texts: a power of two that follows their bytes, between SLOTS and MOST_SLOTS."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = SLOTS
    while slots < MOST_SLOTS and slots * BYTES_A_SLOT < size:
        slots *= 2
    return slots


#: The greatest load of each code of a byte: exact below 128, then in steps of 15 %.
LOADS = np.array([*range(128), *(int(128 * 1.15**k) for k in range(1, 129))], np.int64)


def coded(loads: np.ndarray) -> np.ndarray:
    """Loads in one byte each; a greater load never has a smaller code."""
    return np.minimum(np.searchsorted(LOADS, loads), 255).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def shingle_loads(docs: DataFrame, words: int, slots: int | None = None) -> np.ndarray:
    """Uses of each slot over all documents (a document uses a shingle once), as codes (`LOADS`). A byte a slot.

    A task tells at most 65,535 of a slot: the numbers only order shingles, and any order that all share is exact.
    """
    many = 64
    slots = slots or slots_for(docs)
    size = slots // many

    def count(batches):
        hashes, loads, held, n = WordHashes(), np.zeros(slots, np.uint16), [], 0

        def put():
            at, uses = np.unique(np.concatenate(held), return_counts=True)
            loads[at] = np.minimum(loads[at] + uses, 65_535)

        for b in slices(batches):
            for x in b.column(0).to_pylist():
                held.append(slots_of(shingles(x, hashes, words), slots))
                n += len(held[-1])
                if n > SLOTS:
                    put()
                    held, n = [], 0
        if held:
            put()
        # low bytes, then high bytes: the latter are nearly all zero
        apart = lambda x: x.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
        for i in range(many):
            part = zlib.compress(apart(loads[i * size : (i + 1) * size]), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["slice", "loads"]
            )

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low, high = np.frombuffer(zlib.decompress(x), np.uint8).reshape(2, -1)
                got = total.setdefault(k, np.zeros(size, np.int64))
                got += low
                if high.any():
                    got += high.astype(np.int64) << 8
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int32()),
                pa.array([zlib.compress(coded(x).tobytes(), 1) for x in total.values()], pa.binary()),
            ],
            ["slice", "loads"],
        )

    rows = docs.select("text").mapInArrow(
        count, "slice int, loads binary"
    ).repartition(many, "slice").mapInArrow(add, "slice int, loads binary").collect()
    loads = np.zeros(slots, np.uint8)
    for r in rows:
        loads[r.slice * size : (r.slice + 1) * size] = np.frombuffer(zlib.decompress(r.loads), np.uint8)
    return loads


def sketches(docs: DataFrame, loads: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, n, f1, f2, prefix, hot, shares, counts): set size, two fingerprints of the set, the prefix shingles in the
    common order, those among them that are walked in several shares, and the set's shingle counts (`group_counts`).

    A task gives the prefix of a set once, so that a group of copies makes a row a task, not a row a copy.
    """
    sent = docs.sparkSession.sparkContext.broadcast(loads)
    none = np.zeros(0, np.int64)

    def run(batches):
        hashes, order, told = WordHashes(), sent.value, set()
        for b in slices(batches):
            sizes, f1, f2, prefixes, hot, shares, counts = [], [], [], [], [], [], []
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(x, hashes, words)
                sizes.append(len(s))
                f1.append(int(_scramble(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(_scramble(s * _MIX ^ _MIX3).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                mark = (f1[-1], f2[-1])
                if key is None or not len(s) or mark in told:
                    for column in (prefixes, hot, shares):
                        column.append(none)
                    counts.append(None)
                    continue
                if len(told) < TOLD:
                    told.add(mark)
                counts.append(group_counts(s).tobytes())
                p = prefix_length(len(s), percent)
                load = order[slots_of(s, len(order))]
                if p < len(s):
                    last = np.partition(load, p - 1)[p - 1]
                    take = np.flatnonzero(load < last)
                    take = np.concatenate([take, np.flatnonzero(load == last)[: p - len(take)]])
                    s, load = s[take], load[take]
                load = LOADS[load]
                many = load > HOT
                prefixes.append(s[~many].view(np.int64))
                hot.append(s[many].view(np.int64))
                shares.append(-(-load[many] // HOT))
            fixed = [b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, f1, f2))]
            lists = [_lists(x) for x in (prefixes, hot, shares)]
            yield pa.RecordBatch.from_arrays(
                [*fixed, *lists, pa.array(counts, pa.binary())],
                ["doc_id", "n", "f1", "f2", "prefix", "hot", "shares", "counts"],
            )

    kind = "doc_id long, n long, f1 long, f2 long, prefix array<long>, hot array<long>, shares array<long>, counts binary"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def group_counts(s: np.ndarray) -> np.ndarray:
    """Shingles of a set in each of 64 or more hash groups, 4 to 8 shingles a group in larger sets; 255 at most."""
    groups = 64
    while 8 * groups < len(s):
        groups *= 2
    at = ((s >> np.uint64(16)) & np.uint64(groups - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=groups), 255).astype(np.uint8)


def apart(a: bytes, b: bytes) -> int:
    """At most the number of shingles that are in one of two sets only, from their `group_counts`."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    groups = min(len(x), len(y))  # groups of more halve into those of fewer; counts above 255 stay cut
    fold = lambda z: np.minimum(z.reshape(-1, groups).sum(axis=0, dtype=np.int64), 255)
    return int(np.abs(fold(x) - fold(y)).sum())


def _uses(real: DataFrame) -> DataFrame:
    """(n, f1, shingle, uses): prefix shingles that are in several prefixes."""
    found = real.select("n", "f1", F.explode("prefix").alias("shingle"))
    return found.withColumn("uses", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("uses > 1")


def pairs(real: DataFrame, percent: int) -> DataFrame:
    """(a, b): fingerprints of nodes that share a shingle of few prefixes, unless their counts rule a link out."""
    groups = _uses(real).where(F.col("uses") <= PAIRED).groupBy("shingle").agg(
        F.array_sort(F.collect_set(F.struct("n", "f1"))).alias("x")
    )
    met = lambda u, i: F.transform(
        F.filter(F.slice("x", i + 2, PAIRED), lambda v: 100 * u["n"] >= percent * v["n"]),
        lambda v: F.struct(u["n"].alias("na"), u["f1"].alias("a"), v["n"].alias("nb"), v["f1"].alias("b")),
    )
    found = groups.where("size(x) > 1").select(F.explode(F.flatten(F.transform("x", met))).alias("p")).select("p.*")
    marks = real.where("counts IS NOT NULL").select("n", "f1", "f2", "counts").dropDuplicates(["n", "f1", "f2"])
    side = lambda k: marks.select(
        F.col("f1").alias(k), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}")
    ).hint("merge")
    # both sides grow with the corpus: a shuffle at every size
    both = found.distinct().hint("merge").join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"])

    def run(batches):
        for b in batches:
            keep = [
                (100 + percent) * apart(x, y) <= (100 - percent) * (n + m)
                for n, m, x, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)
            ]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long").distinct()


def ties(real: DataFrame, percent: int) -> DataFrame:
    """(a, b): fingerprints of nodes that share a prefix shingle of many prefixes and of the first node of their stretch.

    Ties are between first fingerprints: should two sets share one, they are tied too, which only makes a part larger.
    """
    spread = real.select("n", "f1", F.explode(F.arrays_zip("hot", "shares")).alias("z"))
    spread = spread.select(
        "n", "f1", F.col("z.hot").alias("shingle"), F.pmod(F.xxhash64("f1"), F.col("z.shares")).alias("share")
    )
    plain = _stretches(_uses(real).where(F.col("uses") > PAIRED), ["shingle"], "n", "n", percent)
    shared = _stretches(spread, ["shingle", "share"], "n", "n", percent)
    heads = shared.groupBy("shingle", "share", "first").agg(
        F.min("n").alias("n"), F.max("n").alias("high")
    ).withColumnRenamed("first", "f1")
    joined = _stretches(heads, ["shingle"], "n", "high", percent)
    found = [
        x.where("first <> f1").select(
            F.col("f1").alias("a"), F.col("first").alias("b")
        ) for x in (plain, shared, joined)
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def _stretches(rows: DataFrame, keys: list[str], low: str, high: str, percent: int) -> DataFrame:
    """Rows with `first`, the first f1 of their stretch: rows of a key in order of size, cut where the sizes before are
    too small for the next."""
    walk = Window.partitionBy(*keys).orderBy(low, "f1")
    before = F.max(high).over(walk.rowsBetween(Window.unboundedPreceding, -1))
    cut = before.isNull() | (100 * before < percent * F.col(low))
    first = F.last(
        F.when(F.col("cut"), F.col("f1")), ignorenulls=True
    ).over(walk.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cut", cut).withColumn("first", first).drop("cut")


class CountVectorTree:
    """R-tree over count vectors, bulk-loaded in order of set size and of the heaviest groups."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points.argmax(axis=1), sizes))
        self.levels = [  # members, largest counts, least and most size
            (order, points[order], sizes[order], sizes[order])
        ]
        while len(self.levels[-1][0]) > LEAF:
            _, top, low, high = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append(
                (at, np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))
            )

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Members whose bound on the overlap allows a link with this point."""
        live = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            at, top, low, high = self.levels[depth]
            low_size = np.maximum(low[live], -(-size * percent // 100))  # sizes outside can't link
            fits = (100 * high[live] >= percent * size) & (100 * size >= percent * low[live])
            live, low_size = live[fits], low_size[fits]
            bound = np.minimum(top[live], point).sum(axis=1, dtype=np.int64)
            live = live[(100 + percent) * bound >= percent * (size + low_size)]
            if depth == 0:
                return at[live]
            below = len(self.levels[depth - 1][0])
            live = (live[:, None] * LEAF + np.arange(LEAF)).ravel()
            live = live[live < below]
        return live


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), GROUPS), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> np.uint64(20)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)
    return out


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="mergesort")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def join_part(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the smallest id of those it hangs together with."""
    n = len(ids)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    points = count_vectors(sets)
    tree = CountVectorTree(points, np.array([len(s) for s in sets], np.int64))
    for i in range(n):
        for j in tree.search(points[i], len(sets[i]), percent):
            if j < i and (p := root(i)) != (q := root(j)) and links(sets[i], sets[j], percent):
                parent[max(p, q)] = min(p, q)
    least: dict[int, int] = {}
    for i in range(n):
        r = root(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[root(i)] for i in range(n)]


def join_parts(rows: DataFrame, key: list[str], percent: int, words: int) -> DataFrame:
    """Rows (key..., id, text), a key in one task: rows (id, root) with the least id of its component in the key.

    Texts travel, not sets, and packed: they are much smaller.
    """
    many = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(
        F.struct(*key).alias("key"), "id", "text"
    ).repartition(many, "key").sortWithinPartitions("key", "id")

    def run(batches):
        hashes = WordHashes()
        now, ids, sets = None, [], []

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(join_part(ids, sets, percent), pa.int64())], ["id", "root"]
            )

        for b in slices(batches):
            for k, i, x in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if k != now:
                    if ids:
                        yield done()
                    now, ids, sets = k, [], []
                ids.append(i)
                sets.append(shingles(zlib.decompress(x).decode("utf-8"), hashes, words))
        if ids:
            yield done()

    return dealt.mapInArrow(run, "id long, root long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text binary, zlib) of the wanted ids, and of a few others, which a join drops.

    A bit filter of fixed size, sent to all workers, spares most other texts the shuffle.
    """
    marks = wanted.select(
        F.expr(f"cast(pmod(xxhash64(id), {FILTER_BITS}) >> 6 as int)").alias("w"),
        F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) & 63 as int))").alias("m"),
    ).groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in marks:
        bits[r.w] = r.m
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        marked = sent.value
        for b in slices(batches):
            at = np.array(b.column(2), np.int64)
            part = b.filter(pa.array(((marked[at >> 6] >> (at & 63)) & 1).astype(bool)))
            packed = [zlib.compress(x.encode("utf-8", "replace"), 1) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "text"])

    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").alias("id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot")
    )
    return source.mapInArrow(run, "id long, text binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, words: int = WORDS, part: int = PART
) -> DataFrame:
    """One row per row of the input: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    loads = shingle_loads(docs, words)
    sketch = stash(sketches(docs, loads, words, percent), "sketch")
    real = sketch.where("n > 0 AND doc_id IS NOT NULL")
    same = ["n", "f1", "f2"]
    nodes = real.groupBy(*same).agg(F.min("doc_id").alias("id"))
    tied = components(ties(real, percent).unionByName(pairs(real, percent))).select(F.col("id").alias("f1"), "root")
    parts = stash(nodes.select("f1", "id", "n").join(tied, "f1").select("id", "root", "n").distinct(), "parts")
    repeats = _repeats(sketch)
    tasks, split = _tasks(parts, percent, part)
    # both sides grow with the corpus: a shuffle at every size
    found = texts_of(docs, parts.select("id").distinct()).hint("merge").join(tasks.hint("merge"), "id")
    found = found.dropDuplicates(["id", "text", "root", "task"]) if repeats else found
    met = stash(join_parts(found, ["root", "task"], percent, words), "joined")
    joined = met.groupBy("id").agg(F.min("root").alias("root"))
    if split is not None:
        links = met.join(split, "id", "left_semi").where("id <> root").select(
            F.col("id").alias("a"), F.col("root").alias("b")
        )
        wide = components(links).select("id", F.col("root").alias("wide"))
        joined = joined.join(wide, "id", "left").select("id", F.coalesce("wide", "root").alias("root"))
    named = stash(
        nodes.select(*same, "id").join(joined, "id", "left").select(*same, F.coalesce("root", "id").alias("component")),
        "named",
    )
    keys = ["doc_id", *same]
    out = join_rows(real.select(*keys), named, same)
    rest = sketch.where("n = 0 OR doc_id IS NULL").select(
        *keys, F.when(F.col("n") == 0, F.col("doc_id")).alias("component")
    )
    out = out.unionByName(rest)
    return _settled(
        out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), repeats
    )


def _repeats(sketch: DataFrame) -> bool:
    """Whether an id stands on several rows."""
    return bool(sketch.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())


def _settled(out: DataFrame, repeats: bool) -> DataFrame:
    """Rows that share an id belong together, whatever their texts."""
    if not repeats:
        return out
    kept = stash(out, "settled")
    ties = kept.where("component_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    roots = components(ties).select(F.col("id").alias("doc_id"), "root")
    return kept.join(roots, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("component_id").isNotNull(), F.coalesce("root", "component_id")).alias("component_id"),
    )


TASK = "struct<band:int,step:int,a:int,b:int>"


def _tasks(parts: DataFrame, percent: int, part: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, root, task): where each set is joined, and the ids whose part is split (None if there is none).

    A small part is one task (null). A larger one is cut into size bands, which a link never skips, and each band into
    tiles by hash; every pair of tiles of one band or of neighbours is a task. No text is touched here.
    """
    whole = parts.select("id", "root", F.lit(None).cast(TASK).alias("task"))
    large = parts.groupBy("root").count().where(F.col("count") > part).select("root")
    if not large.limit(1).count():
        return whole, None
    width = float(np.log(100 / percent)) * 1.0000001
    banded = parts.join(large, "root").select(
        "root", "id", F.floor(F.log("n") / F.lit(width)).cast("int").alias("band")
    )
    tiles = banded.groupBy("root", "band").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(max(1, part // 2))).cast("int").alias("tiles")
    )
    lower = tiles.select("root", (F.col("band") + 1).alias("band"), F.col("tiles").alias("below"))
    upper = tiles.select("root", (F.col("band") - 1).alias("band"), F.col("tiles").alias("above"))
    known = banded.join(tiles, ["root", "band"]).join(lower, ["root", "band"], "left").join(upper, ["root", "band"], "left").withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    )
    pair = lambda band, step, a, b: F.struct(
        band.alias("band"), F.lit(step).alias("step"), a.alias("a"), b.alias("b")
    )
    band, tile, none = F.col("band"), F.col("tile"), F.array().cast(f"array<{TASK}>")
    own = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: pair(band, 0, F.least(t, tile), F.greatest(t, tile))
    )
    up = F.when(
        F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda t: pair(band, 1, tile, t))
    )
    down = F.when(
        F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda t: pair(band - 1, 1, t, tile))
    )
    tasks = F.concat(own.cast(f"array<{TASK}>"), *[F.coalesce(x.cast(f"array<{TASK}>"), none) for x in (up, down)])
    split = stash(known.select("id", "root", F.explode(tasks).alias("task")).distinct(), "tasks")
    return whole.join(
        large, "root", "left_anti"
    ).select("id", "root", "task").unionByName(split), split.select("id").distinct()


def op5_jaccard_rtree(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
