"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, linked at a small Hamming distance by BK-trees.

1. A task makes the fingerprint of each whole text: XXH64 (seed 42) of every shingle of WORDS words, repeats included; a
   bit of the fingerprint is set if it is set in over half of the hashes.
2. Only distinct fingerprints are searched, each under the smallest doc_id that has it. The 64 bits are cut into `radius`
   + 1 blocks or more; two fingerprints within the radius agree in all blocks but `radius` of them, so for each choice of
   blocks that may differ there is a shard for each value of the other blocks, and every link lies inside some shard.
   More blocks make smaller but more shards; `blocks_for` takes the number that costs least, and any number gives the
   same links.
3. In each shard a BK-tree is built: the first fingerprint is the root, and a node's children are keyed by their Hamming
   distance to it. A search with distance d at a node follows only edges from d - radius to d + radius. The trees of a
   group of shards are grown and searched level by level as arrays.
4. A shard of more than SHARD fingerprints is dealt out: its members go to tiles by hash, and each pair of tiles is a
   task, with the tree of one tile searched by the fingerprints of both. A task tells a spanning set of its links, not
   all of them, so a family of many near copies makes a row a member and task.
5. Components of the links, by their smallest doc_id, go back to all rows.

The trees go to the shards' tasks by a shuffle and are not broadcast: their number grows with the corpus.

Cases: a text with fewer words than WORDS is one shingle of all its words; a text without words, an empty and a null text
have the fingerprint zero and link like any other; a null doc_id gets its fingerprint and a null component_id and links
nothing; rows that share a doc_id belong together whatever their texts; an empty table gives no rows; other columns are
ignored. Texts of any length are hashed whole, BATCH shingles at a time.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, join_rows, slices, stash, tokens

WORDS = 4
RADIUS = 4
SEED = 42
#: Shingles whose bits are counted at once.
BATCH = 1 << 16
#: Fingerprints of one shard that one task compares.
SHARD = 2000
#: Comparisons that cost as much as one more row in the shuffle (measured: 0.06 and 2.4 microseconds).
ROW = 40
#: Fingerprints whose trees are grown at once, and pairs of a search held at once.
GROUP = 20_000
PAIRS = 1 << 21


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint of a whole text; zero without words."""
    import xxhash

    found = tokens(text)
    if not found:
        return 0
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)  # one past the space after a word
    starts = np.concatenate([[0], ends[:-1]])
    n = len(found) - k + 1
    ends = ends[k - 1 :] - 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BATCH):
        spans = zip(starts[i : min(n, i + BATCH)].tolist(), ends[i : i + BATCH].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (doc_id, f): the fingerprint as a signed long."""

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            made = np.zeros(len(texts), np.uint64)
            for low, high in bounded(texts):
                for i in range(low, high):
                    made[i] = fingerprint(texts[i], words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, f long"
    )


def blocks_for(many: int, radius: int = RADIUS) -> int:
    """The number of blocks that costs least, were the fingerprints spread evenly."""

    def cost(blocks: int) -> float:
        return comb(blocks, radius) * (ROW + many / 2 ** (64 * (blocks - radius) / blocks))

    return min(range(radius + 1, radius + 5), key=cost)


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For each choice of blocks that may differ, the bits of the others, as a signed long."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    kept = [sum(whole[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in kept]


class Forest:
    """BK-trees of several shards, grown level by level. Members are numbered 0, 1, ... and lie shard by shard."""

    def __init__(self, prints: np.ndarray, shards: np.ndarray):
        self.prints = prints
        n = len(prints)
        first = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        self.root = first[np.cumsum(np.concatenate([[0], shards[1:] != shards[:-1]]))]  # of each member's tree
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[rest]
        while len(rest):  # each goes down an edge; the first of its edge becomes the node there
            d = np.bitwise_count(prints[rest] ^ prints[at]).astype(np.int64)
            _, begin, which = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            node = rest[begin]
            self.parent[node], self.edge[node] = at[begin], d[begin]
            stays = np.ones(len(rest), bool)
            stays[begin] = False
            rest, at = rest[stays], node[which][stays]
        order = np.lexsort((self.edge, self.parent))
        order = order[self.parent[order] >= 0]
        self.children, key = order, self.parent[order] * 65 + self.edge[order]
        self.key = key  # sorted: the children of a node by edge

    def search(self, asked: np.ndarray, roots: np.ndarray, before: np.ndarray, radius: int):
        """Pairs (index of a print asked, member) within the radius; each print is asked of the tree of its root.

        Only members numbered below `before` are visited: a node's children have higher numbers than the node, so a
        member that asks its own tree meets each other member once.
        """
        which, node = np.arange(len(asked)), roots
        which, node = which[node < before], node[node < before]
        while len(which):
            d = np.bitwise_count(asked[which] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            yield which[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            many = high - low
            which = np.repeat(which, many)
            step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            node = self.children[np.repeat(low, many) + step]
            lower = node < before[which]
            which, node = which[lower], node[lower]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of n members hangs together with by the links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def join_shards(prints: np.ndarray, ids: np.ndarray, shards: np.ndarray, outside: np.ndarray, radius: int) -> np.ndarray:
    """For each member the least id that it hangs together with in its shard.

    Members lie shard by shard. Those marked `outside` ask the tree of the others of their shard; where none is, all
    members ask.
    """
    root = np.arange(len(prints))
    inside = np.flatnonzero(~outside)
    if not len(inside):
        return ids
    forest = Forest(prints[inside], shards[inside])
    names, first, sizes = np.unique(shards[inside], return_index=True, return_counts=True)
    ask = np.flatnonzero((outside | ~np.isin(shards, shards[outside])) & np.isin(shards, names))
    tree = np.searchsorted(names, shards[ask])
    before = np.where(outside[ask], len(inside), np.searchsorted(inside, ask))
    took, start = np.cumsum(sizes[tree]), 0
    while start < len(ask):
        end = int(np.searchsorted(took, (took[start - 1] if start else 0) + PAIRS, "right"))
        end = max(start + 1, end)
        part = ask[start:end]
        for which, member in forest.search(prints[part], first[tree[start:end]], before[start:end], radius):
            x, y = root[part[which]], root[inside[member]]
            differ = x != y
            if differ.any():
                root = _roots(len(prints), x[differ], y[differ])[root]
        start = end
    least = np.full(len(prints), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return least[root]


def _units(nodes: DataFrame, blocks: int, radius: int, shard: int) -> DataFrame:
    """(t, key, a, b, f, id): each fingerprint in all units where it is compared; a, b the tiles of a large shard."""
    values = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(m).cast("long")).alias("key"))
            for t, m in enumerate(masks(blocks, radius))
        ]
    )
    keyed = nodes.select("f", "id", F.explode(values).alias("x")).select("x.t", "x.key", "f", "id")
    large = stash(
        keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).select(
            "t", "key", F.ceil(F.col("n") / F.lit(max(1, shard // 2))).cast("int").alias("tiles")
        ),
        "shards",
    )
    none = F.lit(0)
    if not large.limit(1).count():
        return keyed.select("t", "key", none.alias("a"), none.alias("b"), none.alias("tile"), "f", "id")
    whole = keyed.join(large, ["t", "key"], "left_anti")
    whole = whole.select("t", "key", none.alias("a"), none.alias("b"), none.alias("tile"), "f", "id")
    split = keyed.join(large, ["t", "key"]).withColumn("tile", F.pmod(F.xxhash64("f", "t"), F.col("tiles")).cast("int"))
    other = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return whole.unionByName(
        other.select(
            "t", "key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "f", "id"
        )
    )


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between ids that hold all fingerprints (f, id) within the radius together."""
    blocks = blocks or blocks_for(nodes.count(), radius)
    many = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    unit = ["t", "key", "a", "b"]
    dealt = _units(nodes, blocks, radius, shard).withColumn("outside", F.expr("a <> b AND tile = b")).select(
        *unit, "f", "id", "outside"
    ).repartition(many, *unit).sortWithinPartitions(*unit, "f")

    def told(columns):
        keys = columns[:4]
        new = np.any([x[1:] != x[:-1] for x in keys], axis=0)
        shards = np.cumsum(np.concatenate([[0], new]))
        ids = columns[5]
        least = join_shards(columns[4].view(np.uint64), ids, shards, columns[6], radius)
        link = least != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[link]), pa.array(least[link])], ["a", "b"])

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            if len(held[0]) < GROUP:
                continue
            last = [x[-1] for x in held[:4]]  # the unit that may go on in the next batch
            at = int(np.argmax(np.all([x == y for x, y in zip(held[:4], last, strict=True)], axis=0)))
            if at:
                yield told([x[:at] for x in held])
                held = [x[at:] for x in held]
        if held is not None and len(held[0]):
            yield told(held)

    return dealt.mapInArrow(run, "a long, b long")


def hexadecimal(f: str) -> Column:
    return F.lpad(F.lower(F.hex(f)), 16, "0")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    shard: int = SHARD,
    blocks: int | None = None,
) -> DataFrame:
    """One row per row of the input: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = stash(fingerprints(docs, id_col, text, words), "prints")
    real = prints.where("doc_id IS NOT NULL")
    nodes = stash(real.groupBy("f").agg(F.min("doc_id").alias("id")), "nodes")
    edges = links(nodes, radius, shard, blocks)
    again = real.groupBy("doc_id").agg(F.min("f").alias("low"), F.max("f").alias("high")).where("low <> high")
    if again.limit(1).count():  # an id on rows with different texts holds them together
        rows = real.join(again.select("doc_id"), "doc_id").distinct()
        edges = edges.unionByName(rows.join(nodes, "f").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    roots = components(edges)
    named = nodes.join(roots, "id", "left").select("f", F.coalesce("root", "id").alias("component_id"))
    out = join_rows(real, named, ["f"]).unionByName(
        prints.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")), allowMissingColumns=True
    )
    return out.select("doc_id", hexadecimal("f").alias("fingerprint"), "component_id")


def op13_bk_trees(spark, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
