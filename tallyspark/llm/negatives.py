"""Hard negatives by integer inner products, searched in an orthogonally rotated space.

Vectors become whole numbers, floor(scale * x). A rotation by the principal axes (of the uncentred second moments of a
sample of about SAMPLE rows, chosen by a hash of the id; the rotation decides only how early a pair is discarded) puts
most of a product into few components. For a block of anchors against a block of rows the products of the leading
components are added up in STEPS stages; what is left is bounded by the product of the norms of the remaining
components, plus slack for rounding. A pair whose bound misses what its anchor still looks for is discarded; the integer
products of the survivors decide.

1. Positives: for each anchor the best rows of its own label. 2. Negatives: for each anchor and positive the best rows of
other labels with a score in the band that the positive's score gives; equal scores give one band. Both are one search:
an anchor has bands (low, high) and wants the best few rows of each. Rows are dealt into groups by a hash of the id, and
each group meets all anchors, a block at a time; a group tells at most so many rows of an anchor's band as are wanted,
and a window over those picks the best. The worst of the wanted scores among the sample's rows bounds the search from
below from its start.

The anchors are a stated query set against all rows; they travel to each group by a shuffle and are not broadcast.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; a shorter vector (or an
empty one) counts as if padded with zeros; of rows that share an id the first by label and numbers stands; ties go to the
smaller id; an empty table, or one without anchors, gives no rows; other columns are ignored. Components too large for
scores to fit a long stop the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stash

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW = 50
HIGH = 95
#: Rows of the sample that gives the rotation and the first bounds.
SAMPLE = 4096
#: Shares of the sample's energy that the stages of a product reach.
STEPS = (0.5, 0.75, 0.9)
#: Rows of a group, rows of it that meet a block at once, and anchors of a block.
GROUP = 1 << 16
CHUNK = 4096
BLOCK = 512

NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def whole(rows: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, q): the rows that take part, one for each id."""
    number = lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fit = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", finite))
    made = stash(fit.select("vec_id", "label", F.transform("v", number).alias("q")), "vectors")
    if not made.groupBy("vec_id").count().where("count > 1").limit(1).count():
        return made
    one = made.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q")
    return stash(one, "vectors")


def matrix(column: pa.ListArray | pa.ChunkedArray, width: int, fill: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets, np.int64)
    flat = np.asarray(column.values, np.int64)
    sizes = np.diff(ends)
    out = np.full((len(sizes), width), fill, np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0] : ends[-1]]
    return out


class Rotation:
    """Principal axes of a sample, and where its stages end."""

    def __init__(self, sample: np.ndarray, width: int):
        x = sample.astype(np.float64)
        energy, axes = np.linalg.eigh(x.T @ x) if width else (np.zeros(0), np.zeros((0, 0)))
        self.axes = axes[:, ::-1]
        share = np.cumsum(np.maximum(energy[::-1], 0)) / max(1e-300, np.maximum(energy, 0).sum())
        self.ends = sorted({min(width, int(np.searchsorted(share, s)) + 1) for s in STEPS} | {width}) if width else [0]
        #: bounds the error of a product of `width` rotated components in single precision, times the norms
        self.slack = (width + 16) * 2.0**-22

    def turned(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Components in single precision; norms of what is left after no stage, the first, the second, ..."""
        y = q.astype(np.float64) @ self.axes
        left = np.stack([np.sqrt((y[:, d:] ** 2).sum(axis=1)) for d in [0, *self.ends[:-1]]], axis=1)
        return y.astype(np.float32), left * (1 + 1e-6)


class Rows:
    """Ids, labels and vectors of rows, also rotated."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, turn: Rotation):
        self.ids, self.labels, self.q = ids, labels, q
        self.y, self.left = turn.turned(q)

    def part(self, low: int, high: int) -> Rows:
        out = object.__new__(Rows)
        for k, v in vars(self).items():
            setattr(out, k, v[low:high])
        return out


def survivors(a: Rows, b: Rows, turn: Rotation, may: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Pairs (i, j) that `may` be and whose product can lie between low[i] and high[i], and the exact products."""
    low32 = np.maximum(low, -(2.0**100)).astype(np.float32)
    high32 = np.minimum(high, 2.0**100).astype(np.float32)
    slack = turn.slack * np.outer(a.left[:, 0], b.left[:, 0])
    sum_, begin, i, j = np.zeros(may.shape, np.float32), 0, None, None
    for step, end in enumerate(turn.ends[:-1], 1):
        if i is None:
            sum_ += a.y[:, begin:end] @ b.y[:, begin:end].T
            reach = np.outer(a.left[:, step], b.left[:, step]) + slack
            may = may & (sum_ + reach >= low32[:, None]) & (sum_ - reach <= high32[:, None])
            if np.count_nonzero(may) * 8 < may.size:  # few are left: pair by pair from here on
                i, j = np.nonzero(may)
                sum_ = sum_[i, j]
        else:
            sum_ = sum_ + np.einsum("ij,ij->i", a.y[i, begin:end], b.y[j, begin:end])
            reach = a.left[i, step] * b.left[j, step] + slack[i, j]
            stay = (sum_ + reach >= low32[i]) & (sum_ - reach <= high32[i])
            i, j, sum_ = i[stay], j[stay], sum_[stay]
        begin = end
    if i is None:
        i, j = np.nonzero(may)
    exact = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 15):
        exact[k : k + (1 << 15)] = np.einsum("ij,ij->i", a.q[i[k : k + (1 << 15)]], b.q[j[k : k + (1 << 15)]])
    return i, j, exact


class Wanted:
    """The best rows so far of each band of each anchor of a block."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most  # (anchors, bands); an absent band has low > high
        self.key = np.zeros(0, np.int64)
        self.score, self.id = self.key, self.key

    def add(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        bands = self.low.shape[1]
        keys, scores, named = [self.key], [self.score], [self.id]
        for k in range(bands):
            fits = (score >= self.low[i, k]) & (score <= self.high[i, k])
            keys.append(i[fits] * bands + k)
            scores.append(score[fits])
            named.append(ids[fits])
        key, score, named = np.concatenate(keys), np.concatenate(scores), np.concatenate(named)
        order = np.lexsort((named, ~score, key))
        key, score, named = key[order], score[order], named[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        last = rank == self.most - 1
        at = key[last]
        self.low[at // bands, at % bands] = np.maximum(self.low[at // bands, at % bands], score[last])
        keep = rank < self.most
        self.key, self.score, self.id = key[keep], score[keep], named[keep]


def best(a: Rows, base: Rows, turn: Rotation, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> Wanted:
    """The best rows of the base for each anchor and band."""
    wanted = Wanted(low.copy(), high, most)
    for k in range(0, len(base.ids), CHUNK):
        b = base.part(k, k + CHUNK)
        may = (a.labels[:, None] == b.labels) == same
        may &= a.ids[:, None] != b.ids
        i, j, exact = survivors(a, b, turn, may, wanted.low.min(axis=1), high.max(axis=1))
        wanted.add(i, b.ids[j], exact)
    return wanted


def search(
    base: DataFrame, asked: DataFrame, turn: Rotation, seeds: Rows, rows: int, bands: int, same: bool, most: int
) -> DataFrame:
    """(anchor_id, band, id, score): for each anchor and band the best `most` rows of the base.

    base: (vec_id, label, q); asked: (vec_id, label, q, low, high) with at most so many bands.
    """
    many = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(many, -(-rows // GROUP))
    width = len(turn.axes)
    sent = base.sparkSession.sparkContext.broadcast((turn, seeds))

    def rows_of(b: pa.RecordBatch) -> Rows:
        return Rows(np.asarray(b["vec_id"]), np.asarray(b["label"]), matrix(b["q"], width), sent.value[0])

    def find(b: pa.RecordBatch, base_rows: Rows) -> Wanted:
        low, high = matrix(b["low"], bands, MOST), matrix(b["high"], bands, NONE)
        return best(rows_of(b), base_rows, sent.value[0], low, high, same, most)

    def start(batches):
        """Anchors, with what each band needs at least, as the sample tells."""
        for b in slices(batches, BLOCK):
            low = pa.array(find(b, sent.value[1]).low.tolist(), pa.list_(pa.int64()))
            yield b.set_column(b.schema.get_field_index("low"), "low", low)

    def meet(batches):
        """Rows of a group, then all anchors."""
        group, held, here = None, [], None
        for b in batches:
            g, asks = np.asarray(b["g"]), np.asarray(b["asks"].to_numpy(zero_copy_only=False), bool)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if high == low:
                    continue
                part = b.slice(low, high - low)
                if g[low] != group:
                    group, held, here = g[low], [], None
                if not asks[low]:
                    held.append(part)
                    continue
                if not held and here is None:
                    continue  # an empty group
                if here is None:
                    here, held = rows_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                for block in slices([part], BLOCK):
                    got = find(block, here)
                    ids = np.asarray(block["vec_id"])[got.key // bands]
                    columns = [pa.array(ids), pa.array(got.key % bands), pa.array(got.id), pa.array(got.score)]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "band", "id", "score"])

    kind = "vec_id long, label long, q array<long>, low array<long>, high array<long>"
    ask = asked.select("vec_id", "label", "q", "low", "high").mapInArrow(start, kind)
    none = F.lit(None).cast("array<long>")
    members = base.select("vec_id", "label", "q", none.alias("low"), none.alias("high"))
    members = members.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), F.lit(False).alias("asks"), "*")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")
    dealt = members.unionByName(ask.select(every, F.lit(True).alias("asks"), "*"))
    dealt = dealt.repartition(many, "g").sortWithinPartitions("g", "asks", "vec_id")
    told = dealt.mapInArrow(meet, "anchor_id long, band long, id long, score long")
    first = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "id")
    return told.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame,
    anchor: Column | None = None,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` marks.

    A negative's score is from `low` to `high` percent of the positive's. Labels are whole numbers.
    """
    base = whole(rows.withColumn(label, F.col(label).cast("long")), id_col, vector, label, scale)
    is_anchor = F.col("vec_id") % 50 == 0 if anchor is None else anchor
    of = F.aggregate("q", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))
    count, width, most = base.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(of)).first()
    if (width or 1) * int(most or 0) ** 2 >= 2**63:
        raise ValueError("components are too large: scores do not fit a long")
    size = max(1, -(-count // SAMPLE))
    seeds = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(size)) == 0).orderBy("vec_id").toArrow()
    sample = matrix(seeds["q"], width or 0)
    turn = Rotation(sample, width or 0)
    known = Rows(np.asarray(seeds["vec_id"]), np.asarray(seeds["label"]), sample, turn)
    asked = base.where(is_anchor)
    any_score = [F.array(F.lit(x).cast("long")) for x in (NONE, MOST)]
    open_ = asked.withColumn("low", any_score[0]).withColumn("high", any_score[1])
    found = search(base, open_, turn, known, count, 1, True, positives).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    found = stash(found, "positives")
    bands = found.where("positive_score >= 0").groupBy("anchor_id").agg(
        F.sort_array(F.collect_set("positive_score")).alias("scores")  # one for each positive at most
    )
    limits = bands.select(
        F.col("anchor_id").alias("vec_id"),
        F.expr(f"transform(scores, p -> ({low}L * p + 99) div 100)").alias("low"),
        F.expr(f"transform(scores, p -> {high}L * p div 100)").alias("high"),
    )
    told = search(base, asked.join(limits, "vec_id"), turn, known, count, positives, False, negatives)
    named = bands.select("anchor_id", F.posexplode("scores").alias("band", "positive_score"))
    told = told.join(named, ["anchor_id", "band"]).select(
        "anchor_id", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return found.join(told, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11_pca_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50; labels of ids divisible by 7 are one further."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0)
