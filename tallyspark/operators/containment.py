"""Which of many names stand in which texts: a bounded share of names and texts to a task, sought by their rarest bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.scratch import stash

#: Characters of names that one task holds at a time, and of texts that it reads with them.
NAMES = 16_000_000
TEXTS = 64_000_000
#: Characters of names that travel in one row.
BLOCK = 500_000
#: A share of texts has at least so many characters, and so many times those of the names that travel with it.
LEAST, RATIO = 250_000, 4
#: Bytes of texts that are looked at together, and pairs of place and name.
WINDOW, PAIRS = 1 << 20, 1 << 20
#: Sizes of seeds in bytes. A name has a seed of the largest size that fits.
SEEDS = (8, 4, 2, 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more: the end). No text is null."""
    kind, places = ("i8", pa.large_string()) if pa.types.is_large_string(texts.type) else ("i4", pa.string())
    _, offsets, data = texts.cast(places).buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    held = np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")
    return held[at[0] : at[-1]], at - at[0]


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The bytes at each place and the next ones, `size` in all, as one number: a view."""
    return np.ndarray(max(0, len(data) - size + 1), f"<u{size}", np.ascontiguousarray(data), strides=(1,))


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * _ODD) >> np.uint64(64 - bits)).astype("i8")


class _Seeded:
    """Names of one size of seeds, by the seed of each: of its bytes the stretch that `sample` has least often."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, size: int, sample: np.ndarray):
        self.size, self.names = size, _grams(data, size)
        seen = np.bincount(_slots(_grams(sample, size).astype("u8"), 20), minlength=1 << 20)
        many = sizes[ids] - size + 1
        firsts = np.cumsum(many) - many
        places = np.repeat(starts[ids] - firsts, many) + np.arange(many.sum())
        often = seen[_slots(self.names[places].astype("u8"), 20)]
        best = np.minimum.reduceat((often << 32) | places, firsts) & 0xFFFFFFFF
        seeds = self.names[best].astype("u8")
        order = np.argsort(seeds, kind="stable")
        self.ids, self.starts, self.sizes = ids[order], starts[ids][order], sizes[ids][order]
        self.before = (best - starts[ids])[order]
        self.seeds, self.first, self.many = np.unique(seeds[order], return_index=True, return_counts=True)
        self.bits = min(26, max(12, int(len(self.seeds) * 16).bit_length()))
        self.known = np.zeros(1 << self.bits, bool)
        self.known[_slots(self.seeds, self.bits)] = True

    def find(self, data: np.ndarray, ends: np.ndarray):
        """(place of the text, id of the name) of each occurrence, in parts. ends: where texts begin, and the end."""
        grams = _grams(data, self.size).astype("u8")
        at = np.flatnonzero(self.known[_slots(grams, self.bits)])
        k = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        same = self.seeds[k] == grams[at]
        at, k = at[same], k[same]
        text = np.searchsorted(ends, at, "right") - 1
        total = np.cumsum(self.many[k])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
            many = self.many[k[lo:hi]]
            name = np.repeat(self.first[k[lo:hi]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            t, start = np.repeat(text[lo:hi], many), np.repeat(at[lo:hi], many) - self.before[name]
            fits = (start >= ends[t]) & (start + self.sizes[name] <= ends[t + 1])
            name, t, start = name[fits], t[fits], start[fits]
            step = 0
            while len(name):  # piece by piece, the last one at the name's end
                j = np.minimum(step, self.sizes[name] - self.size)
                equal = grams[start + j] == self.names[self.starts[name] + j]
                done = equal & (step + self.size >= self.sizes[name])
                if done.any():
                    yield t[done], self.ids[name[done]]
                equal &= ~done
                name, t, start = name[equal], t[equal], start[equal]
                step += self.size
            lo = hi


def _finders(names: pa.Array, sample: np.ndarray) -> list[_Seeded]:
    data, at = _bytes(names)
    sizes, level = np.diff(at), np.zeros(len(names), int)
    for size in SEEDS:
        level[(level == 0) & (sizes >= size)] = size
    ids = {size: np.flatnonzero(level == size) for size in SEEDS}
    return [_Seeded(data, at[:-1], sizes, ids[size], size, sample) for size in SEEDS if len(ids[size])]


def _found(batches):
    """(number of the share, its names, rows, places of rows, places of names): each pair of row and name once, in parts."""
    share, now, blocks, names, finders = 0, None, [], None, None
    for b in batches:
        key = b.column(0).to_pylist()
        cuts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
        for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
            if key[lo] != now:
                share, now, blocks, finders = share + 1, key[lo], [], None
            part = b.slice(lo, hi - lo)
            told = part.filter(part.column(1).is_valid())
            if told.num_rows:
                blocks.append(told.column(1).flatten())
            rows = part.filter(part.column(2).is_valid())
            if not rows.num_rows or not blocks:
                continue
            data, at = _bytes(rows.column(2))
            row = rows.column(3)
            if finders is None:
                names = pa.concat_arrays(blocks)
                finders = _finders(names, data[: 4 * WINDOW])
            i = 0
            while i < rows.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + WINDOW, "right")) - 1)
                for f in finders:
                    before = np.empty(0, "i8")
                    for t, n in f.find(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                        pairs = np.setdiff1d((t + i) * len(names) + n, before)
                        before = np.union1d(before, pairs)
                        yield share, names, row, *np.divmod(pairs, len(names))
                i = j


def _dealt(
    names: DataFrame, name: str, texts: DataFrame, text: str, row: list[str], on: list[str], most_names: int, most_texts: int
) -> DataFrame:
    """_key, _names, _text, _row: blocks of names, then the texts that they are sought in, for each share of a key `on`."""
    many = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = min(BLOCK, most_names)
    names = names.select(*on, F.col(name).alias("_name")).where("_name <> ''").distinct()
    rows = texts.where(F.col(text).isNotNull()).select(*on, F.struct(*row).alias("_row"), F.col(text).alias("_text"))
    length = lambda of: F.sum(F.length(of) + 1)
    at_least = F.least(F.lit(most_texts), F.greatest(F.lit(LEAST), RATIO * F.least("_n", F.lit(most_names))))
    dealt = names.groupBy(*on).agg(length("_name").alias("_n")).join(
        rows.groupBy(*on).agg(length("_text").alias("_t")), on
    ).select(
        *on,
        F.ceil(F.col("_n") / block).cast("int").alias("_blocks"),
        F.ceil(F.col("_n") / most_names).cast("int").alias("_parts"),
        F.ceil(F.col("_t") / at_least).cast("int").alias("_shares"),
    )
    dealt = stash(dealt, "shares")  # of known size: Spark sends a small one to the texts, not the texts to it
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = F.pmod(F.xxhash64("_name"), F.col("_blocks"))
    names = names.join(dealt, on).select(
        *on, one.alias("_b"), F.floor(one * F.col("_parts") / F.col("_blocks")).cast("int").alias("_a"), "_shares", "_name"
    )
    names = names.groupBy(*on, "_a", "_b", "_shares").agg(F.collect_list("_name").alias("_names"))
    names = names.select(*on, "_a", each("_shares").alias("_s"), "_names")
    share = F.pmod(F.xxhash64("_text", "_row"), F.col("_shares")).cast("int")
    rows = rows.join(dealt, on).withColumn("_s", share).select(*on, each("_parts").alias("_a"), "_s", "_text", "_row")
    both = names.unionByName(rows, allowMissingColumns=True)
    both = both.select(F.struct(*on, "_a", "_s").alias("_key"), "_names", "_text", "_row")
    return both.repartition(many, "_key").sortWithinPartitions("_key", F.col("_text").isNotNull())


def contained(
    names: DataFrame, name: str, texts: DataFrame, text: str, on: list[str], most_names: int = NAMES, most_texts: int = TEXTS
) -> DataFrame:
    """Names x texts with equal keys `on` where the text holds the name: the distinct names of the key with every column
    of the text's row but the text itself.

    The names and the texts of a key are dealt by hash into shares of a bounded size; a task reads each of its texts once,
    whatever the number of names. So names x texts are never paired: time follows the characters of the texts for each
    share of names, and what is found. Null or empty names and null texts find nothing.
    """
    dealt = _dealt(names, name, texts, text, [c for c in texts.columns if c != text], on, most_names, most_texts)

    def run(batches):
        for _, known, row, t, n in _found(batches):
            for k in range(0, len(t), 10_000):
                pair = pa.array(n[k : k + 10_000]), pa.array(t[k : k + 10_000])
                yield pa.RecordBatch.from_arrays([known.take(pair[0]), row.take(pair[1])], ["_name", "_row"])

    kind = dealt.select(F.lit("").alias("_name"), "_row").schema
    return dealt.mapInArrow(run, kind).select(F.col("_name").alias(name), "_row.*")


def first_and_last(
    names: DataFrame,
    name: str,
    texts: DataFrame,
    text: str,
    on: list[str],
    by: list[str],
    order: str,
    most_names: int = NAMES,
    most_texts: int = TEXTS,
) -> DataFrame:
    """For each distinct name of a key `on` and values of `by`: `first` and `last`, the least and greatest `order` (a whole
    number) of the texts that hold the name; no row where none does, nulls where none has an order.

    As `contained`, but a task keeps two numbers a name and values of `by`, not a row for each text that holds the name.
    """
    whole = F.col(order).cast("long").alias("_order")
    dealt = _dealt(names, name, texts.select("*", whole), text, [*on, *by, "_order"], on, most_names, most_texts)
    low, high = np.iinfo("i8").max, np.iinfo("i8").min

    def run(batches):
        def told():
            for one, seen, first, last in kept.values():
                n = np.flatnonzero(seen)
                for k in range(0, len(n), 10_000):
                    at = n[k : k + 10_000]
                    none = first[at] > last[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            known.take(pa.array(at)),
                            one.take(pa.array(np.zeros(len(at), "i8"))),
                            pa.array(first[at], mask=none),
                            pa.array(last[at], mask=none),
                        ],
                        ["_name", "_row", "_first", "_last"],
                    )

        now, known, rows, kept = None, None, None, {}
        for share, names_, row, t, n in _found(batches):
            if share != now:
                yield from told()
                now, known, kept = share, names_, {}
            if row is not rows:
                rows = row
                values = [tuple(x[c] for c in by) for x in row.to_pylist()]
                ids = {v: i for i, v in enumerate(dict.fromkeys(values))}
                group = np.array([ids[v] for v in values])
                when = row.field(row.type.get_field_index("_order"))
                orders, empty = when.fill_null(0).to_numpy(), when.is_null().to_numpy(zero_copy_only=False)
            for v, i in ids.items():
                own = group[t] == i
                if not own.any():
                    continue
                if v not in kept:
                    size = len(known)
                    kept[v] = row.slice(values.index(v), 1), np.zeros(size, bool), np.full(size, low), np.full(size, high)
                _, seen, first, last = kept[v]
                at, place = n[own], t[own]
                seen[at] = True
                at, place = at[~empty[place]], place[~empty[place]]
                np.minimum.at(first, at, orders[place])
                np.maximum.at(last, at, orders[place])
        yield from told()

    none = F.lit(None).cast("long")
    kind = dealt.select(F.lit("").alias("_name"), "_row", none.alias("_first"), none.alias("_last")).schema
    found = dealt.mapInArrow(run, kind).select(
        F.col("_name").alias(name), *[F.col(f"_row.{c}").alias(c) for c in [*on, *by]], "_first", "_last"
    )
    return found.groupBy(name, *on, *by).agg(F.min("_first").alias("first"), F.max("_last").alias("last"))
