"""Benchmark decontamination: BM25 over test items with block-max WAND, then verification of question and answer.

The items are indexed; every training passage is a query. What a passage is depends on the item alone: for an item of m
words, with w the least power of two that is no less than m, the windows of 2.5 w words that begin every 1.25 w words of
the text, so that any copy of the item lies whole in one of them. An item's score is the BM25 sum over the words of such a
window, as a share of the item's score for itself; all items at THRESHOLD or more are retrieved.

An index holds items whose lengths differ by 2 ** SPREAD at most, and is searched with the windows of its longest items,
which hold those of all others; so a retrieved item is scored again in its own windows, and the result is the same
whichever items share an index. WAND's bounds are taken step by step, each of which drops only what cannot reach the
threshold: the greatest impact of each word over all items; then, for the words without which nothing reaches the
threshold, the blocks of BLOCK items that they occur in, with the greatest impact of each word in each block (the posting
lists of the other, commonest, words are only looked up in blocks that are left); then the posting cursors of these
blocks, moved to pivots. Windows are taken a few at a time, so that at most POSTINGS block entries (or those of one
window) are held.

A retrieved pair is kept if some stretch of the window of twice the item's length (so that the answer stands within an
item's length of the question) holds the item's question (all sentences but the last: share of its word 5-shingles, or the
question but for one word) and its answer (the last sentence: share of its words), or if the window holds the whole item
but for one word. "But for one word" is a stretch with one word replaced, left out or put in, and is asked of questions
and items of SHINGLE words or more. Words are compared without case and without punctuation at their ends.

Indexes of about CHUNK_BYTES of items each, by length, are made by tasks and written to the shared folder; item count, document
frequencies and mean length are those of all items, so scores are the same at any number of indexes. One pass over the
documents asks all of them: a task holds HELD_BYTES of texts and one index at a time.

Cases: null and empty texts match nothing; items without words are ignored, and repeated item rows count once; items
with equal texts are found each; one row per document row and item at most (repeated documents give repeated results);
null ids are kept; ids are whole numbers; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, new_folder, open_store, slices, stash

THRESHOLD = 0.6
QUESTION = 0.8
ANSWER = 0.8
BLOCK = 4
CHUNK_BYTES = 8_000_000
K1, B = 1.2, 0.75
SHINGLE = 5
KEPT_WORDS = 300_000
#: Block entries that a worker holds, and (window, block, word) triples that it looks up at once.
POSTINGS = 2_000_000
#: Bytes of texts that a task holds while it asks one index after the other.
HELD_BYTES = 32_000_000
#: Items that an index keeps in parsed form.
PARSED = 20_000
#: Powers of two of lengths that share an index: up to 8 words, 128, 2,048, ...
SPREAD = 4


def form(word: str) -> str:
    """A lower-cased word without characters at its ends that are neither letters nor digits."""
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def forms(text: str) -> list[str]:
    return [f for f in map(form, text.lower().split()) if f]


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item; the last quarter is the answer of a single sentence."""
    parts = [forms(x) for x in re.split(r"(?<=[.!?])\s+", text)]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4) if words else 0
    return words[:cut], words[cut:]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def nearly(words: list[str], passage: list[str]) -> bool:
    """Whether a stretch of the passage is `words` with at most one word replaced, left out or put in."""
    m = len(words)
    if m < SHINGLE or len(set(words).difference(passage)) > 1:
        return False
    for s in range(len(passage) - m + 2):
        p = 0
        while p < m and s + p < len(passage) and passage[s + p] == words[p]:
            p += 1
        rest = words[p + 1 :]
        if p == m or passage[s + p + 1 : s + m] == rest or passage[s + p : s + m - 1] == rest or passage[s + p + 1 : s + m + 1] == words[p:]:
            return True
    return False


def step_of(words: int) -> int:
    """How far apart the windows of an item of so many words begin; a window is twice as long."""
    return 5 * max(4, 1 << (words - 1).bit_length()) // 4


class ItemIndex:
    """Inverted index of items: impacts by word and item, greatest impacts by word and by word and block."""

    def __init__(
        self,
        items: list[tuple[int, str]],
        count: int | None = None,
        mean: float | None = None,
        holders: dict[str, int] | None = None,
    ):
        """Count, mean length and items by word are those of all items, where these are a part of them."""
        read = [(i, forms(t or ""), t) for i, t in items]
        read = [x for x in read if x[1]]
        self.ids, self.texts = [x[0] for x in read], [x[2] for x in read]
        self.parsed: dict[int, tuple] = {}
        n = len(read)
        self.step = max((step_of(len(x[1])) for x in read), default=1)
        count = n if count is None else count
        mean = sum(len(x[1]) for x in read) / max(1, n) if mean is None else mean
        where: dict[str, dict[int, int]] = {}
        for i, (_, words, _) in enumerate(read):
            for w in words:
                found = where.setdefault(w, {})
                found[i] = found.get(i, 0) + 1
        names = sorted(where)
        self.terms = {w: k for k, w in enumerate(names)}
        sizes = np.array([len(where[w]) for w in names], np.int64)
        df = sizes if holders is None else np.array([holders[w] for w in names], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.items = np.array([i for w in names for i in sorted(where[w])], np.int64)
        tf = np.array([where[w][i] for w in names for i in sorted(where[w])], float)
        length = np.array([len(x[1]) for x in read], float)
        idf = np.repeat(np.log(1 + (count - df + 0.5) / (df + 0.5)), sizes)
        self.weights = idf * tf * (K1 + 1) / (
            tf + K1 * (1 - B + B * length[self.items] / max(mean, 1e-9))
        ) if n else np.zeros(0)
        if n:
            self.weights /= np.bincount(self.items, self.weights, n)[self.items]
        terms = len(names)
        self.most = np.maximum.reduceat(self.weights, self.starts[:-1]) if terms else np.zeros(0)
        self.blocks = max(1, -(-n // BLOCK))
        owner = np.repeat(np.arange(terms), sizes)
        self.block_keys, first = np.unique(  # word, then block
            owner * self.blocks + self.items // BLOCK, return_index=True
        )
        self.block_most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.block_first = np.append(first, len(self.items))
        self.block_starts = np.searchsorted(self.block_keys, np.arange(terms + 1) * self.blocks)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parsed": {}}

    def item(self, k: int) -> tuple[list[str], list[str], set, set, dict[str, float]]:
        """Words of the item and of its question, the question's shingles, the answer's words, weights of its words."""
        if k not in self.parsed:
            if len(self.parsed) >= PARSED:
                self.parsed.clear()
            question, answer = split_item(self.texts[k])
            words, weights = forms(self.texts[k]), {}
            for w in set(words):
                t = self.terms[w]
                at = self.starts[t] + np.searchsorted(self.items[self.starts[t] : self.starts[t + 1]], k)
                weights[w] = float(self.weights[at])
            self.parsed[k] = words, question, grams(question), set(answer), weights
        return self.parsed[k]

    def in_blocks(self, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of word and block: whether the word occurs in the block, and where its entry is."""
        wanted = term * self.blocks + block
        at = np.minimum(np.searchsorted(self.block_keys, wanted), max(0, len(self.block_keys) - 1))
        return self.block_keys[at] == wanted if len(self.block_keys) else np.zeros(len(term), bool), at

    def survivors(self, window: np.ndarray, term: np.ndarray, windows: int, least: float) -> np.ndarray:
        """(window, block) pairs whose bound reaches `least`; window and term are distinct pairs."""
        able = np.bincount(window, self.most[term], windows) >= least if len(term) else np.zeros(windows, bool)
        window, term = window[able[window]], term[able[window]]
        if not len(term):
            return np.zeros((0, 2), np.int64)
        if windows * self.blocks <= POSTINGS and (
            self.block_starts[term + 1] - self.block_starts[term]
        ).sum() <= POSTINGS:
            return self._dense(window, term, windows, least)  # few enough to add them all up
        order = np.lexsort((self.most[term], window))
        window, term = window[order], term[order]
        top = self.most[term]
        starts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        run = np.cumsum(top)
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
        within = run - (run[starts] - top[starts])[own]
        needed = within >= least  # the commonest words of a window fall short together: a block needs one of the others
        many = np.where(needed, self.block_starts[term + 1] - self.block_starts[term], 0)
        load = np.add.reduceat(many, starts)
        out, edges, a = [], np.append(starts, len(term)), 0
        while a < len(starts):
            b = a + max(1, int(np.searchsorted(np.cumsum(load[a:]), POSTINGS, side="right")))
            part = slice(edges[a], edges[b] if b < len(edges) else len(term))
            out.append(self._bounded(window[part], term[part], needed[part], many[part], least))
            a = b
        return np.concatenate(out)

    def _dense(self, window: np.ndarray, term: np.ndarray, windows: int, least: float) -> np.ndarray:
        """The bounds of all blocks in all windows, for a few of both."""
        low = self.block_starts[term]
        many = self.block_starts[term + 1] - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        bounds = np.bincount(
            np.repeat(window, many) * self.blocks + self.block_keys[at] % self.blocks,
            self.block_most[at],
            windows * self.blocks,
        )
        found = np.flatnonzero(bounds >= least)
        return np.stack([found // self.blocks, found % self.blocks], axis=1)

    def _bounded(
        self, window: np.ndarray, term: np.ndarray, needed: np.ndarray, many: np.ndarray, least: float
    ) -> np.ndarray:
        w, t, m = window[needed], term[needed], many[needed]
        low = self.block_starts[t]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        keys, place = np.unique(np.repeat(w, m) * self.blocks + self.block_keys[at] % self.blocks, return_inverse=True)
        bound = np.bincount(place, self.block_most[at], len(keys))
        first = int(window[0])
        w, t = window[~needed], term[~needed]
        spare = np.bincount(  # what the common words can add at most
            w - first, self.most[t], int(window[-1]) - first + 1
        )
        live = bound + spare[keys // self.blocks - first] >= least
        keys, bound = keys[live], bound[live]
        begin = np.searchsorted(w, np.arange(first, int(window[-1]) + 2))
        size = np.diff(begin)
        kept, k = [], 0
        per = size[keys // self.blocks - first]
        while k < len(keys):
            e = k + max(1, int(np.searchsorted(np.cumsum(per[k:]), POSTINGS, side="right")))
            own = np.repeat(np.arange(k, min(e, len(keys))), per[k:e])
            offset = np.arange(len(own)) - np.repeat(np.cumsum(per[k:e]) - per[k:e], per[k:e])
            words = t[begin[keys[own] // self.blocks - first] + offset]
            there, entry = self.in_blocks(words, keys[own] % self.blocks)
            more = np.bincount(
                own - k, np.where(there, self.block_most[entry], 0.0), min(e, len(keys)) - k
            ) if len(own) else 0.0
            kept.append(keys[k:e][bound[k:e] + more >= least])
            k = e
        found = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return np.stack([found // self.blocks, found % self.blocks], axis=1)

    def search(self, terms: np.ndarray, block: int, least: float) -> list[tuple[int, float]]:
        """WAND over the postings of one block: (item, score) of all items that reach `least`."""
        there, entry = self.in_blocks(terms, np.full(len(terms), block))
        cursors = []  # next item, position, end, greatest impact
        for k in entry[there].tolist():
            p, e = int(self.block_first[k]), int(self.block_first[k + 1])
            cursors.append([int(self.items[p]), p, e, float(self.block_most[k])])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = 0.0
                for c in cursors:
                    if c[0] != item:
                        break
                    score += float(self.weights[c[1]])
                    c[1] += 1
                    c[0] = int(self.items[c[1]]) if c[1] < c[2] else -1
                if score >= least:
                    out.append((item, score))
            else:
                for c in cursors[:pivot]:
                    while c[0] != -1 and c[0] < item:
                        c[1] += 1
                        c[0] = int(self.items[c[1]]) if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] != -1]
        return out

    def own_windows(self, item: int, passage: list[str], start: int, least: float):
        """(score, window) of the item's own windows in a passage that begins at word `start` of its text."""
        words, *_, weights = self.item(item)
        step = step_of(len(words))
        for k in range(-(-start // step), max(-(-start // step), (start + len(passage) - 1) // step) + 1):
            low = k * step - start
            window = passage[low : low + 2 * step]
            if k and len(window) <= step:
                break  # no more than the end of the window before
            score = sum(weights[w] for w in weights.keys() & set(window))
            if score >= least:
                yield score, window

    def verify(self, item: int, passage: list[str], question: float, answer: float) -> tuple[float, float] | None:
        """Shares of the question's shingles and of the answer's words in the stretch of the passage that holds the item
        best; None if none holds it."""
        words, asked, *_ = self.item(item)
        shares = self.shares(item, passage)
        told = [(k, got) for k, got in enumerate(shares) if got[1] >= answer]
        held = [got for _, got in told if got[0] >= question]
        if not held and told and nearly(asked, passage):
            span = 2 * len(words)
            held = [got for k, got in told if nearly(asked, passage[k : k + span])]
        if not held and nearly(words, passage):
            held = shares
        return max(held, default=None)

    def shares(self, item: int, passage: list[str]) -> list[tuple[float, float]]:
        """(share of the question, share of the answer) of every stretch of twice the item's length, by its start."""
        words, _, shingles, told, _ = self.item(item)
        span, n = 2 * len(words), len(passage)
        k = len(next(iter(shingles))) if shingles else 0
        of_q = [g if (g := tuple(passage[i : i + k])) in shingles else None for i in range(n - k + 1)] if k else []
        of_a = [w if w in told else None for w in passage]
        seen_q: dict = {}
        seen_a: dict = {}
        end_q = end_a = 0
        out = []
        for start in range(max(1, n - span + 1)):
            for marks, seen, end, size in ((of_q, seen_q, end_q, span - k + 1), (of_a, seen_a, end_a, span)):
                upto = min(len(marks), start + size)
                for i in range(end, upto):
                    if marks[i] is not None:
                        seen[marks[i]] = seen.get(marks[i], 0) + 1
                if start and start <= len(marks) and (gone := marks[start - 1]) is not None:
                    if seen[gone] == 1:
                        del seen[gone]
                    else:
                        seen[gone] -= 1
            end_q, end_a = min(len(of_q), start + span - k + 1), min(len(of_a), start + span)
            out.append((len(seen_q) / len(shingles) if shingles else 1.0, len(seen_a) / len(told) if told else 1.0))
        return out


class Lookup(dict):
    """Word as it stands -> index of its form among the items' words, -1 for another word, -2 for none."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        f = form(word)
        got = self[word] = self.terms.get(f, -1) if f else -2
        return got


def find_items(
    index: ItemIndex,
    texts: list[str | None],
    lookup: Lookup,
    least: float = THRESHOLD,
    question: float = QUESTION,
    answer: float = ANSWER,
) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question share, answer share) of all verified pairs."""
    if not index.ids:
        return []
    step = index.step
    words: list[list[str]] = []
    term_parts, window_parts, doc_of, start_of = [], [], [], []
    windows = 0
    for d, x in enumerate(texts):
        w = x.lower().split() if x else []
        words.append(w)
        if not w:
            continue
        t = np.fromiter(map(lookup.__getitem__, w), np.int64, len(w))
        if (t == -2).any():  # words of punctuation only take no place
            real = t != -2
            w = words[-1] = [v for v, r in zip(w, real, strict=True) if r]
            t = t[real]
        many = max(1, -(-len(t) // step) - 1)
        at = np.flatnonzero(t >= 0)
        own = at // step
        term_parts += [t[at], t[at]]
        window_parts += [np.where(own < many, windows + own, -1), np.where(own > 0, windows + own - 1, -1)]
        doc_of += [d] * many
        start_of += [k * step for k in range(many)]
        windows += many
    if not windows:
        return []
    window, term = np.concatenate(window_parts), np.concatenate(term_parts)
    size = len(index.terms)
    pairs = np.unique(window[window >= 0] * size + term[window >= 0])
    window, term = pairs // size, pairs % size
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    ends = np.searchsorted(window, np.arange(windows + 1))
    for k, block in index.survivors(window, term, windows, least - 1e-9).tolist():
        for item, _ in index.search(term[ends[k] : ends[k + 1]], block, least - 1e-9):
            d, s = doc_of[k], start_of[k]
            passage = [form(v) for v in words[d][s : s + 2 * step]]
            for score, window in index.own_windows(item, passage, s, least - 1e-9):
                got = index.verify(item, window, question, answer)
                if got:
                    best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (score, *got))
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


# --- indexes in the shared folder -----------------------------------------------------------------


def write_indexes(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> list[str]:
    """Files of indexes of all items; none if no item has a word. A task makes one index; only file names reach the driver."""
    spark = items.sparkSession
    rows = items.where(F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")
    ).distinct()
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0])
    many = 1 if size <= CHUNK_BYTES else -(-size * 3 // (2 * CHUNK_BYTES))

    def classed(batches):
        for b in slices(batches):
            power = [((max(1, len(forms(x))) - 1).bit_length()) // SPREAD for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(power, pa.int32())], ["i", "t", "power"])

    share = F.pmod(F.xxhash64("i", "t"), F.lit(many))
    rows = rows.mapInArrow(classed, "i long, t string, power int")
    rows = stash(rows.select("i", "t", (F.col("power") * many + share).cast("int").alias("chunk")), "items")

    def words_of(batches):
        for b in slices(batches):
            chunks, words, lengths = [], [], []
            for text, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = forms(text)
                kinds = set(found)
                words += [None, *kinds]
                chunks += [chunk] * (1 + len(kinds))
                lengths += [len(found), *[0] * len(kinds)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int32()), pa.array(words, pa.string()), pa.array(lengths, pa.int64())],
                ["chunk", "word", "length"],
            )

    told = rows.select("t", "chunk").mapInArrow(words_of, "chunk int, word string, length long")
    count, length = told.where("word IS NULL AND length > 0").agg(
        F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))
    ).first()
    if not count:
        return []
    uses = told.where("word IS NOT NULL").groupBy("chunk", "word").agg(F.count(F.lit(1)).alias("n"))
    holders = uses.groupBy("word").agg(F.sum("n").alias("df"))
    none = F.lit(None)
    known = uses.join(holders, "word").select(
        "chunk", F.lit(0).alias("kind"), none.cast("long").alias("i"), F.col("word").alias("t"), "df"
    )
    every = known.unionByName(rows.select("chunk", F.lit(1).alias("kind"), "i", "t", none.cast("long").alias("df")))
    folder = new_folder(spark, "indexes")

    def build(batches):
        now, df, items_ = None, {}, []

        def done():
            index = ItemIndex(items_, count, length / count, df)
            store, base = open_store(folder)
            store.create_dir(base, recursive=True)
            name = f"{folder}/{now}-{uuid.uuid4().hex}.pickle"
            with store.open_output_stream(open_store(name)[1]) as f:
                f.write(pickle.dumps(index, protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for b in batches:
            for chunk, kind, i, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    if items_:
                        yield done()
                    now, df, items_ = chunk, {}, []
                if kind:
                    items_.append((i, t))
                else:
                    df[t] = n
        if items_:
            yield done()

    dealt = every.repartition(many, "chunk").sortWithinPartitions("chunk", "kind", F.col("i").asc_nulls_first(), "t")
    return sorted(r.file for r in dealt.mapInArrow(build, "file string").collect())


_held: dict[str, tuple[ItemIndex, Lookup]] = {}


def index_of(file: str) -> tuple[ItemIndex, Lookup]:
    """The index of a file and its words; a worker holds one at a time."""
    if file not in _held:
        _held.clear()
        store, path = open_store(file)
        with store.open_input_stream(path) as f:
            index = pickle.loads(f.read())
        _held[file] = index, Lookup(index.terms)
    return _held[file]


def _asked(batches, files: list[str], text: int, least: float):
    """(batch, found) for each small batch: `find_items` rows of all indexes, with the index in front."""
    group, held = [], 0

    def ask():
        found = [[] for _ in group]
        for file in files:
            index, lookup = index_of(file)
            for k, b in enumerate(group):
                texts = b.column(text).to_pylist()
                for low, high in bounded(texts):
                    found[k] += [
                        (index.ids[i], low + d, *rest) for d, i, *rest in find_items(
                            index, texts[low:high], lookup, least
                        )
                    ]
        yield from zip(group, found, strict=True)

    for b in slices(batches):
        group.append(b)
        held += b.column(text).nbytes
        if held >= HELD_BYTES or len(files) == 1:
            yield from ask()
            group, held = [], 0
    if group:
        yield from ask()


RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for every document and item that it contains."""
    files = write_indexes(items, item_id, item_text)

    def run(batches):
        for b, found in _asked(batches, files, 1, least):
            if found:
                keys = b.column(0).to_pylist()
                i, d, s, q, a = zip(*found, strict=True)
                columns = [
                    pa.array([keys[x] for x in d], pa.int64()),
                    pa.array(i, pa.int64()),
                    pa.array(s),
                    pa.array(q),
                    pa.array(a),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, RESULT)


def without_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = THRESHOLD,
) -> DataFrame:
    """The rows of docs, all columns, that contain no item. One pass, no shuffle."""
    files = write_indexes(items, item_id, item_text)
    at = docs.columns.index(text)

    def run(batches):
        for b, found in _asked(batches, files, at, least):
            clean = np.ones(b.num_rows, bool)
            clean[[x[1] for x in found]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op10_blockmax_wand(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
