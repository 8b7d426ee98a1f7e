"""Edit-aware token counts: a segment tree per document that is kept, and re-encoding only around edits.

A text is cut into segments at its spaces (see `segments`), whose ids add up to those of the text. The tree's leaves are
runs of about LEAF segments, of which the characters and tokens are kept; every node above holds the characters and
tokens below it. `build_trees` encodes whole texts once and gives their trees as columns (TREE: text and leaves; sums
above the leaves follow from them), to be written as a table. `apply_edits` reads such a table, applies the edits of each
document and gives the leaves that changed (`patch`), to be written beside it: nothing is encoded but what an edit
touches, and nothing else is saved again. Table and patch together are the tree after the edits; later edits start from
both, and `fold_patches` makes one table of them. An edit (at a character, remove so many, insert a string) finds its
leaf from the root by characters. The segments that it touches, and one on either side as context (an edit may join or
part them), are cut and encoded anew; the sums above the leaves touched are updated.

Each text is worked out whole in one row, so memory is bounded by the longest text. Cases: null texts count as empty;
null edits as none; a position beyond the end means the end, a removal beyond the end stops there, negative numbers
count as 0; null ids are kept; repeated rows get equal results; strings of special tokens are counted as ordinary text;
other columns are kept (a column that has the name of a result is replaced).
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from .common import slices, stash
from .segments import SegmentCounts, counts_for, segments, tokenizer_file

LEAF = 16
#: Columns of a kept tree: the text, segments of each leaf, characters and tokens of each segment.
TREE = ("tree_text", "leaf_segments", "segment_chars", "segment_tokens")
COUNTS = ("n_before", "n_after", "n_segments", "n_encoded")
#: Leaves that differ from those of the table; leaf -1 is a whole tree that was dealt anew.
PATCH = "patch"
_INTS = pa.list_(pa.int32())
_LEAF = pa.struct([("leaf", pa.int32()), ("text", pa.string()), ("chars", _INTS), ("tokens", _INTS)])
_KINDS = dict(zip(TREE, (pa.string(), _INTS, _INTS, _INTS), strict=True)) | {PATCH: pa.list_(_LEAF)}
_KINDS |= dict.fromkeys(COUNTS[:2], pa.int64()) | dict.fromkeys(COUNTS[2:], pa.int32())


class CountTree:
    """Token and character sums over the segments of one text. Leaves are read when they are needed."""

    def __init__(self, known: SegmentCounts):
        self.known, self.encoded = known, 0
        self.changed: set[int] = set()

    @classmethod
    def of(cls, text: str, known: SegmentCounts) -> CountTree:
        tree = cls(known)
        parts = segments(text)
        chars, tokens = (np.fromiter(map(f, parts), np.int32, len(parts)) for f in (len, known.__getitem__))
        tree._build(text, chars, tokens)
        tree.changed = set()
        return tree

    @classmethod
    def kept(
        cls, text: str, leaf_segments: np.ndarray, chars: np.ndarray, tokens: np.ndarray, known: SegmentCounts, patch=()
    ) -> CountTree:
        """The tree whose `state` and `patch` these are; nothing is encoded."""
        tree = cls(known)
        tree._deal(text, leaf_segments, chars, tokens)
        for p in patch or ():
            c, t = (np.array(p[n], np.int32) for n in ("chars", "tokens"))
            if p["leaf"] < 0:
                tree._build(p["text"], c, t)
            else:
                tree._set(p["leaf"], p["text"], c, t)
        return tree

    def state(self) -> tuple:
        """(text, leaf_segments, segment_chars, segment_tokens)."""
        return "".join(self.texts), np.array(
            list(map(len, self.chars)), np.int32
        ), np.concatenate(self.chars), np.concatenate(self.tokens)

    def patch(self) -> list[dict]:
        """The leaves that changed since the table."""
        leaf = lambda k, text, c, t: {"leaf": k, "text": text, "chars": c.tolist(), "tokens": t.tolist()}
        if -1 in self.changed:
            text, _, c, t = self.state()
            return [leaf(-1, text, c, t)]
        return [leaf(k, self.texts[k], self.chars[k], self.tokens[k]) for k in sorted(self.changed)]

    def _build(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Deal segments out to leaves anew."""
        leaves = max(1, -(-len(chars) // LEAF))
        sizes = np.full(leaves, LEAF)
        sizes[-1] = len(chars) - LEAF * (leaves - 1)
        self._deal(text, sizes, chars, tokens)
        self.changed = {-1}

    def _deal(self, text: str, leaf_segments: np.ndarray, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Leaves from the segments of each, and the sums above them."""
        ends = np.cumsum(leaf_segments)
        self.chars, self.tokens = np.split(chars, ends[:-1].tolist()), np.split(tokens, ends[:-1].tolist())
        self.size = 1 << (len(self.chars) - 1).bit_length()
        per_leaf = [
            np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]).tolist() for x in (chars, tokens)
        ]
        self.node_chars, self.node_tokens = (self._sums(x) for x in per_leaf)
        cuts = [0, *accumulate(per_leaf[0])]
        self.texts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _sums(self, leaves: list[int]) -> list[int]:
        nodes = [0] * self.size + leaves + [0] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            nodes[k] = nodes[2 * k] + nodes[2 * k + 1]
        return nodes

    def _set(self, leaf: int, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Replace a leaf and carry its sums up to the root."""
        self.texts[leaf], self.chars[leaf], self.tokens[leaf] = text, chars, tokens
        self.changed.add(leaf)
        node = self.size + leaf
        more_chars, more = int(chars.sum()) - self.node_chars[node], int(tokens.sum()) - self.node_tokens[node]
        while node and (more_chars or more):
            self.node_chars[node] += more_chars
            self.node_tokens[node] += more
            node //= 2

    @property
    def total(self) -> int:
        return self.node_tokens[1]

    @property
    def segments(self) -> int:
        return sum(map(len, self.chars))

    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, segment and offset in it of the character `at`; the end of the last segment if the text ends there."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.node_chars[node] and self.node_chars[node + 1]:
                at -= self.node_chars[node]
                node += 1
        leaf = node - self.size
        for k, many in enumerate(self.chars[leaf].tolist()):
            if at < many:
                return leaf, k, at
            at -= many
        last = max(0, len(self.chars[leaf]) - 1)
        return leaf, last, int(self.chars[leaf][last]) if len(self.chars[leaf]) else 0

    def _beside(self, leaf: int, k: int, by: int) -> tuple[int, int]:
        """The segment before or after, across leaves; the same one at either end of the text."""
        if 0 <= k + by < len(self.chars[leaf]):
            return leaf, k + by
        other = leaf + by
        while 0 <= other < len(self.chars) and not len(self.chars[other]):
            other += by
        if not 0 <= other < len(self.chars):
            return leaf, k
        return other, (0 if by > 0 else len(self.chars[other]) - 1)

    def edit(self, start: int, remove: int, insert: str) -> None:
        start = min(max(0, start), self.node_chars[1])
        remove = min(max(0, remove), self.node_chars[1] - start)
        la, ka, before = self._find(start)
        lb, kb, _ = self._find(start + remove)
        if len(self.chars[la]):
            l, k = self._beside(la, ka, -1)
            if (l, k) != (la, ka):
                before += int(self.chars[l][k])
            la, ka = l, k
        if len(self.chars[lb]):
            lb, kb = self._beside(lb, kb, 1)
        head, tail = int(self.chars[la][:ka].sum()), int(self.chars[lb][kb + 1 :].sum())
        whole = "".join(self.texts[la : lb + 1])
        touched = whole[head : len(whole) - tail]
        new = segments(touched[:before] + insert + touched[before + remove :])
        self.encoded += len(new)
        chars, tokens = (np.fromiter(map(f, new), np.int32, len(new)) for f in (len, self.known.__getitem__))
        none = np.zeros(0, np.int32)
        first = [
            whole[:head] + "".join(new),
            np.concatenate([self.chars[la][:ka], chars]),
            np.concatenate([self.tokens[la][:ka], tokens]),
        ]
        last = [whole[len(whole) - tail :], self.chars[lb][kb + 1 :], self.tokens[lb][kb + 1 :]]
        if la == lb:
            self._set(
                la, first[0] + last[0], *(np.concatenate([x, y]) for x, y in zip(first[1:], last[1:], strict=True))
            )
        else:
            self._set(la, *first)
            for leaf in range(la + 1, lb):
                self._set(leaf, "", none, none)
            self._set(lb, *last)
        if len(self.chars[la]) > 4 * LEAF:
            self._build(self.text(), np.concatenate(self.chars), np.concatenate(self.tokens))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if kind != _INTS:
        return pa.array(values, kind)
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]).astype(np.int32))
    )


def _with(batch: pa.RecordBatch, drop: tuple[str, ...], names: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    """The batch without some columns, and new ones at its end."""
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in (*drop, *names)]
    made = [(n, _column([r[k] for r in rows], _KINDS[n])) for k, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([c for _, c in kept + made], [n for n, _ in kept + made])


def _schema(df: DataFrame, drop: tuple[str, ...], names: tuple[str, ...]) -> StructType:
    return StructType(
        [f for f in df.schema if f.name not in (*drop, *names)] + list(
            from_arrow_schema(pa.schema([(n, _KINDS[n]) for n in names]))
        )
    )


def build_trees(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """All columns of docs but the text, and the tree of each whole text (TREE)."""
    path = tokenizer or tokenizer_file("byte_bpe_50k.tiktoken")
    at = docs.columns.index(text)

    def run(batches):
        known = counts_for(path)
        for b in slices(batches, 256):
            rows = [CountTree.of(x or "", known).state() for x in b.column(at).to_pylist()]
            yield _with(b, (text,), TREE, rows)

    return docs.mapInArrow(run, _schema(docs, (text,), TREE))


def _trees(batch: pa.RecordBatch, places: dict[str, int], known: SegmentCounts):
    """The trees of a batch, with their patches where it has any."""
    texts, lists = batch.column(places["tree_text"]).to_pylist(), []
    for n in TREE[1:]:
        column = batch.column(places[n])
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        lists.append([values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
    patches = batch.column(places[PATCH]).to_pylist() if PATCH in places else [None] * batch.num_rows
    for x, *kept, patch in zip(texts, *lists, patches, strict=True):
        yield CountTree.kept(x, *kept, known, patch)


def apply_edits(trees: DataFrame, edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """`edits` (array of struct start, remove, insert, in order) applied to the trees of a table, and to their patches if
    it has such a column. All columns but those of the tree, the new patch, and COUNTS: tokens before and after, segments
    before, segments encoded."""
    path = tokenizer or tokenizer_file("byte_bpe_50k.tiktoken")
    places = {n: trees.columns.index(n) for n in (*TREE, edits, PATCH) if n in trees.columns}
    new = (PATCH, *COUNTS)

    def run(batches):
        known = counts_for(path)
        for b in slices(batches, 256):
            rows = []
            for tree, todo in zip(_trees(b, places, known), b.column(places[edits]).to_pylist(), strict=True):
                before, many = tree.total, tree.segments
                for e in todo or []:
                    tree.edit(int(e["start"] or 0), int(e["remove"] or 0), e["insert"] or "")
                rows.append((tree.patch(), before, tree.total, many, tree.encoded))
            yield _with(b, TREE, new, rows)

    return trees.mapInArrow(run, _schema(trees, TREE, new))


def fold_patches(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A table of trees with a patch column -> the table after the patches, without one."""
    path = tokenizer or tokenizer_file("byte_bpe_50k.tiktoken")
    places = {n: trees.columns.index(n) for n in (*TREE, PATCH)}

    def run(batches):
        known = counts_for(path)
        for b in slices(batches, 256):
            yield _with(b, (PATCH,), TREE, [tree.state() for tree in _trees(b, places, known)])

    return trees.mapInArrow(run, _schema(trees, (PATCH,), TREE))


def recount(docs: DataFrame, edits: str = "edits", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """All columns of docs and COUNTS, for texts of which no tree is kept."""
    held = docs.withColumn("_text", F.col(text))
    out = apply_edits(build_trees(held, "_text", tokenizer), edits, tokenizer)
    return out.select(*[c for c in docs.columns if c not in COUNTS], *COUNTS)


#: What the query's edits insert, by turns.
INSERTS = (" added words", "x", "", "\n", " ", "end. New sentence")


def derived_edits(id_col: str, text: str, many: int = 3):
    """Edits that follow from the id and the length of the text: a Column for `recount`."""
    out = []
    for k in range(many):
        h = F.crc32(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(k))).cast("binary"))
        size = F.coalesce(F.length(text), F.lit(0))
        insert = F.element_at(F.array(*[F.lit(x) for x in INSERTS]), (h % len(INSERTS)).cast("int") + 1)
        out.append(
            F.struct(
                (h % (size + 1)).cast("int").alias("start"),
                (F.shiftright(h, 8) % 9).cast("int").alias("remove"),
                insert.alias("insert"),
            )
        )
    return F.array(*out)


def op8_edit_counts(spark, sf_dir: str) -> DataFrame:
    """Trees of all documents, written; three edits to each, from that table; what they changed, written beside it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn(
        "edits", derived_edits("doc_id", "text")
    )
    trees = stash(build_trees(docs), "trees", compression="zstd")
    edited = stash(apply_edits(trees).drop("edits"), "patches", compression="zstd")
    return edited.select("doc_id", *COUNTS)
