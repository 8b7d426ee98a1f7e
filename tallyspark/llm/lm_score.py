"""Document likelihood under a sub-word lattice.

One normalised model draws a text word by word, so that the probabilities of all texts add up to one at most. Where a
word may begin, it draws one of three things: a whole word of the training documents, a first piece (a piece that opens
with a space), or the end of the text. After a first piece it draws further pieces until the word stops. These draws are
the arcs of a lattice over the text; a text's probability is the sum over *all* paths through it, by a forward recursion
in log space. A word that the training documents lack has only the paths through pieces: it pays for its spelling.

Pieces come from an existing piece file, whose scores (ranks) are the prior of their weights; the weights are then
re-estimated by expectation maximisation over all segmentations of all training words. The weight of a whole word seen c
times is (c - D) / T, that of the end its share of all tokens; the mass D that each distinct word gives up is the weight
of the first pieces together. That is what leaving one use out asks for: the share of word uses that would be new without
themselves. D follows from the numbers of words seen once and twice.

Words never meet in a piece (a piece holds a space only in front), so a document's likelihood is a sum over its words and
every distinct word is worked out once. A piece has MAX_PIECE bytes at most (the few longer ones of the file are not used:
what they spell is spelled by others) and does not cross a multiple of CHUNK bytes
of a word: a word of any length is a row of lattices of bounded size. Counts of all words come from a shuffle over the
whole corpus. Looking words up from documents: words with at least 1/HEAVY of all training tokens (so HEAVY of them at
most) are sent to every worker; the others are joined. Words above LONG bytes travel as a digest.

`spelled_score` is the marginal over pieces alone, as if no whole word were known.

Cases: a null or empty text is one end; a null doc_id is kept, never held out; repeated rows are each a document of
their own; with no training rows the counts are 0 and words and the end have a half each; other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, stash, tokens
from .segments import tokenizer_file

MAX_PIECE = 16
CHUNK = 4096
#: At most so many words can be frequent enough to be sent to every worker.
HEAVY = 1 << 19
#: Bytes of the longest word that is its own key.
LONG = 64
END = b""
#: Cells (words times bytes) that a lattice works on at once.
CELLS = 200_000

_tries: dict[str, Pieces] = {}


class Pieces:
    """Pieces (bytes -> rank) as a trie; a leading space tells a first piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.names = sorted(ranks)
        self.first = np.array([x[:1] == b" " for x in self.names])
        weight = 1.0 / (10.0 + np.array([ranks[x] for x in self.names], float))
        #: Weights of the first pieces, which add up to one, and of the further ones, which do too.
        self.prior = np.where(
            self.first, weight / weight[self.first].sum(), weight / max(weight[~self.first].sum(), 1e-300)
        )
        used = sorted({b for x in self.names for b in x})
        self.classes = np.full(256, len(used), np.int32)
        self.classes[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}, {}]  # state 0: dead, 1: root
        at = [-1, -1]
        for k, x in enumerate(self.names):
            s = 1
            for b in x:
                n = children[s].get(b)
                if n is None:
                    n = children[s][b] = len(children)
                    children.append({})
                    at.append(-1)
                s = n
            at[s] = k
        self.step = np.zeros((len(children), len(used) + 1), np.int32)
        for s, edges in enumerate(children):
            for b, n in edges.items():
                self.step[s, self.classes[b]] = n
        self.at = np.array(at, np.int32)

    @classmethod
    def of_file(cls, path: str) -> Pieces:
        """Pieces of a sentencepiece file, and every single byte, so that any text has a path."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, int] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            text = model.id_to_piece(i).replace("▁", " ")
            raw = text.encode()
            if " " in text[1:] or raw != raw.lower() or len(raw) > MAX_PIECE or raw.strip() == b"" and raw != b" ":
                continue
            found.setdefault(
                raw, max(0, int(-model.get_score(i))) if model.get_score(i) > -1e8 else model.get_piece_size()
            )
        for b in range(256):
            found.setdefault(bytes([b]), model.get_piece_size())
        return cls(found)


def pieces(path: str) -> Pieces:
    if path not in _tries:
        _tries[path] = Pieces.of_file(path)
    return _tries[path]


def chunks(word: bytes) -> list[bytes]:
    """A word with its leading space, cut where no piece may cross."""
    text = b" " + word
    return [text] if len(text) <= CHUNK else [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials along the second axis; -inf where there is nothing to sum."""
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[:, None]).sum(axis=1))


def lattice(
    texts: list[bytes],
    trie: Pieces,
    logs: np.ndarray,
    counts: np.ndarray | None = None,
    expected: np.ndarray | None = None,
) -> np.ndarray:
    """Natural log of the summed weight of all segmentations of each text (a chunk of a word) into pieces.

    With counts, adds the expected uses of each piece to `expected` (forward and backward recursion).
    """
    n = len(texts)
    lens = np.array([len(x) for x in texts])
    width = int(lens.max())
    raw = np.zeros((n, width + MAX_PIECE), np.uint8)
    for i, x in enumerate(texts):
        raw[i, : len(x)] = np.frombuffer(x, np.uint8)
    cls = trie.classes[raw]
    score = np.full((n, width + 1, MAX_PIECE + 1), -np.inf, np.float32)  # text, end, length
    arcs = []
    row, start = np.nonzero(np.arange(width)[None, :] < lens[:, None])
    state = np.ones(len(row), np.int32)
    for length in range(1, MAX_PIECE + 1):
        state = trie.step[state, cls[row, start + length - 1]]
        live = (state > 0) & (start + length <= lens[row])
        row, start, state = row[live], start[live], state[live]
        if not len(row):
            break
        piece = trie.at[state]
        whole = piece >= 0
        r, s, p = row[whole], start[whole], piece[whole]
        score[r, s + length, length] = logs[p]
        if counts is not None:
            arcs.append((r, s, s + length, p))
    alpha = np.full((n, width + 1), -np.inf)
    alpha[:, 0] = 0.0
    for end in range(1, width + 1):
        low = max(0, end - MAX_PIECE)
        alpha[:, end] = _log_sum(alpha[:, low:end][:, ::-1] + score[:, end, 1 : end - low + 1])
    total = alpha[np.arange(n), lens]
    if counts is not None:
        beta = np.full((n, width + 1 + MAX_PIECE), -np.inf)
        beta[np.arange(n), lens] = 0.0
        for at in range(width - 1, -1, -1):
            ends = np.arange(at + 1, min(width, at + MAX_PIECE) + 1)
            value = _log_sum(score[:, ends, ends - at] + beta[:, at + 1 : ends[-1] + 1])
            open_ = at < lens
            beta[open_, at] = value[open_]
        for r, s, e, p in arcs:
            expected += np.bincount(p, np.exp(alpha[r, s] + logs[p] + beta[r, e] - total[r]) * counts[r], len(expected))
    return total


def spell(words: list[bytes], trie: Pieces, logs: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the summed weight of all segmentations of each word, without the word's stop.

    With `expected`, adds the expected uses of the pieces; a word counts once, whatever its length: each of its chunks
    with an equal share.
    """
    cut = [(i, c) for i, w in enumerate(words) for c in chunks(w)]
    share = 1.0 / np.bincount([i for i, _ in cut], minlength=len(words)) if expected is not None else None
    order = sorted(range(len(cut)), key=lambda k: len(cut[k][1]))
    out, k = np.zeros(len(words)), 0
    while k < len(order):
        end = k + 1
        while end < len(order) and (end + 1 - k) * len(cut[order[end]][1]) <= CELLS:
            end += 1
        owner = np.array([cut[j][0] for j in order[k:end]])
        told = lattice([cut[j][1] for j in order[k:end]], trie, logs, None if share is None else share[owner], expected)
        np.add.at(out, owner, told)
        k = end
    return out


def in_bulk(batches, rows: int = 8192, size: int = 1 << 24):
    """Small rows (words), several Arrow batches at a time, up to so many rows or bytes."""
    held, n, b_held = [], 0, 0
    for b in batches:
        held.append(b)
        n, b_held = n + b.num_rows, b_held + b.nbytes
        if n >= rows or b_held >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, b_held = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def key_of(word: bytes) -> bytes:
    """What a word goes by: itself, or a digest behind a space, which no word holds."""
    return word if len(word) <= LONG else b" " + hashlib.blake2b(word, digest_size=16).digest()


def keys_of(words: list[bytes]) -> list[bytes]:
    return list(map(key_of, words)) if words and max(map(len, words)) > LONG else words


def count_words(docs: DataFrame, text: str, train: str, most: int = 300_000, chars: int = 50_000_000) -> DataFrame:
    """(word binary, c long): uses in training rows; words only seen elsewhere have 0. END is a text's end.

    A task tells what it has counted whenever that is `most` words, or came from `chars` characters.
    """

    def run(batches):
        counts: Counter = Counter()
        other: set[bytes] = set()
        read = 0

        def flush():
            found = [*counts, *(x for x in other if x not in counts)]
            for k in range(0, len(found), 50_000):
                part = found[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([counts.get(x, 0) for x in part], pa.int64())], ["word", "c"]
                )
            counts.clear()
            other.clear()

        for b in slices(batches):
            for x, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                read += len(x or "")
                if learn:
                    counts.update(tokens(x))
                    counts[END] += 1
                else:
                    other.update(tokens(x))
                    other.add(END)
                if len(counts) + len(other) > most or read > chars:
                    yield from flush()
                    read = 0
        yield from flush()

    parts = docs.select(F.col(text).alias("text"), F.col(train).alias("train")).mapInArrow(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, path: str, rounds: int = 2, prior: float = 500.0) -> tuple[np.ndarray, float]:
    """Natural logs of the piece weights and of a word's stop: expectation maximisation over all segmentations.

    Each distinct training word counts once, as the pieces stand in for new words. The prior counts as `prior` words of
    one first and three further pieces. Only sums per piece of the vocabulary reach the driver.
    """
    trie = pieces(path)
    size, logs = len(trie.names), np.log(trie.prior)
    log_stop = float(np.log(0.25))
    for _ in range(rounds):

        def expect(batches, logs=logs):
            total, seen = np.zeros(size + 1), 0
            for b in in_bulk(batches):
                found = b.column(0).to_pylist()
                spell(found, pieces(path), logs, total[:size])
                seen += len(found)
            total[size] = seen
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["piece", "uses"])

        real = words.where((F.col("c") > 0) & (F.length("word") > 0)).select("word")
        got = real.mapInArrow(
            expect, "piece int, uses double"
        ).groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(size + 1)
        for r in got:
            uses[r.piece] = r.uses
        words_seen = uses[size] + prior
        weight = uses[:size] + trie.prior * np.where(trie.first, prior, 3 * prior)
        further = weight[~trie.first].sum() + words_seen  # each further piece, or the stop
        logs = np.log(np.where(trie.first, weight / weight[trie.first].sum(), weight / further))
        log_stop = float(np.log(words_seen / further))
    return logs, log_stop


def score_documents(
    docs: DataFrame,
    train: str,
    id_col: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    rounds: int = 2,
) -> DataFrame:
    """Log10 likelihood of every whole text under the lattice model learnt from the rows where `train` is true.

    Returns id, train, n_tokens, n_known, train_tokens, base_score (add-one word unigram), score, spelled_score.
    """
    spark = docs.sparkSession
    path = vocabulary or tokenizer_file("piece_bpe_32k.model")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(train).alias("train"))
    words = stash(count_words(docs, "text", "train"), "words")
    real = F.length("word") > 0
    n, v, ends, once, twice = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)),
        F.count_if(F.col("c") > 0),
        F.coalesce(F.sum(F.when(~real, F.col("c"))), F.lit(0)),
        F.count_if(real & (F.col("c") == 1)),
        F.count_if(real & (F.col("c") == 2)),
    ).first()
    logs, log_stop = fit_pieces(words, path, rounds)
    known = v - (ends > 0)
    cut = min(0.9, max(0.1, once / (once + 2.0 * twice))) if once else 0.5
    new, end = max(cut * known, 0.5), max(ends, 0.5)  # masses of new words and of the end
    mass = n - ends - cut * known + new + end
    log_new, log_end = float(np.log(new / mass)), float(np.log(end / mass))
    log_word = float(np.log1p(-end / mass))

    def price(batches):
        for b in in_bulk(batches):
            found = b.column(0).to_pylist()
            at = [i for i, w in enumerate(found) if w]
            below = np.zeros(len(found))
            below[at] = spell([found[i] for i in at], pieces(path), logs) + log_stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys_of(found), pa.binary()), b.column(1), pa.array(below)], ["key", "c", "below"]
            )

    lattices = stash(words.mapInArrow(price, "key binary, c long, below double"), "lattices")
    is_end, ten = F.length("key") == 0, float(np.log10(np.e))
    whole = F.log10((F.col("c") - F.lit(cut)) / F.lit(float(mass)) + F.exp(F.col("below") + F.lit(log_new)))
    priced = lattices.select(
        "key",
        "c",
        F.log10((F.col("c") + 1) / F.lit(n + v + 1.0)).alias("base"),
        F.when(is_end, F.lit(log_end * ten)).when(F.col("c") > 0, whole).otherwise(
            (F.col("below") + F.lit(log_new)) * ten
        ).alias("score"),
        F.when(is_end, F.lit(log_end * ten)).otherwise((F.col("below") + F.lit(log_word)) * ten).alias("spelled"),
    )
    least = max(1, -(-n // HEAVY))
    top = priced.where((F.col("c") >= least) | (F.length("key") == 0)).collect()  # HEAVY + 1 rows of LONG bytes at most
    sent = spark.sparkContext.broadcast((
        [bytes(r.key) for r in top],
        np.array([r.c > 0 for r in top], bool),
        np.array([r.base for r in top], float),
        np.array([r.score for r in top], float),
        np.array([r.spelled for r in top], float),
    ))

    def look_up(batches):
        from pyspark import TaskContext

        names, known_, bases, scores, spelt = sent.value
        table = dict(zip(names, range(len(names)), strict=True))
        end_at, get = table[END] if END in table else -1, table.get
        uid = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            rows, word_rows = [], []
            for key, x, learn in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                uid += 1
                found = keys_of(tokens(x))
                at = np.array([get(w, -1) for w in found] + [end_at], np.int64)
                seen = at[at >= 0]
                rows.append(
                    (
                        uid,
                        key,
                        learn,
                        b" %d" % uid,
                        len(at),
                        int(known_[seen].sum()),
                        float(bases[seen].sum()),
                        float(scores[seen].sum()),
                        float(spelt[seen].sum()),
                        1,
                    )
                )
                rare = Counter([found[i] for i in np.flatnonzero(at[:-1] < 0)])
                word_rows += [(uid, key, learn, w, 0, 0, 0.0, 0.0, 0.0, k) for w, k in rare.items()]
                if len(word_rows) > 50_000:
                    yield as_batch(rows + word_rows)
                    rows, word_rows = [], []
            if rows or word_rows:
                yield as_batch(rows + word_rows)

    kinds = [
        pa.int64(),
        docs_type(docs),
        pa.bool_(),
        pa.binary(),
        pa.int64(),
        pa.int64(),
        pa.float64(),
        pa.float64(),
        pa.float64(),
        pa.int64(),
    ]
    names = ["uid", "id", "train", "w", "n_tokens", "known", "b", "s", "z", "k"]

    def as_batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    # a row for each document (its key, a space and digits, meets no word) and one for each rarer word in it
    uses = docs.mapInArrow(
        look_up,
        f"uid long, id {docs.schema['id'].dataType.simpleString()}, train boolean, w binary, n_tokens long, known long, b double, s double, z double, k long",
    )
    met = uses.join(priced.where((F.col("c") < least) & (F.length("key") > 0)), uses.w == priced.key, "left")
    plus = lambda mine, other: (F.col(mine) + F.coalesce(other, F.lit(0.0)) * F.col("k")).alias(mine)
    known_now = (F.col("known") + F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known")
    rare = met.select(
        "uid", "id", "train", "n_tokens", known_now, plus("b", "base"), plus("s", "score"), plus("z", "spelled")
    )
    sums = [
        F.sum(a).alias(out) for a, out in (
            ("n_tokens", "n_tokens"), ("known", "n_known"), ("b", "base_score"), ("s", "score"), ("z", "spelled_score")
        )
    ]
    out = rare.groupBy("uid", "id", "train").agg(*sums)
    return out.select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "spelled_score",
    )


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["id"].dataType)


def op1_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """Score all documents; those whose crc32(doc_id) mod 7 is 2 are held out of the counts and the fit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn(
        "_train", ~remainder("doc_id", 7, 2)
    )
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score"]
    return score_documents(docs, "_train").select("doc_id", (~F.col("train")).alias("held_out"), *columns)
