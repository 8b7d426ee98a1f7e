"""Language of whole texts: a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows of WINDOW bytes (all of it, none left out). In each window one recurrent layer runs forwards
and one backwards; every position gets a distribution over the languages from both states; a document's distribution is
the mean over all its positions. Training is backpropagation through time with Adam on a sample of bounded rows: the
FIT_DOCS labelled documents that come first by a hash of their row, whole: all their windows reach the driver, and rounds take them in a
shuffled order, class by class in turn. The weights are of fixed size; labelling is one pass over the corpus without a
shuffle. A state goes over WINDOW bytes in fitting and in labelling.

Cases: a null text or one without a letter is `und` with score 0; fewer than two learnt languages give that language
(or `und` if none) with score 1; a null doc_id is kept and counts as not held out; repeated rows get equal results;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

WINDOW = 256
HIDDEN = 8
FIT_DOCS = 2000
#: Windows of one pass.
CHUNK = 1024


def _gates(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "x": rng.normal(0, 0.3, (3 * HIDDEN, 257)).astype(np.float32),
        "u": (rng.normal(0, 1, (3 * HIDDEN, HIDDEN)) / HIDDEN**0.5).astype(np.float32),
    }


def _hard(a: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    a *= 0.25
    a += 0.5
    return np.clip(a, 0.0, 1.0, out=a)


class ByteGRU:
    """Weights of both directions and of the output layer. Byte 256 pads the last window of a text."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.fwd, self.bwd = _gates(rng), _gates(rng)
        self.out = rng.normal(0, 0.3, (len(classes), 2 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros((len(classes), 1), np.float32)

    def _run(self, w: dict[str, np.ndarray], x: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
        """States after each position: (positions, HIDDEN, windows)."""
        h = np.zeros((HIDDEN, x.shape[1]), np.float32)
        states = np.empty((x.shape[0], HIDDEN, x.shape[1]), np.float32)
        for t in order:
            a = np.take(w["x"], x[t], axis=1)
            u = w["u"] @ h
            a[: 2 * HIDDEN] += u[: 2 * HIDDEN]
            gates = _hard(a[: 2 * HIDDEN])
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            c = a[2 * HIDDEN :]
            c += r * u[2 * HIDDEN :]
            np.tanh(c, out=c)
            new = states[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if keep is not None:
                keep.append((t, h, z, r, c, u[2 * HIDDEN :]))
            h = new
        return states

    def positions(self, x: np.ndarray):
        """Distribution over the classes at each position, one (classes, windows) array after the other."""
        f = self._run(self.fwd, x, range(len(x)))
        b = self._run(self.bwd, x, range(len(x) - 1, -1, -1))
        for t in range(len(x)):
            y = self.out[:, :HIDDEN] @ f[t]
            y += self.out[:, HIDDEN:] @ b[t]
            y += self.bias
            y -= y.max(axis=0)
            np.exp(y, out=y)
            y /= y.sum(axis=0)
            yield y

    def window_sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of the distributions over the real positions of each window: (windows, classes)."""
        total = np.zeros((len(self.classes), x.shape[1]), np.float32)
        for t, y in enumerate(self.positions(x)):
            y *= x[t] < 256
            total += y
        return total.T

    def step(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over real positions, and its gradients (backpropagation through time)."""
        kf: list = []
        kb: list = []
        f = self._run(self.fwd, x, range(len(x)), kf)
        b = self._run(self.bwd, x, range(len(x) - 1, -1, -1), kb)
        real = x < 256
        n = max(1, int(real.sum()))
        states = np.concatenate([f, b], axis=1)
        y = np.einsum("kh,thb->tkb", self.out, states) + self.bias
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        right = np.take_along_axis(y, np.broadcast_to(label, (len(x), 1, len(label))), axis=1)[:, 0]
        loss = float(-(np.log(right + 1e-9) * real).sum() / n)
        d = y
        d[:, label, np.arange(len(label))] -= 1
        d *= (real / n)[:, None, :]
        grads = {"out": np.einsum("tkb,thb->kh", d, states), "bias": d.sum(axis=(0, 2))[:, None]}
        back = np.einsum("kh,tkb->thb", self.out, d)
        for name, w, kept, part in (("fwd", self.fwd, kf, back[:, :HIDDEN]), ("bwd", self.bwd, kb, back[:, HIDDEN:])):
            gu, das = np.zeros_like(w["u"]), np.empty((len(x), 3 * HIDDEN, x.shape[1]), np.float32)
            dh = np.zeros((HIDDEN, x.shape[1]), np.float32)
            for t, h, z, r, c, uc in reversed(kept):
                dh = dh + part[t]
                dz = dh * (h - c) * 0.25 * ((z > 0) & (z < 1))
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * uc * 0.25 * ((r > 0) & (r < 1))
                du = np.concatenate([dz, dr, dc * r])
                gu += du @ h.T
                das[t] = np.concatenate([dz, dr, dc])
                dh = dh * z + w["u"].T @ du
            flat = x.ravel()
            gx = np.stack([np.bincount(flat, das[:, k].ravel(), 257) for k in range(3 * HIDDEN)]).astype(np.float32)
            grads[name + "x"], grads[name + "u"] = gx, gu
        return loss, grads

    def weights(self) -> dict[str, np.ndarray]:
        return {
            "fwdx": self.fwd["x"],
            "fwdu": self.fwd["u"],
            "bwdx": self.bwd["x"],
            "bwdu": self.bwd["u"],
            "out": self.out,
            "bias": self.bias,
        }

    def fit(
        self,
        windows: np.ndarray,
        labels: np.ndarray,
        rounds: int = 100,
        batch: int = 224,
        rate: float = 0.02,
        seed: int = 11,
    ) -> float:
        """Adam over batches of windows (rows of bytes), each class in a shuffled order of its own that begins anew when it
        is through; returns the last loss."""
        rng = np.random.default_rng(seed)
        w = self.weights()
        m = {k: np.zeros_like(v) for k, v in w.items()}
        s = {k: np.zeros_like(v) for k, v in w.items()}
        loss = 0.0
        by = [np.flatnonzero(labels == k) for k in range(len(self.classes))]
        by = [x for x in by if len(x)]
        share = max(1, batch // max(1, len(by)))
        turns = [np.concatenate([rng.permutation(x) for _ in range(-(-share * rounds // len(x)))]) for x in by]
        for i in range(1, rounds + 1):
            pick = np.concatenate([x[(i - 1) * share : i * share] for x in turns])
            loss, grads = self.step(np.ascontiguousarray(windows[pick].T), labels[pick])
            pace = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                w[k] -= (pace * m[k] / (1 - 0.9**i) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of whole texts, as rows of int16 (256: padding), and for each window the index of its text."""
    return windows_of_bytes([x.encode("utf-8", "replace") for x in texts])


def windows_of_bytes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    many = [-(-len(x) // WINDOW) for x in raw]
    out = np.full((sum(many), WINDOW), 256, np.int16)
    flat, at = out.reshape(-1), 0
    for x, n in zip(raw, many, strict=True):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8)
        at += n * WINDOW
    return out, np.repeat(np.arange(len(raw)), many)


def label_texts(
    model: ByteGRU | None, classes: list[str], texts: list[str | None]
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and full distribution of each text."""
    import regex

    letter = regex.compile(r"\p{L}")
    real = [i for i, x in enumerate(texts) if x is not None and letter.search(x)]
    probs = np.zeros((len(texts), max(1, len(classes))))
    if model is None:
        probs[real] = 1.0 if classes else 0.0
    else:
        k = 0
        while k < len(real):  # a few texts at a time, so that memory stays bounded
            end, size = k, 0
            while end < len(real) and (end == k or size < CHUNK * WINDOW):
                size += len(texts[real[end]])
                end += 1
            rows, owner = windows_of([texts[i] for i in real[k:end]])
            sums = np.concatenate(
                [model.window_sums(np.ascontiguousarray(rows[j : j + CHUNK].T)) for j in range(0, len(rows), CHUNK)]
            ).astype(float)
            for c in range(len(classes)):
                probs[real[k:end], c] = np.bincount(owner, sums[:, c], end - k)
            probs[real[k:end]] /= probs[real[k:end]].sum(axis=1, keepdims=True)
            k = end
    names = ["und"] * len(texts)
    if classes:
        for i in real:
            names[i] = classes[int(probs[i].argmax())]
    return names, np.clip(probs.max(axis=1), 0, 1), probs


def fit_language(
    docs: DataFrame,
    learn: str,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    fit_docs: int = FIT_DOCS,
) -> tuple[ByteGRU | None, list[str]]:
    """Train on the first `fit_docs` distinct labelled rows by hash, among those where `learn` is true.

    Their whole texts come to the driver; `fit_docs` bounds the rows, not the texts.
    """
    able = docs.where(F.col(learn) & F.col(label).isNotNull() & (F.length(text) > 0)).select(
        F.xxhash64(id_col, text, label).alias("h"), F.col(text).alias("t"), F.col(label).alias("l")
    )
    first = able.select("h").groupBy("h").agg(  # hashes only: no texts
        F.count(F.lit(1)).alias("same")
    ).orderBy("h").limit(fit_docs).select("h")
    found = able.join(F.broadcast(first), "h").select("h", "l", "t")
    rows = sorted(found.groupBy("h").agg(F.min("l").alias("l"), F.min("t").alias("t")).collect())
    classes = sorted({r.l for r in rows})
    if len(classes) < 2:
        return None, classes
    windows, owner = windows_of([r.t for r in rows])
    model = ByteGRU(classes)
    model.fit(windows, np.array([classes.index(r.l) for r in rows])[owner])
    return model, classes


def identify(docs: DataFrame, model: ByteGRU | None, classes: list[str], text: str = "text") -> DataFrame:
    """Adds lang_pred and score to all columns of docs."""
    from pyspark.sql.types import StructType

    def run(texts: pd.Series) -> pd.DataFrame:
        names, score, _ = label_texts(model, classes, [None if pd.isna(x) else x for x in texts])
        return pd.DataFrame({"lang_pred": names, "score": score})

    kind = StructType().add("lang_pred", "string").add("score", "double")
    clash = [c for c in ("lang_pred", "score", "_lid") if c in docs.columns]
    out = docs.drop(*clash).withColumn("_lid", F.pandas_udf(run, kind)(F.col(text)))
    return out.select("*", "_lid.lang_pred", "_lid.score").drop("_lid")


def op3_byte_gru(spark, sf_dir: str) -> DataFrame:
    """Language of all documents; those whose crc32(doc_id) mod 5 is 0 are held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("_held", remainder("doc_id", 5, 0))
    model, classes = fit_language(docs.withColumn("_learn", ~F.col("_held")), "_learn")
    return identify(docs.select("doc_id", "text", "_held"), model, classes).select(
        "doc_id", F.col("_held").alias("held_out"), "lang_pred", "score"
    )
