"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

A text's UTF-8 bytes are read in consecutive windows of ``STEPS`` bytes. In each window one recurrent layer runs forwards
and one backwards; at every position their two states give a probability for each language, so every byte of a whole text
is labelled. A document's probabilities are the means over its positions. Gates are piecewise linear and the candidate
state is softsign, which cost a fraction of exponentials. Training is backpropagation through time with Adam on windows of
a bounded sample of labelled rows, which holds every language; the fitted arrays (about 50 KB) are broadcast and one narrow scan predicts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Repeated rows get equal results. Without a
single row to learn from, every text is ``und``; of equal probabilities the first language in order counts. A row whose id is null counts as held out. Extra columns are ignored by
``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, parts

#: Bytes of a window.
STEPS = 64
#: Units of each direction.
UNITS = 8
#: Labelled rows that training sees at most (about, those with small hashes), and windows of each.
TRAIN_ROWS = 2_000
TRAIN_WINDOWS = 8
#: Rows that training sees, about, of a language too rare for the sample.
LANGUAGE_ROWS = 100
UPDATES = 300
BATCH = 256
UNKNOWN = "und"
_WIDE = 2048  # windows that run side by side
_letter = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows, one a row, the last of a text padded by zero bytes; and each text's number of windows."""
    padded = [t + bytes(-len(t) % STEPS) for t in texts]
    return np.frombuffer(b"".join(padded), np.uint8).reshape(-1, STEPS), np.array([len(p) // STEPS for p in padded], np.int64)


@dataclass
class BiGru:
    """table: what a byte adds to the gates (direction, 3 units, byte); u: recurrent weights; v, c: output layer."""

    languages: list[str]
    table: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, languages: list[str], units: int, seed: int) -> BiGru:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1] if shape[-1] < 256 else 4), shape).astype(np.float32)
        return cls(languages, draw(2, 3 * units, 256), draw(2, 3 * units, units), draw(len(languages), 2 * units), np.zeros((len(languages), 1), np.float32))

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (steps, batch) bytes. The states of both directions at every position: (steps, 2 units, batch)."""
        k, (steps, batch) = self.u.shape[2], x.shape
        h, out = np.zeros((2, k, batch), np.float32), np.empty((steps, 2 * k, batch), np.float32)
        gate, pre = np.empty((2, 3 * k, batch), np.float32), np.empty((2, 3 * k, batch), np.float32)
        for t in range(steps):
            np.take(self.table[0], x[t], axis=1, out=gate[0], mode="clip")
            np.take(self.table[1], x[steps - 1 - t], axis=1, out=gate[1], mode="clip")
            np.matmul(self.u, h, out=pre)
            zr = gate[:, : 2 * k] + pre[:, : 2 * k]
            zr *= 0.25
            zr += 0.5
            np.minimum(zr, 1, out=zr)
            np.maximum(zr, 0, out=zr)
            z, r = zr[:, :k], zr[:, k:]
            n = r * pre[:, 2 * k :]
            n += gate[:, 2 * k :]
            size = np.abs(n)
            size += 1
            n /= size
            if keep is not None:
                keep.append((h, z, r, n, pre[:, 2 * k :].copy()))
            h = h - n
            h *= z
            h += n
            out[t, :k], out[steps - 1 - t, k:] = h[0], h[1]
        return out

    def probabilities(self, out: np.ndarray) -> np.ndarray:
        """(steps, languages, batch) from the states."""
        p = np.matmul(self.v, out)
        p += self.c
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def positions(self, text: bytes) -> np.ndarray:
        """The most probable language's number at every byte of the text."""
        x, _ = windows([text])
        return self.probabilities(self.states(np.ascontiguousarray(x.T))).argmax(1).T.reshape(-1)[: len(text)]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the means of the positions' probabilities; zeros for an empty text."""
        x, many = windows(texts)
        sums = np.empty((len(x), len(self.languages)), np.float64)
        for at in range(0, len(x), _WIDE):
            w = np.ascontiguousarray(x[at : at + _WIDE].T)
            p = self.probabilities(self.states(w))
            p *= (w > 0)[:, None]
            sums[at : at + _WIDE] = p.sum(0).T
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, np.repeat(np.arange(len(texts)), many), sums)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-9)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of one batch of windows x (batch, steps) with labels y."""
        x = np.ascontiguousarray(x.T)
        k, (steps, batch) = self.u.shape[2], x.shape
        keep: list = []
        out = self.states(x, keep)
        p = self.probabilities(out)
        weight = (x > 0) / max(1, int((x > 0).sum()))
        loss = -float((np.log(p[:, y, np.arange(batch)] + 1e-9) * weight).sum())
        p[:, y, np.arange(batch)] -= 1
        p *= weight[:, None].astype(np.float32)
        gv, gc = np.einsum("tlb,tkb->lk", p, out, optimize=True), p.sum((0, 2))[:, None]
        dout = np.matmul(self.v.T, p)
        gu, gtable = np.zeros_like(self.u), np.zeros_like(self.table)
        dgate = np.empty((steps, 2, 3 * k, batch), np.float32)
        dh, ut = np.zeros((2, k, batch), np.float32), np.ascontiguousarray(self.u.transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            h, z, r, n, a = keep[t]
            dh[0] += dout[t, :k]
            dh[1] += dout[steps - 1 - t, k:]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            da = dgate[t]
            da[:, :k] = dh * (h - n) * (0.25 * ((z > 0) & (z < 1)))
            da[:, k : 2 * k] = dn * a * (0.25 * ((r > 0) & (r < 1)))
            da[:, 2 * k :] = dn * r
            gu += np.matmul(da, h.transpose(0, 2, 1))
            dh = dh * z + np.matmul(ut, da)
            da[:, 2 * k :] = dn
        for d in (0, 1):
            byte = (x if d == 0 else x[::-1]).reshape(-1)
            rows = dgate[:, d].transpose(1, 0, 2).reshape(3 * k, -1)
            for j in range(3 * k):
                gtable[d, j] = np.bincount(byte, rows[j], 256)
        return loss, [gtable, gu, gv, gc]

    def fit(self, x: np.ndarray, y: np.ndarray, updates: int, seed: int) -> BiGru:
        """Adam on batches that hold every language about equally often."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        params = [self.table, self.u, self.v, self.c]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for i in range(1, updates + 1):
            pick = np.concatenate([rng.choice(rows, BATCH // len(of) + 1) for rows in of])
            _, grads = self.step(x[pick], y[pick])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            rate = 0.02 * (1 - i / (updates + 1)) ** 0.5 * min(1.0, 1.0 / (norm + 1e-9))
            for p, g, (m, s) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; true for a null id."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS, units: int = UNITS, updates: int = UPDATES, seed: int = 7) -> BiGru | None:
    """Fit on about ``max_rows`` labelled rows, of each ``TRAIN_WINDOWS`` windows spread over the text; None without any.

    Every language with a labelled text is learned: of one that the sample would hold fewer than ``LANGUAGE_ROWS`` rows of,
    about that many are taken, or all it has.
    """
    text = F.col(text_col)
    picked = rows.filter(text.isNotNull() & (F.length(text) > 0) & F.col(lang_col).isNotNull()).select(text.alias("t"), F.col(lang_col).alias("l"))
    slices = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.substring(F.col("t"), F.lit(1) + F.floor(i * F.length("t") / TRAIN_WINDOWS).cast("int"), F.lit(STEPS)))
    picked = _sample(picked, max_rows)
    found = sorted((r[0], r[1]) for r in picked.select("l", F.array_distinct(slices)).collect())
    languages = sorted({r[0] for r in found})
    pairs = [(s.encode()[:STEPS], languages.index(r[0])) for r in found for s in r[1] if s]
    if not pairs:
        return None
    x, _ = windows([p[0] for p in pairs])
    return BiGru.new(languages, units, seed).fit(x, np.array([p[1] for p in pairs]), updates, seed)


def _sample(picked: DataFrame, max_rows: int) -> DataFrame:
    """Distinct rows of (t, l) whose hash is under their language's threshold, which follows from the counts of all languages."""
    counts = {r[0]: r[1] for r in picked.groupBy("l").count().collect()}
    total, end = sum(counts.values()), (1 << 63) - 1
    cuts = {lang: min(end, -(1 << 63) + (1 << 64) * max(max_rows * n, LANGUAGE_ROWS * total) // (n * total)) for lang, n in counts.items()}
    if total <= max_rows or not cuts:
        cuts = dict.fromkeys(cuts, end)
    cut = F.lit(end)
    for lang, c in sorted(cuts.items()):
        cut = F.when(F.col("l") == lang, F.lit(c)).otherwise(cut)
    return picked.withColumn("_h", F.xxhash64("t", "l")).filter(F.col("_h") <= cut).dropDuplicates(["_h"]).drop("_h")


def judge(model: BiGru | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    known = [i for i, t in enumerate(texts) if t and model and _letter.search(t)]
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if known:
        p = model.pooled([texts[i].encode() for i in known])
        for i, k, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            lang[i], score[i] = model.languages[k], s
    return lang, score


def predict(df: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        lang, score = judge(shared.value, batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(batch.num_rows, pa.string()), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "text", "held_out", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return arrow_map(src, run, f"id {kind}, text string, held_out boolean, lang_pred string, score double").select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def keep_known(df: DataFrame, model: BiGru | None, text_col: str = "text", min_score: float = 0.35) -> DataFrame:
    """The rows, all columns, whose text has a language with a pooled probability of at least ``min_score``."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches):
        for batch in parts(batches, at):
            lang, score = judge(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([g != UNKNOWN and s >= min_score for g, s in zip(lang, score, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
