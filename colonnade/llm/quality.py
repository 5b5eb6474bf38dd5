"""Quality scores from a factorisation machine.

Features of a text are its distinct hashed words, structure statistics and metadata taken
from the text itself (its lengths); language, source and ids are no features.  The score
is the logistic of  w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,  and the pairwise
part costs linear time by  1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Fitting uses at most ``sample`` labelled rows, those of least hash, by AdaGrad on the
driver; only their features are collected.  Scoring is a map over all documents without
any exchange.

Defined results: null and empty texts get the score of the empty feature set; unlabelled,
null or repeated labels are allowed (repeats count once per row, within the sample);
repeated documents are scored one by one; a null doc_id is scored and not held out; extra
columns are ignored, whatever their names; an empty table gives no row; without usable
labels every score is 0.5.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, hash64, texts_of, tune, word_lists

BUCKETS, RANK, STATS = 1 << 15, 8, 20
_LETTER = re.compile(rb"[a-z\x80-\xff]")
_PLAIN = re.compile(rb"^[\"'(\xc2\xab]*[a-z\x80-\xff]+(?:['\-][a-z\x80-\xff]+)*[.,;:!?)\"']?$")


def _kind(word: bytes) -> int:
    """In one number: bucket (20 bits), has no letter, is no plain word, length (from bit 22)."""
    return hash64(word) % BUCKETS | (not _LETTER.search(word)) << 20 | (not _PLAIN.match(word)) << 21 | len(word) << 22


def features(text: str, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word buckets, STATS structure and length statistics) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    stats = np.zeros(STATS)
    if not words:
        return np.zeros(0, np.int64), stats
    got = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    bucket, length = got & 0xFFFFF, got >> 22
    n, size = len(words), len(raw)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = byte[65:91].sum(), byte[97:123].sum(), byte[48:58].sum()
    blank = byte[[9, 10, 13, 32]].sum()
    stop = byte[[33, 34, 39, 44, 46, 58, 59, 63]].sum()
    symbol = size - upper - lower - digit - blank - stop - byte[128:].sum()
    lines = text.split("\n")
    distinct = len(set(words))
    stats[:] = (
        upper / size, digit / size, blank / size, stop / size, symbol / size, byte[128:].sum() / size, byte[33] / size, byte[124] / size,
        (got >> 20 & 1).mean(), (got >> 21 & 1).mean(), length.mean() / 10, length.std() / 10, distinct / n, 1 - len(set(lines)) / len(lines),
        np.log1p(n) / 10, np.log1p(size) / 10, np.log1p(len(lines)) / 10, np.log1p(n / len(lines)) / 10, np.bincount(bucket, minlength=1).max() / n, 1.0,
    )
    return np.unique(bucket), stats


class Machine:
    """A factorisation machine over BUCKETS hashed words and STATS statistics."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = BUCKETS + STATS
        self.w0, self.w, self.v = 0.0, np.zeros(n), r.normal(0, 0.01, (n, RANK))
        self.mean, self.std, self.fitted = np.zeros(STATS), np.ones(STATS), False

    def inputs(self, ids: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.full(len(ids) + STATS, 1 / np.sqrt(max(1, len(ids))))
        x[len(ids) :] = np.clip((stats - self.mean) / self.std, -6, 6) / np.sqrt(STATS)
        return np.concatenate([ids, np.arange(BUCKETS, BUCKETS + STATS)]), x

    def raw(self, ids: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        s = vx.sum(axis=0)
        return self.w0 + self.w[ids] @ x + 0.5 * float(s @ s - (vx * vx).sum()), s

    def score(self, ids: np.ndarray, stats: np.ndarray) -> float:
        if not self.fitted:
            return 0.5
        z, _ = self.raw(*self.inputs(ids, stats))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Machine:
        y = np.array([r[2] for r in rows], float)
        if len(rows) < 2 or y.min() == y.max():
            return self
        stats = np.array([r[1] for r in rows])
        self.mean, self.std, self.fitted = stats.mean(axis=0), stats.std(axis=0) + 1e-6, True
        made = [self.inputs(r[0], r[1]) for r in rows]
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        gw, gv, g0 = np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8), 1e-8
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # between the natural and the even balance
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, x = made[i]
                z, s = self.raw(ids, x)
                g = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
                if abs(g) < 0.01:
                    continue  # fits already
                v = self.v[ids]
                dw = g * x + decay * self.w[ids]
                dv = g * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                g0 += g * g
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.5 * rate * dv / np.sqrt(gv[ids])
                self.w0 -= rate * g / np.sqrt(g0)
        return self


def _labelled(batches):
    table = WordTable(_kind)
    for batch in batches:
        found = [features(t, table) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["doc_id", "label", "ids", "stats"])


def may_learn(modulus: int, fold: int, doc_id=None):
    """Whether a row is outside of the held-out fold: crc32 of doc_id as text, mod ``modulus``, isn't ``fold``."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) != fold


def least_rows(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of least hash of doc_id."""
    rest = [F.xxhash64(c) for c in rows.columns if c != "doc_id"]
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", *rest).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, fold: int, sample: int) -> DataFrame:
    """(doc_id, text, label) of ``sample`` labels outside of the held-out fold, those of least hash.

    Repeated doc_ids give more rows; what is made of them is bounded by ``least_rows``.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(may_learn(modulus, fold) & F.col("label").isin(0, 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(least_rows(usable, sample)), "doc_id")  # at most ``sample`` rows of two numbers


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, label, ids, stats): features of at most ``sample`` labelled rows."""
    found = labelled_sample(docs, labels, "quality", 5, 0, sample).select("doc_id", "label", "text")
    return least_rows(found.mapInArrow(_labelled, "doc_id long, label int, ids binary, stats binary"), sample)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> Machine:
    """Fitted on labelled rows whose crc32 of the doc_id's text mod 5 isn't 0."""
    tune(docs.sparkSession)
    rows = labelled_rows(docs, labels, sample).collect()
    rows = sorted((r["label"], bytes(r["stats"]), bytes(r["ids"])) for r in rows)
    return Machine().fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(s), y) for y, s, i in rows])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 3000, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; with ``keep`` its row too, as the struct ``_row``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_quality(docs, labels, sample))
    wanted = docs.columns if keep else ["doc_id", "text"]
    at = wanted.index("text")
    # columns travel by number, so their names meet nothing; the text travels once
    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") if c == "text" else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(wanted)])

    def run(batches):
        table, machine = WordTable(_kind), model.value
        for batch in batches:
            score = pa.array([machine.score(*features(t, table)) for t in texts_of(batch, f"c{at}")], pa.float64())
            stay = [f"c{i}" for i in range(len(wanted)) if keep or i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), score], names=[*stay, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema) if keep or i != at)
    out = rows.mapInArrow(run, f"{fields}, score double")
    doc_id = F.col(f"c{wanted.index('doc_id')}").cast("long")
    held = F.coalesce(~may_learn(5, 0, doc_id), F.lit(False)).alias("held_out")
    return out.select(doc_id.alias("doc_id"), held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *([F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(wanted)]).alias("_row")] if keep else []))
