"""Toxicity scores by weak supervision.

Voters: lexicon terms (words, word beginnings of 3 to 6 letters, and beginnings that two
or more distinct words of the text share) and patterns (shouting, runs of exclamation
marks).  The lexicon is
mined from labelled rows, which is all that labels are used for: no list of words could
know the corpus's invented languages.  Of the rows a term stands in nine in ten are toxic,
and terms that stand in nearly the same rows as a stronger one are left out.  The lexicon
is dealt by strength to ``voters`` voters, so that each can speak in every language.

A generative label model is fitted on other documents, whose labels it never sees.  It
estimates by EM, from nothing but how the voters agree, how often each votes on toxic and
on other documents; it starts from the number of votes.  Given the hidden class, voters
are independent except where their conditional correlation, estimated from the
posterior-weighted residuals, is high: such voters form a group that counts as one.  Its
posteriors are the soft labels a linear classifier is trained on, with all mined terms and
patterns (also second person near a lexicon term, absence of any) as features.  Every text is scored whole.

Fitting uses at most ``sample`` labelled rows for the lexicon and ``sample`` documents for
the label model, those of least hash in disjoint shares of the rows that may be learned
from.  Terms are counted by an aggregation; the driver gets at most 8 * TERMS candidates
and which of them stand in the samples' rows.  The lexicon holds at most TERMS terms.
Scoring is a map over all documents without any exchange.

Defined results: null and empty texts get the score of no term; null labels are left out;
repeated documents are scored one by one; a null doc_id is scored and not held out; extra
columns are ignored, whatever their names; an empty table gives no row; without usable
labels every score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, texts_of, tune
from .quality import least_rows, may_learn

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{2,}\b){2}")
_BANG = re.compile(r"!{2,}|\?!")
#: Second-person pronouns of the four languages of the corpus.
_SECOND = frozenset("you your youre tu te toi vous votre du dich dir dein sie usted tú ti su".split())
PATTERNS = 4
TERMS = 2048
#: Toxic rows a lexicon term stands in at least, and their least share of its rows.
LEAST_ROWS, PRECISION = 3, 0.9


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) >> 1


def terms_of(word: str) -> list[int]:
    """Hashed terms a word holds: itself, and its beginnings, told apart by a mark."""
    return [_hash(word), *(_hash(f"{word[:k]}*") for k in range(3, 7) if len(word) >= k)]


#: Turns a term into the one that says that two or more distinct words of the text give it.
_SHARED = _hash("shared")


def terms_in(lists) -> set[int]:
    """All terms of a text's distinct words, given the terms of each, and the shared ones' marks."""
    once, more = set(), set()
    for terms in lists:
        for t in terms:
            (more if t in once else once).add(t)
    return once | {t ^ _SHARED for t in more}


def patterns(text: str, words: set[str], hits: int) -> tuple[int, ...]:
    return int(bool(_SHOUT.search(text))), int(bool(_BANG.search(text))), int(hits > 0 and not _SECOND.isdisjoint(words)), int(hits == 0)


def _counted(batches):
    """(term, toxic rows, other rows) of a batch of labelled texts."""
    table = WordTable(terms_of, 200_000)
    for batch in batches:
        rows = [np.fromiter(terms_in(map(table.__getitem__, set(_WORD.findall(text.lower())))), np.int64) for text in texts_of(batch)]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), [len(r) for r in rows])
        term, at = np.unique(flat, return_inverse=True)
        bad = np.bincount(at, weights=label, minlength=len(term)).astype(np.int64)
        good = np.bincount(at, minlength=len(term)) - bad
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], names=["term", "bad", "good"])


def _hits(candidates):
    """The candidate terms a text holds, and its patterns."""

    def run(batches):
        known = candidates.value
        table = WordTable(lambda w: [t for t in terms_of(w) if t in known or t ^ _SHARED in known], 500_000)
        for batch in batches:
            out, pattern = [], []
            for text in texts_of(batch):
                words = set(_WORD.findall(text.lower()))
                out.append(sorted(known & terms_in(map(table.__getitem__, words))))
                pattern.append(list(patterns(text, words, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.list_(pa.int64())), pa.array(pattern, pa.list_(pa.int64()))], names=["doc_id", "label", "terms", "patterns"])

    return run


def mine(rows: list[np.ndarray], y: np.ndarray, most: int = TERMS) -> list[int]:
    """Terms that mark the toxic class, by descending strength, none that repeats a stronger one."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    term, at = np.unique(flat, return_inverse=True)
    bad = np.bincount(at, weights=np.repeat(y, size), minlength=len(term))
    good = np.bincount(at, minlength=len(term)) - bad
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((good + 0.5) / (n0 + 1))
    z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    able = np.flatnonzero((bad >= LEAST_ROWS) & (bad >= PRECISION * (bad + good)) & (odds > 1.0) & (z > 2.5))
    order = able[np.lexsort((term[able], -z[able]))]
    where = {int(k): set() for k in order}
    for row, k in zip(np.repeat(np.arange(len(rows)), size).tolist(), at.tolist(), strict=True):
        if k in where:
            where[k].add(row)
    out: list[int] = []
    seen: dict[int, list[int]] = {}  # row -> kept terms that stand in it
    for k in order.tolist():
        met: dict[int, int] = {}
        for row in where[k]:
            for other in seen.get(row, ()):
                met[other] = met.get(other, 0) + 1
        if any(n > 0.9 * len(where[k] | where[other]) for other, n in met.items() if n > 0.9 * len(where[k])):
            continue
        for row in where[k]:
            seen.setdefault(row, []).append(k)
        out.append(int(term[k]))
        if len(out) == most:
            break
    return out


class LabelModel:
    """Accuracies and correlations of 0/1 votes of a hidden binary class, by EM.

    ``on`` and ``off`` are the odds of a vote on a toxic and on another document,
    ``correlation`` the voters' conditional correlations and ``weight`` what a vote counts.
    """

    def fit(self, votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
        p = start.astype(float)
        for _ in range(rounds):
            prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
            on = (votes.T @ p + 0.5) / (p.sum() + 1)  # P(vote | toxic)
            off = (votes.T @ (1 - p) + 0.5) / ((1 - p).sum() + 1)
            residual = votes - (np.outer(p, on) + np.outer(1 - p, off))
            scale = np.sqrt((residual**2).mean(axis=0)) + 1e-9
            corr = (residual.T @ residual) / len(votes) / np.outer(scale, scale)
            weight = 1 / np.maximum(1, (np.abs(corr) > 0.4).sum(axis=1))
            self.prior, self.on, self.off, self.weight, self.correlation = prior, on, off, weight, corr
            p = self.posterior(votes)
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.on / self.off) * self.weight, np.log((1 - self.on) / (1 - self.off)) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + votes @ yes + (1 - votes) @ no
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scorer:
    """A logistic classifier over mined terms and patterns."""

    def __init__(self):
        self.terms: dict[int, int] = {}
        self.w, self.bias = np.zeros(PATTERNS), -30.0

    def known_of(self, word: str) -> tuple[int, ...]:
        """Terms of a word that the lexicon holds, alone or shared."""
        return tuple(t for t in terms_of(word) if t in self.terms or t ^ _SHARED in self.terms)

    def score(self, text: str, table: WordTable) -> float:
        words = set(_WORD.findall(text.lower()))
        hit = [k for t in terms_in(map(table.__getitem__, words)) if (k := self.terms.get(t)) is not None]
        z = self.bias + float(self.w[:PATTERNS] @ np.array(patterns(text, words, len(hit)))) + float(sum(self.w[PATTERNS + k] for k in sorted(hit)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, labelled: list[np.ndarray], y: np.ndarray, rows: list[np.ndarray], pattern: np.ndarray, voters: int = 12) -> Scorer:
        """A lexicon from ``labelled`` rows of terms and ``y``; everything else from ``rows`` without labels."""
        if len(y) < 4 or y.min() == y.max() or not rows:
            return self
        lexicon = mine(labelled, y)
        self.terms = {t: k for k, t in enumerate(lexicon)}
        x = np.zeros((len(rows), PATTERNS + len(lexicon)), np.float32)
        for i, r in enumerate(rows):
            for t in r.tolist():
                k = self.terms.get(t)
                if k is not None:
                    x[i, PATTERNS + k] = 1
        hits = x[:, PATTERNS:].any(axis=1)
        x[:, :2], x[:, 2], x[:, 3] = pattern[:, :2], pattern[:, 2] * hits, ~hits
        if not lexicon:
            return self
        spoken = np.stack([x[:, PATTERNS + v :: voters].any(axis=1) for v in range(min(voters, len(lexicon)))], axis=1)
        votes = np.concatenate([x[:, :2], spoken], axis=1).astype(float)  # the other patterns follow from the lexicon's votes
        self.model = LabelModel().fit(votes, 0.98 - 0.96 * 0.5 ** spoken.sum(axis=1))
        soft = self.model.posterior(votes)
        # logistic regression on the posteriors, by full-batch Adam with a quadratic penalty
        w, b = np.zeros(x.shape[1], np.float32), float(np.log(np.clip(soft.mean(), 1e-3, 0.999) / (1 - np.clip(soft.mean(), 1e-3, 0.999))))
        m = np.zeros(len(w) + 1)
        v = np.zeros(len(w) + 1)
        for step in range(1, 401):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            gap = (p - soft).astype(np.float32)
            g = np.append(x.T @ gap / len(soft) + 1e-5 * w, gap.mean())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
        self.w, self.bias = w.astype(float), b
        return self


#: Of FOLDS shares of the rows that may be learned from, the last is the label model's.
FOLDS = 4


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 5000) -> Scorer:
    """Fitted on rows whose crc32 of the doc_id's text mod 3 isn't 1."""
    tune(docs.sparkSession)
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("share")), F.lit(FOLDS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(may_learn(3, 1))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(may_learn(3, 1) & F.col("label").isin(0, 1))
    marked = least_rows(marked.where(share < FOLDS - 1), sample)
    plain = least_rows(texts.where(share == FOLDS - 1).select("doc_id", F.lit(None).cast("int").alias("label")), sample)
    # terms are counted where they are; those that cannot be in the lexicon stay there
    counts = texts.join(F.broadcast(marked), "doc_id").mapInArrow(_counted, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    able = counts.where(f"bad >= {LEAST_ROWS} and bad >= {PRECISION} * (bad + good)").orderBy(F.desc("bad"), "term").limit(8 * TERMS)
    candidates = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in able.select("term").collect()))
    chosen = F.broadcast(marked.union(plain))  # at most two samples of two numbers
    hits = texts.join(chosen, "doc_id").mapInArrow(_hits(candidates), "doc_id long, label int, terms array<long>, patterns array<long>")
    got = least_rows(hits, 2 * sample).collect()  # repeated doc_ids must not exceed the samples
    rows = sorted(map(tuple, got), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
    terms = lambda some: [np.array(r[2], np.int64) for r in some]
    known, other = [r for r in rows if r[1] is not None], [r for r in rows if r[1] is None]
    return Scorer().fit(terms(known), np.array([r[1] for r in known], int), terms(other), np.array([r[3] for r in other]).reshape(-1, PATTERNS))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 5000) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample))

    def run(batches):
        scorer = model.value
        table = WordTable(scorer.known_of, 500_000)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer.score(t, table) for t in texts_of(batch)], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
