"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of word shingles.  Equal sets are folded into one class first.  Every
class gets a signature of ``bands * rows`` minima; classes that agree on a whole band
meet in a bucket.  A bucket yields star edges from a leader to its members, never all
pairs.  Each candidate pair's signatures are compared batch by batch; after each batch
the posterior of the similarity, given the matches so far and a uniform prior, says with
what probability it reaches the threshold, and the pair is dropped once that falls below
``miss``.  Survivors are verified exactly on their full shingle sets.

A star can leave a link unseen when its leader resembles neither end enough.  So once linked
classes are merged into components, every bucket that still holds several compares the
members outside its leader's component with all members of other components, in tasks of
bounded blocks: by the Bayesian test, then on full sets, and only links that join two
components leave a task.  No bucket is capped, and no pair across components that shares
a band is skipped.

Scale: exchanged are (band hash, class) rows, then signatures of candidates, then texts of
survivors.  A group of copies, even a third of all rows, is one class before banding; a
group of near copies costs a star.  Hot buckets, met by a group of near copies that may be
a third of all rows, are met by a broadcast of their leaders.  Nothing but counts reaches
the driver.

Defined results: null texts and texts without words have an empty set and link with
nothing; texts of fewer words than a shingle are one shingle of all their words; rows that
repeat a doc_id are judged together under that id; a null doc_id links with nothing and is
kept; extra columns are ignored, whatever their names; an empty table gives no row.
Shingles are compared by 64-bit hashes, so two sets of 10^5 shingles meet falsely in one of
them with odds of 10^-9.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordTable, connected_components, met_by, hash64, mix64, texts_of, tune, word_lists

BANDS, ROWS, BATCH = 32, 6, 24
#: Members of a bucket in a task's two sides.
LEFT, RIGHT = 2048, 4096
#: Shingles of a side's full sets, and so about the words of its texts.
WEIGHT = 8_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _multipliers(number: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_131)
    return r.integers(0, 1 << 32, number, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, number, dtype=np.uint32)


def shingle_set(words: list[bytes], table: WordTable, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``width``-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _P + h[k : k + n]
    return np.unique(mix64(out))


def signature(shingles: np.ndarray, number: int) -> np.ndarray:
    """``number`` 32-bit minima under affine maps of hashed shingles."""
    a, b = _multipliers(number)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(number, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048, None] * a[None, :]
        part += b
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _table() -> WordTable:
    return WordTable(hash64)


def set_id(shingles: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit id of a set: the xxh3 digest of its sorted hashes."""
    return int(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles) + (seed << 32))) - (1 << 63)


#: Seed of the second digest, which tells sets of one id apart.
_PROOF = 1 << 30


def _signed(width: int, bands: int, rows: int, seed: int):
    """doc_id -> set size, set id and second digest, signature, band hashes."""
    names = ["doc_id", "n_shingles", "sid", "proof", "sig", "bands"]

    def run(batches):
        table = _table()
        for batch in batches:
            size, sid, proof, sig, band = [], [], [], [], [np.zeros(0, np.uint64)]
            for words in word_lists(texts_of(batch)):
                s = shingle_set(words, table, width)
                size.append(len(s))
                sid.append(set_id(s, seed))
                proof.append(set_id(s, _PROOF))
                m = signature(s, bands * rows)
                sig.append(m.tobytes())
                h = np.arange(bands, dtype=np.uint64)
                for column in m.reshape(bands, rows).T:
                    h = mix64(h * _P + column)
                band.append(h)
            flat = pa.array(np.concatenate(band).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sid, pa.int64()), pa.array(proof, pa.int64()), pa.array(sig, pa.binary()), lists], names=names)

    return run


@lru_cache(maxsize=16)
def least_matches(threshold: float, number: int, batch: int, miss: float) -> tuple[int, ...]:
    """The least matches after 1, 2, ... batches at which P(similarity >= threshold) >= ``miss``.

    The posterior after m matches of n is Beta(m + 1, n - m + 1).
    """
    grid = np.linspace(0, 1, 20_001)[1:-1]
    upper = grid >= threshold
    out = []
    for n in range(batch, number + 1, batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
            p = np.exp(log)
            if p[upper].sum() / p.sum() >= miss:
                break
        out.append(m)
    return tuple(out)


def _survivors(threshold: float, number: int, batch_size: int, miss: float):
    least = least_matches(threshold, number, batch_size, miss)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, -1) for c in ("sig_a", "sig_b"))
            live, matches = np.arange(n), np.zeros(n, np.int64)
            for k, need in enumerate(least):
                part = slice(k * batch_size, (k + 1) * batch_size)
                matches[live] += (x[live, part] == y[live, part]).sum(axis=1)
                live = live[matches[live] >= need]
            take = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return run


def _across(width: int, percent: int, bands: int, batch_size: int, miss: float, seed: int):
    """Links that join components among a block of outside members and a chunk of all members.

    A pair is judged in the first band it shares.  Candidates are verified by falling number
    of matches, and a link merges its components here at once, so at most one link a merger
    leaves the task.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side, band = table.column("left").to_numpy(zero_copy_only=False).astype(bool), table.column("band")[0].as_py()
        sid, component = table.column("sid").to_numpy(), table.column("component").to_numpy().copy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(sid), -1)
        least = least_matches(percent / 100, sig.shape[1], batch_size, miss)
        texts, words, sets = table.column("text"), _table(), {}

        def full(i: int) -> np.ndarray:
            if sid[i] not in sets:
                s = shingle_set(word_lists([texts[i].as_py() or ""])[0], words, width)
                if set_id(s, seed) != sid[i]:  # another text under the same doc_id
                    return np.zeros(0, np.uint64)
                sets[sid[i]] = s
            return sets[sid[i]]

        right, rows = np.flatnonzero(~side), []
        for i in np.flatnonzero(side):
            live, matches = right[component[right] != component[i]], 0
            for k, need in enumerate(least):
                part = slice(k * batch_size, (k + 1) * batch_size)
                matches = matches + (sig[live, part] == sig[i, part]).sum(axis=1)
                keep = matches >= need
                live, matches = live[keep], matches[keep]
            shared = (sig[live] == sig[i]).reshape(len(live), bands, sig.shape[1] // bands).all(axis=2)
            first = shared.any(axis=1) & (shared.argmax(axis=1) == band)
            for j in live[first][np.argsort(-matches[first], kind="stable")]:
                if component[i] == component[j]:
                    continue
                one, other = full(i), full(j)
                common = len(np.intersect1d(one, other, assume_unique=True))
                if common and 100 * common >= percent * (len(one) + len(other) - common):
                    rows.append((min(sid[i], sid[j]), max(sid[i], sid[j])))
                    component[component == component[j]] = component[i]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

    return run


def _verified(width: int, percent: int, seed: int):
    """Pairs whose full sets reach ``percent``; a text that isn't the class's own is skipped."""

    def run(batches):
        table, last = _table(), (None, None, None)
        for batch in batches:
            out = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            x, y = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            for i in range(len(a)):
                if last[0] != a[i] or last[1] != x[i]:
                    last = (a[i], x[i], shingle_set(word_lists([x[i]])[0], table, width))
                one, other = last[2], shingle_set(word_lists([y[i]])[0], table, width)
                common = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(other) - common) and set_id(one, seed) == a[i] and set_id(other, seed) == b[i]:
                    out.append(i)
            take = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Links are pairs with 100 * intersection >= ``percent`` * union of their shingle sets;
    ``miss`` is the posterior chance below which the Bayesian test gives up a pair.  At
    the defaults a pair at 0.8 shares no band with odds of 6e-5, at 0.85 of 3e-7.  Set ids
    are 64-bit digests with ``seed``; should a second digest tell that different sets share
    an id, ids are made anew with the next seed.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.table(texts.mapInArrow(_signed(width, bands, rows, seed), "doc_id long, n_shingles long, sid long, proof long, sig binary, bands array<long>"))
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("proof").alias("low"), F.max("proof").alias("high"))
    classes = scratch.table(classes)
    if not classes.where("low <> high").isEmpty():
        scratch.drop(sets, classes)
        return near_duplicates(docs, width, percent, bands, rows, miss, seed + 1)
    classes = classes.drop("low", "high")
    signed = sets.select("doc_id", "sid", "n_shingles", "sig", "bands").join(classes, ["sid", "doc_id"], "left_semi").dropDuplicates(["sid", "doc_id"])
    keyed = scratch.table(signed.select("sid", "n_shingles", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("key"), "band", "sid", F.col("n_shingles").alias("weight")))
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("lead"), F.sum("weight").alias("all_weight")).where("n > 1")
    buckets = scratch.table(met_by(keyed, scratch.table(met), ["key"], "n").select("key", "band", "sid", "weight", "n", "lead", "all_weight"))
    scratch.drop(keyed)
    # signatures and texts of the classes that share a bucket with another
    met_ids = buckets.select("sid").distinct()
    signatures = scratch.table(signed.select("sid", "doc_id", "sig").join(met_ids, "sid", "left_semi"))
    own = scratch.table(texts.join(signatures.select("sid", "doc_id"), "doc_id").select("sid", "text"))

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = scratch.table(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        sig = signatures.select("sid", "sig")
        both = pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")
        left = scratch.table(both.mapInArrow(_survivors(percent / 100, bands * rows, BATCH, miss), "a long, b long"))
        full = left.join(own.toDF("b", "text_b"), "b").join(own.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
        found = scratch.table(full.mapInArrow(_verified(width, percent, seed), "a long, b long").distinct())
        scratch.drop(pairs, left)
        return found

    links = links_of(buckets.select(F.col("lead").alias("a"), F.col("sid").alias("b")))
    component = connected_components(spark, links, scratch)
    # Buckets that still hold several components: members outside the lead's component are
    # compared, in blocks, with every member of another component.
    placed = buckets.where("n > 2").join(component.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = scratch.table(placed)
    lead = placed.where("sid = lead").select("key", F.col("component").alias("of_lead"), F.col("n").alias("members"))
    tally = met_by(placed, scratch.table(lead), ["key"], "members").groupBy("key").agg(F.first("of_lead").alias("of_lead"), F.first("members").alias("members"), F.count_if(F.col("component") != F.col("of_lead")).alias("out"), F.sum(F.when(F.col("component") != F.col("of_lead"), F.col("weight"))).alias("out_weight")).where("out > 0")
    blocks = F.greatest(F.ceil(F.col("out") / LEFT), F.ceil(F.col("out_weight") / WEIGHT)).cast("int").alias("blocks")
    chunks = F.greatest(F.ceil(F.col("n") / RIGHT), F.ceil(F.col("all_weight") / WEIGHT)).cast("int").alias("chunks")
    rows_ = met_by(placed, scratch.table(tally), ["key"], "members").select("key", "band", "sid", "component", F.col("component") != F.col("of_lead"), blocks, chunks).toDF("key", "band", "sid", "component", "outside", "blocks", "chunks")
    drawn = F.xxhash64("sid")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.pmod(drawn, F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("left")))
    own_block = F.pmod(F.shiftright(drawn, 20), F.col("blocks")).cast("int")
    lefts = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(own_block.alias("block"), k.alias("chunk"), F.lit(True).alias("left")))
    dealt = rows_.withColumn("task", F.explode(F.when(F.col("outside"), F.concat(tasks, lefts)).otherwise(tasks))).select("key", "band", "sid", "component", "task.*")
    dealt = dealt.join(signatures.select("sid", "sig"), "sid").join(own, "sid")
    across = dealt.groupBy("key", "block", "chunk").applyInArrow(_across(width, percent, bands, BATCH, miss, seed), "a long, b long")
    new = scratch.table(across.distinct())
    if not new.isEmpty():
        links = scratch.table(links.union(new))
        component = connected_components(spark, links, scratch)

    of_class = classes.join(component.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.table(of_class.join(least, "component").select("sid", "component_id"))
    scratch.keep_only(sets, of_class)
    ids = sets.select("doc_id", "n_shingles", "sid").join(of_class, "sid", "left")
    alone = F.col("component_id").isNull() | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = ids.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
