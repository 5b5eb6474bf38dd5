"""Canonical exact digests of documents.

The canonical form of a text is NFKC, case-folded, with runs of white space turned into
one space and the ends trimmed; its fingerprint is the 128-bit xxh3 digest of that form.
Documents of equal digest form a bucket, and the canonical bytes inside a bucket are
compared (least against greatest, as partially aggregated minima, so a bucket of any size
is never gathered).  Should two different forms ever share a digest, the fingerprints of
that bucket are extended by the SHA-256 of the form.

Scale: one scan for the digests (16 bytes a row are exchanged), one for the bytes of
repeated digests, and one exchange of the texts by ranges of doc_id for the query.  The
second scan knows the repeated digests through a Bloom filter of fixed size: no digest
reaches the driver, and a false positive only sends a form that meets no other.

Defined results: null text counts as empty; texts that fold to the same form share a
fingerprint; repeated doc_ids are told apart by text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, texts_of, tune
from .ordered import with_successors


def canonical(text: str) -> str:
    """NFKC, case folded, white space folded; stable when applied again."""
    if text.isascii():
        return " ".join(text.casefold().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


#: Bytes of a digest, and 64-bit words of the filter of repeated digests (8 MiB).
WIDTH, WORDS = 16, 1 << 20


def digest(canon: str, width: int = WIDTH) -> bytes:
    return xxhash.xxh3_128_digest(_bytes(canon))[:width]


def _slots(digests: list[bytes]) -> np.ndarray:
    """Two bit positions of each digest in the filter."""
    halves = np.frombuffer(b"".join(d.ljust(16, b"\0") for d in digests), "<u8").reshape(-1, 2)
    return (halves % np.uint64(64 * WORDS)).astype(np.int64)


def _digests(width):
    def run(batches):
        for batch in batches:
            found = [digest(canonical(t), width) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    return run


def _bits(batches):
    words = np.zeros(WORDS, np.uint64)
    for batch in batches:
        at = _slots(batch.column("digest").to_pylist()).ravel()
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    word = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(words[word].view(np.int64))], names=["word", "bits"])


def _forms(wanted, width):
    def run(batches):
        known = wanted.value
        for batch in batches:
            forms = [canonical(t) for t in texts_of(batch)]
            found = [digest(c, width) for c in forms]
            a, b = _slots(found).T
            hit = np.flatnonzero((known[a >> 3] >> (a & 7)) & (known[b >> 3] >> (b & 7)) & 1)
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in hit], pa.binary()), pa.array([_bytes(forms[i]) for i in hit], pa.binary())], names=["digest", "form"])

    return run


def colliding(docs: DataFrame, width: int = WIDTH) -> set[bytes]:
    """Digests (``width`` bytes) that two different canonical forms share.

    Found by comparing bytes inside every bucket of equal digests.  The result is
    expected to be empty: at 128 bits a collision among 10^12 texts has odds of 10^-15.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    repeated = texts.mapInArrow(_digests(width), "digest binary").groupBy("digest").count().where("count > 1").select("digest")
    bits = repeated.mapInArrow(_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not bits.num_rows:
        return set()
    words = np.zeros(WORDS, "<u8")
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    wanted = spark.sparkContext.broadcast(words.view(np.uint8))
    forms = texts.mapInArrow(_forms(wanted, width), "digest binary, form binary")
    clash = forms.groupBy("digest").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high")
    return {bytes(r[0]) for r in clash.select("digest").collect()}


def _named(canon: str, clash: set, width: int) -> str:
    d = digest(canon, width)
    return f"{d.hex()}-{hashlib.sha256(_bytes(canon)).hexdigest()}" if d in clash else d.hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(clash, width):
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column("_range").to_pylist(), batch.column("_role").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch), strict=True)

        def result(doc_id, text, following):
            changed = edited(text, following)
            own, new, after = canonical(text), canonical(changed), canonical(following)
            return doc_id, len(text), hashlib.sha256(_bytes(changed)).hexdigest(), _named(own, clash, width), _named(new, clash, width), float(own == new), float(own == after)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def pack(out):
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        out, held, guest = [], None, False
        for at, role, doc_id, text in rows():
            if held and held[0] == at and not guest:
                out.append(result(held[1], held[2], text))
            held, guest = (at, doc_id, text), role == 1 or (guest and held and held[0] == at)
            if len(out) >= 1000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return run


def fingerprint_documents(docs: DataFrame, parts: int | None = None, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each document and of its text edited with the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; an exact digest's likeness is 1.0 for equal canonical forms, else 0.0.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clash = colliding(rows, width)
    dealt = with_successors(rows, "doc_id", ["text"], parts or shuffle_partitions(spark))
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compared(clash, width), kinds)
