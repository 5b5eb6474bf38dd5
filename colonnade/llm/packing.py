"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best fit, longest first.  Pieces longer than half a sequence open one
each.  The shorter ones follow in classes of halving length, each in rounds:

1. the class's documents and the gaps that can hold one are range-sorted together by size;
2. every range is swept from its longest to its shortest size: a document takes the
   closest successor among the range's gaps, and what is left of the gap goes back among
   them; documents without one stay pending, in order of rank;
3. ranges settle what they could not by themselves: gaps left over in a range serve the
   pending documents of the ranges below, nearest range first.  Who gets which is decided
   by rank, like matching brackets, from two numbers per range;
4. gaps are updated, and the next round starts.

A class's rounds end when a round places under a hundredth of its documents; those without a
gap are then dealt out by row number, and every share opens sequences for itself, best fit, longest
first, so no share wastes more than its last sequence.

Scale: texts are read once and never exchanged; a round exchanges rows of 60 bytes, only
those of its class and of gaps that can hold one.  Equal sizes are split over ranges by
row number, so any number of equal documents is swept in parallel.  The driver sees three
counts per range.  Rounds are written, so a lost executor repeats its ranges only.

Token ids are always the tokenizer's.  A text is cut at ASCII blanks, which the vocabulary's
rules always do, and chunks of letters, digits and punctuation that are proven inert (ASCII
without apostrophes and '<|', Latin letters with one-letter lower cases) are cut between
these kinds as well; each chunk is encoded once and kept.  Any other chunk goes to the
tokenizer whole, and so does every text if a vocabulary file states other rules.

Defined results: null and empty texts are a single end token; a document longer than a
sequence is cut in full pieces and a rest; rows repeating a doc_id are packed one by one;
a null doc_id stays null; extra columns are ignored, whatever their names; an empty table
gives no row.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import unicodedata
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, texts_of, tune

#: Rows of documents and gaps that a range of a round should hold.
RANGE_ROWS = 16_384


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The rules under which a text may be cut as said above, as vocabulary files state them.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _inert(c: str) -> bool:
    """A letter that stays one letter under NFC and lower case, and meets no mark."""
    low = c.lower()
    return unicodedata.category(c) in ("Lu", "Ll") and len(low) == 1 and unicodedata.category(low) == "Ll" and unicodedata.normalize("NFC", low) == low and unicodedata.normalize("NFC", c) == c


_LETTERS = "".join(c for c in map(chr, range(0xC0, 0x180)) if _inert(c))
_LOWER = "".join(sorted(set(_LETTERS.lower())))
_UNPROVEN = re.compile(f"[^\t\n\r\x20-\x7e{_LETTERS}]|'|<\\|")
_CHUNK = re.compile(r"[^\t\n\r\x20]+")
_PIECE = re.compile(rf"[a-z{_LOWER}]+|[0-9]|[!-/:-@\[-`{{-~]+")


class Encoder:
    """Token ids of texts as little-endian uint32 bytes; a worker keeps the ids of short chunks.

    Proven chunks are one word each, and only a word's last token is marked as its end.  So
    new ones are encoded many in a call, with blanks between, and told apart by that mark.
    """

    LONGEST, MOST_BYTES, TOGETHER = 64, 192 << 20, 500

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunks, self.held = Tokenizer.from_file(path), {}, 0
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        plain = all(not t["normalized"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in said["added_tokens"])
        suffix = said["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known = bool(suffix) and plain and (said.get("normalizer") or {}).get("normalizers") == _NORMALIZER and cut.get("pattern") == {"Regex": _SPLIT} and said["model"].get("continuing_subword_prefix") is None

    def split(self, text: str) -> list[str]:
        if not self.known:
            return [text]
        if not _UNPROVEN.search(text):
            return _PIECE.findall(text.lower())
        out = []
        for chunk in _CHUNK.findall(text):
            if _UNPROVEN.search(chunk):
                out.append(chunk)
            else:
                out.extend(_PIECE.findall(chunk.lower()))
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        lists = [self.split(t) for t in texts]
        if self.held > self.MOST_BYTES:
            self.chunks.clear()
            self.held = 0
        new = {c for parts in lists for c in parts}.difference(self.chunks)
        words = [c for c in new if self.known and not _UNPROVEN.search(c)]
        groups = [words[at : at + self.TOGETHER] for at in range(0, len(words), self.TOGETHER)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(group):
                continue  # left to the calls one by one
            raw = ids.tobytes()
            self.chunks.update(zip(group, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
        rest = list(new.difference(self.chunks))
        self.chunks.update(zip(rest, (ids.tobytes() for ids in self._ids(rest)), strict=True))
        long = [c for c in new if len(c) > self.LONGEST]
        self.held += sum(200 + len(c) for c in new) - sum(200 + len(c) for c in long)
        out = [b"".join(map(self.chunks.__getitem__, parts)) for parts in lists]
        for c in long:
            del self.chunks[c]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, so its chunks outlive a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


_PIECE_KINDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "uid": pa.int64()}


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def _pieces(path: str, most: int, end: int):
    tail = int(end).to_bytes(4, "little")

    def run(batches):
        known, uid = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), known.encode_all(texts_of(batch)), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * most)):
                    piece = ids[at : at + 4 * most]
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), uid))
                    uid += 1
            yield _table(out, _PIECE_KINDS)

    return run


class Gaps:
    """Gaps by size; taking the closest successor of a length costs a bisection of distinct sizes."""

    def __init__(self):
        self.sizes: list[int] = []
        self.held: dict[int, list[int]] = {}

    def put(self, size: int, sequence: int) -> None:
        if size not in self.held:
            self.held[size] = []
            bisect.insort(self.sizes, size)
        self.held[size].append(sequence)

    def take(self, length: int) -> tuple[int, int] | None:
        """(size, sequence) of a least gap of at least ``length``."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        held = self.held[size]
        sequence = held.pop()
        if not held:
            del self.held[size], self.sizes[at]
        return size, sequence

    def rest(self):
        for size in self.sizes:
            for sequence in self.held[size]:
                yield size, sequence


PLACED, GAP, PENDING = 0, 1, 2
_SWEPT = {"what": pa.int8(), "part": pa.int32(), "rank": pa.int64(), **_PIECE_KINDS, "sequence_id": pa.int64(), "gap": pa.int64(), "offset": pa.int64()}
_SWEPT_SQL = "what tinyint, part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, gap long, offset long"


def sweep(rows, part: int, most: int, first: int | None):
    """Rows of one range, longest first and gaps before documents of their size, matched.

    ``rows`` are (size, payload of a document or None, sequence of a gap).  Yields placed
    documents, gaps and pending documents; pending ones carry their rank, and so do gaps
    that are long enough for any document of a range below, shortest first (others: -1).
    With ``first`` a document without a gap opens sequence first, first + 1, ...
    """
    gaps, floor, pending = Gaps(), 0, 0
    for size, document, sequence in rows:
        floor = size
        if document is None:
            gaps.put(size, sequence)
            continue
        got = gaps.take(size)
        if got is None and first is not None:
            got, first = (most, first), first + 1
        if got is None:
            yield (PENDING, part, pending, *document, None, None, None)
            pending += 1
            continue
        gap, sequence = got
        yield (PLACED, part, None, *document, sequence, None, most - gap)
        if gap > size:
            gaps.put(gap - size, sequence)
    rank = 0
    for size, sequence in gaps.rest():
        able = size >= floor
        yield (GAP, part, rank if able else -1, *[None] * 6, sequence, size, None)
        rank += able


def _sweeps(most: int, opening: int | None):
    def run(batches):
        part = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                document = zip(*(batch.column(c).to_pylist() for c in _PIECE_KINDS), strict=True)
                for size, kind, sequence, d in zip(batch.column("size").to_pylist(), batch.column("kind").to_pylist(), batch.column("sequence_id").to_pylist(), document, strict=True):
                    yield size, d if kind else None, sequence

        out = []
        for row in sweep(rows(), part, most, None if opening is None else (opening << 48) + (part << 26)):
            out.append(row)
            if len(out) == 20_000:
                yield _table(out, _SWEPT)
                out = []
        yield _table(out, _SWEPT)

    return run


def settle(pending: dict[int, int], spare: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Which spare gaps of which range serve which pending documents.

    Ranges are numbered from the longest sizes down.  Returns (range, first rank, rank after
    the last, range of the gaps, first rank of the gaps): at most two rows per range.
    """
    out, stack = [], []
    for part in sorted(pending.keys() | spare.keys()):
        rank, need = 0, pending.get(part, 0)
        while need and stack:
            at, begin, left = stack.pop()
            take = min(need, left)
            out.append((part, rank, rank + take, at, begin))
            rank, need = rank + take, need - take
            if left > take:
                stack.append((at, begin + take, left - take))
        if spare.get(part):
            stack.append((part, 0, spare[part]))
    return out


_PIECE_COLUMNS = list(_PIECE_KINDS)
_ASKED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, at long, of long"


def _asking(shares):
    """Adds to pending documents the range and rank of the gap that serves them (null: none)."""

    def run(batches):
        part, low, high, at, begin = shares.value.T  # sorted by range and rank
        keys = (part << 40) + low
        for batch in batches:
            own, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "rank"))
            k = np.maximum(np.searchsorted(keys, (own << 40) + rank, "right") - 1, 0)
            none = (part[k] != own) | (rank >= high[k]) | (rank < low[k])
            found = [pa.array(at[k], pa.int64(), mask=none), pa.array(begin[k] + rank - low[k], pa.int64(), mask=none)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECE_COLUMNS), *found], names=[*_PIECE_COLUMNS, "at", "of"])

    return run


def _round(spark, scratch: Scratch, todo: DataFrame, gaps: DataFrame, parts: int, most: int, opening: int | None) -> tuple[DataFrame, DataFrame, DataFrame, int, int, int]:
    """One round: (placed, gaps, pending, number placed, number pending, number of ranges).

    With ``opening`` documents without a gap open sequences, numbered from there.
    """
    documents = todo.select(F.col("length").alias("size"), F.lit(1).alias("kind"), *_PIECE_COLUMNS, F.lit(None).cast("long").alias("sequence_id"), F.col("uid").alias("tie"))
    empty = [F.lit(None).cast(f"{'int' if c == 'piece' else 'long'}").alias(c) for c in _PIECE_COLUMNS]
    free = gaps.select(F.col("gap").alias("size"), F.lit(0).alias("kind"), *empty, "sequence_id", F.col("sequence_id").alias("tie"))
    order = [F.desc("size"), F.asc("kind"), F.asc("tie")]
    both = documents.union(free)
    ranged = both.repartitionByRange(parts, *order) if opening is None else both.repartition(parts, "tie")
    ranged = ranged.sortWithinPartitions(*order)
    swept = scratch.table(ranged.mapInArrow(_sweeps(most, opening), _SWEPT_SQL))
    count = {(r[0], r[1]): (r[2], r[3]) for r in swept.groupBy("what", "part").agg(F.count(F.lit(1)), F.count_if(F.col("rank") >= 0)).collect()}
    placed, free, pending = (swept.where(F.col("what") == what) for what in (PLACED, GAP, PENDING))
    n_placed, n_pending = (sum(n for (what, _), (n, _) in count.items() if what == kind) for kind in (PLACED, PENDING))
    ranges = 1 + max((part for _, part in count), default=0)
    shares = [] if opening is not None else settle({p: n for (what, p), (n, _) in count.items() if what == PENDING}, {p: able for (what, p), (_, able) in count.items() if what == GAP})
    if shares:
        served = sum(r[2] - r[1] for r in shares)
        told = spark.sparkContext.broadcast(np.array(shares, np.int64))  # two rows per range at most
        asked = scratch.table(pending.select("part", "rank", *_PIECE_COLUMNS).mapInArrow(_asking(told), _ASKED_SQL))
        waiting, ranked = asked.where("at is null"), asked.where("at is not null")
        spare = free.where("rank >= 0").select(F.col("part").cast("long").alias("at"), F.col("rank").alias("of"), "sequence_id", "gap")
        met = scratch.table(spare.join(ranked, ["at", "of"], "left"))
        found = met.where("uid is not null")
        placed = placed.select(*_PIECE_COLUMNS, "sequence_id", "offset").union(found.select(*_PIECE_COLUMNS, "sequence_id", (most - F.col("gap")).alias("offset")))
        left = met.select("sequence_id", (F.col("gap") - F.coalesce("length", F.lit(0))).alias("gap")).where("gap > 0")
        return placed, free.where("rank < 0").select("sequence_id", "gap").union(left), waiting.select(*_PIECE_COLUMNS), n_placed + served, n_pending - served, ranges
    return placed.select(*_PIECE_COLUMNS, "sequence_id", "offset"), free.select("sequence_id", "gap"), pending.select(*_PIECE_COLUMNS), n_placed, n_pending, ranges


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most: int = 4096, end: int = 1) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch, path = Scratch(spark), tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.table(rows.mapInArrow(_pieces(path, most, end), "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"))
    bounds = [most // 2]
    while len(bounds) < 3 and bounds[-1] > 1:
        bounds.append(bounds[-1] // 2)
    cuts = list(zip([*bounds[1:], 0], bounds, strict=True))  # classes (low, high], longest first
    number = pieces.agg(*[F.count_if((F.col("length") > low) & (F.col("length") <= high)) for low, high in [*cuts, (bounds[0], most)]]).first()
    alone = pieces.where(F.col("length") > bounds[0])
    placed = [alone.select(*_PIECE_COLUMNS, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps, opened, step = alone.select(F.col("uid").alias("sequence_id"), (most - F.col("length")).alias("gap")).where("gap > 0"), number[-1], 0
    for (low, high), left in zip(cuts, number, strict=False):
        todo = pieces.where((F.col("length") > low) & (F.col("length") <= high))
        aside, opening = [], opened == 0
        while left:
            step += 1
            able = gaps.where(F.lit(False) if opening else F.col("gap") > low)
            aside.append(gaps if opening else gaps.where(F.col("gap") <= low))
            parts = max(1, min(-(-(left + opened) // RANGE_ROWS), 8 * shuffle_partitions(spark)))
            done, gaps, todo, n, left, ranges = _round(spark, scratch, todo, able, parts, most, (1 << 14 | step) if opening else None)
            placed.append(done)
            opened += n if opening else 0
            opening = 100 * n < n + left or ranges == 1  # a single range has tried every gap
        gaps = reduce(DataFrame.union, [*aside, gaps])
    return reduce(DataFrame.union, placed).drop("uid")
