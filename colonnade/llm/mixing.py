"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

A mix of as many words as the corpus has is divided in equal blocks of words.  Blocks go
to sources by the highest quotients target / (2k + 1), then in the same way to the shards
of each source, so every shard has an integer quota.  A source whose target is under
``FEW_BLOCKS`` blocks would win none, or a count far from its target: it gets its target
in words beforehand, in units of its own, and the blocks that are left go to the others.
Inside a shard documents are strung together in seeded order; the quota's full passes
repeat all of them, and the rest takes blocks from the front of the seeded order, the last
one cutting a document.

Scale: only (doc_id, source, size) rows are exchanged, never a text.  A block is at most
``most_words`` words, and a source has a shard for every 64 blocks, so the number of
shards grows with the corpus and none orders more than about 64 * ``most_words`` words.
Quotients that surely win are counted, not listed: those that may win or lose number
about three per source or shard, whatever the corpus and the number of blocks, and they
alone are ranked.  Sources, a row each, are ranked in one place.

Defined results: null text has size 0; null source is a source of its own, last; a null
doc_id is ordered like the text 'null'; a corpus without words takes nothing; rows that
repeat are mixed one by one; extra columns are ignored, whatever their names; an empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, row_of

#: Targets of fewer blocks are not rounded to blocks; from here on a block is 1.6 %.
FEW_BLOCKS = 64

#: Least units of a target under FEW_BLOCKS that is dealt over several shards.
UNITS = 1024

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def apportion(votes: DataFrame, key: list[str], within: list[str], seats: str, vote: str, order: list[str]) -> DataFrame:
    """Sainte-Laguë seats of each ``key`` among its ``within`` group: key columns and ``won``.

    ``votes`` has a row per key with its vote and the seats of its group.  With V the votes
    and m the keys of a group, the common divisor lies between V / (seats + m / 2) and
    V / (seats - m / 2), as rounding moves each key by half a seat at most.  So a key's seats
    below the one bound are won without a ranking, those beyond the other are lost, and only
    the quotients between are ranked for the seats that are left.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    v = votes.where(f"{vote} > 0 and {seats} > 0")
    v = v.withColumn("_all", F.sum(vote).over(group)).withColumn("_half", F.count(F.lit(1)).over(group) / 2)
    share = F.col(vote).cast("double") / F.col("_all")
    sure = F.floor(share * (F.col(seats) - F.col("_half")) - 1.5)
    v = v.withColumn("_sure", F.greatest(F.lit(0), sure).cast("long")).withColumn("_top", F.ceil(share * (F.col(seats) + F.col("_half")) + 1.5).cast("long"))
    v = v.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    q = v.withColumn("_k", F.explode(F.sequence("_sure", "_top")))
    q = q.withColumn("_q", F.col(vote).cast("double") / (2 * F.col("_k") + 1))
    rank = F.row_number().over(group.orderBy(F.desc("_q"), *order, "_k"))
    ranked = q.withColumn("_rank", rank)
    return ranked.groupBy(*key).agg((F.max("_sure") + F.count_if(F.col("_rank") <= F.col("_left"))).alias("won"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, blocks: int = 32768, seed: int = 17, most_words: int = 1 << 20, keep: bool = False) -> DataFrame:
    """What a mix of the corpus's own size takes of each document.

    Returns doc_id, size, source_size, target, taken: ``taken`` words, at most ``most``
    times ``size``; with ``keep`` the document's row too, as the struct ``_row``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), *([row_of(docs)] if keep else []))
    rows = scratch.table(rows)

    # Targets: shares by weight, sources at their ceiling first.  In the order of ceiling
    # per weight a source is capped if the level that all later ones share lies above it.
    size = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    by_code = one.orderBy(F.col("source").asc_nulls_last())
    size = size.withColumn("rank", F.row_number().over(by_code))
    size = size.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    size = size.withColumn("total", F.sum("source_size").over(one))
    filling = one.orderBy(F.col("source_size") * most / F.col("weight"), "rank")
    size = size.withColumn("before", F.coalesce(F.sum(F.col("source_size") * most).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = size.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    size = size.withColumn("full", (F.col("total") - F.col("before")) * F.col("weight") > F.col("source_size") * most * F.col("open"))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("source_size") * most).otherwise(0)).over(one)
    shared = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(one)
    size = size.withColumn("target", F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(left * F.col("weight") / F.greatest(shared, F.lit(1))))
    size = size.withColumn("block", F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / F.lit(float(blocks))), F.lit(most_words))).cast("long"))
    size = size.withColumn("shards", F.greatest(F.lit(1), F.floor(F.col("source_size") / (64 * F.col("block")))).cast("long"))
    # Sources of few blocks: one unit of all their words, or many over several shards.
    size = size.withColumn("few", (F.col("block") > 1) & (F.col("target") < FEW_BLOCKS * F.col("block")))
    words = F.round("target").cast("long")
    unit = F.greatest(F.lit(1), F.when(F.col("shards") == 1, words).otherwise(F.floor(F.col("target") / UNITS))).cast("long")
    size = size.withColumn("unit", F.when(F.col("few"), unit).otherwise(F.col("block")))
    size = size.withColumn("units", F.when(F.col("few"), F.round(F.col("target") / F.col("unit"))).cast("long"))
    given = F.sum(F.when(F.col("few"), F.col("unit") * F.col("units")).otherwise(0)).over(one)
    size = size.withColumn("blocks", F.greatest(F.lit(0), F.floor((F.col("total") - given) / F.col("block"))).cast("long"))
    sources = scratch.table(size.select("source", "rank", "source_size", "target", "few", "unit", "units", "blocks", "shards"))
    n_shards = sources.agg(F.sum("shards")).first()[0] or 0

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_shards <= BROADCAST_ROWS else df

    won = apportion(sources.where(~F.col("few")), ["rank"], [], "blocks", "target", ["rank"])
    quota = sources.join(won, "rank", "left").withColumn("quota", F.coalesce("units", "won", F.lit(0))).drop("won", "units", "few")

    # Shards: a document's seeded hash deals it out and, in full, orders it.
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    dealt = rows.join(small(quota), rows["source"].eqNullSafe(quota["source"])).drop("source").withColumn("_hash", hashed)
    dealt = dealt.withColumn("_shard", F.pmod(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shard = dealt.groupBy("rank", "_shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"), F.first("unit").alias("unit"))
    own = apportion(shard, ["rank", "_shard"], ["rank"], "quota", "shard_size", ["_shard"])
    shard = shard.join(own, ["rank", "_shard"], "left")
    words = F.least(F.coalesce("won", F.lit(0)) * F.col("unit"), F.col("shard_size") * most)
    shard = scratch.table(shard.select("rank", "_shard", "shard_size", words.alias("words")))

    string = Window.partitionBy("rank", "_shard").orderBy("_hash", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("size").over(string), F.lit(0))).join(small(shard), ["rank", "_shard"])
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.greatest("shard_size", F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("words") - passes * F.col("shard_size") - F.col("_before")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["_row"] if keep else []))


#: The same in DuckDB, by ranking all quotients from the first.
ORACLE = """
with rows as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from rows group by source),
s1 as (select *, row_number() over (order by source asc nulls last) as rank from s0),
s2 as (select *, case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, (sum(source_size) over ())::bigint as total from s1),
s3 as (select *, coalesce(sum(source_size * 3) over (order by source_size * 3 / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as before,
  (sum(weight) over (order by source_size * 3 / weight, rank rows between current row and unbounded following))::bigint as open from s2),
s4 as (select *, (total - before) * weight > source_size * 3 * open as full_ from s3),
s5 as (select *, case when full_ then (source_size * 3)::double else (total - sum(case when full_ then source_size * 3 else 0 end) over ())::bigint * weight
  / greatest((sum(case when full_ then 0 else weight end) over ())::bigint, 1)::double end as target, greatest(1, least(ceil(total / 32768.0::double), 1048576))::bigint as block from s4),
s5b as (select *, greatest(1, source_size // (64 * block))::bigint as shards, block > 1 and target < 64 * block as few from s5),
s5c as (select *, case when not few then block when shards = 1 then greatest(1, round(target)::bigint) else greatest(1, floor(target / 1024)::bigint) end as unit from s5b),
s5d as (select *, case when few then round(target / unit)::bigint end as units from s5c),
s6 as (select *, greatest(0, (total - (sum(case when few then unit * units else 0 end) over ())::bigint) // block)::bigint as blocks,
  sum(case when few then 0 else target end) over () as votes from s5d),
q1 as (select rank, blocks, k, target / (2 * k + 1)::double as q from s6, unnest(range(0, (ceil(target * (blocks + 1000) / greatest(votes, 1)) + 1)::bigint)) as u(k) where target > 0 and not few),
q2 as (select *, row_number() over (order by q desc, rank, k) as place from q1),
won as (select rank, count(*) as quota from q2 where place <= blocks group by rank),
src as (select s6.* exclude (votes), coalesce(units, quota, 0) as quota from s6 left join won using (rank)),
dealt as (select rows.doc_id, rows.size, src.*, md5('17:' || coalesce(doc_id::varchar, 'null')) as hash from rows join src on rows.source is not distinct from src.source),
d2 as (select *, ('0x' || substr(hash, 1, 8))::bigint % shards as shard from dealt),
h1 as (select rank, shard, sum(size)::bigint as shard_size, any_value(quota) as quota, any_value(unit) as unit from d2 group by rank, shard),
h2 as (select *, sum(shard_size) over (partition by rank) as votes, count(*) over (partition by rank) as m from h1),
q3 as (select rank, shard, quota, k, shard_size::double / (2 * k + 1)::double as q from h2, unnest(range(0, (ceil(shard_size::double * (quota + m) / votes) + 1)::bigint)) as u(k) where shard_size > 0),
q4 as (select *, row_number() over (partition by rank order by q desc, shard, k) as place from q3),
own as (select rank, shard, count(*) as won from q4 where place <= quota group by rank, shard),
h3 as (select h1.rank, h1.shard, shard_size, least(coalesce(won, 0) * unit, shard_size * 3)::bigint as words from h1 left join own on own.rank = h1.rank and own.shard = h1.shard),
p as (select d2.*, h3.shard_size, h3.words, coalesce(sum(size) over (partition by d2.rank, d2.shard order by hash, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as before_
  from d2 join h3 on d2.rank = h3.rank and d2.shard = h3.shard),
f as (select *, case when shard_size > 0 then words // shard_size else 0 end as passes from p)
select doc_id, size, source_size, target, (passes * size + greatest(0, least(words - passes * shard_size - before_, size)))::bigint as taken from f
"""
