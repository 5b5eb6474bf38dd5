"""Removing repeated passages by overlapping three-line windows (DataFrame functions only).

Every three consecutive lines of a document are hashed (two 64-bit hashes, 128 bits).  A
window found more than once is repeated; its first occurrence, by doc_id and line, stays
and the lines that any later occurrence covers are removed, overlapping covers merged.

With ``long_words`` one or two consecutive lines of more than that many words are windows
too, so a long paragraph between differing lines is seen; the SQL below has three-line
windows only.  Whatever the window, no passage loses its first occurrence: a cover of it
would put an equal passage before it.

Lines are compared without surrounding blanks; blank lines belong to no window, but go
with a passage that spans them.

Scale: windows are exchanged as 40-byte rows, counted with partial aggregation, so a
passage that a third of all documents share reaches the final count as one row per task.
Hot windows (``met_by``) are met by a broadcast of their first places and not exchanged
again; the others are joined by hash.
Only positions inside repeated windows come back, folded per document; texts are
exchanged once.

Defined results: null and empty texts, and texts of under three lines, have no window and
stay as they are (with ``long_words``: unless a line or two of them make a long passage).
Rows of one doc_id (null is an id, the last) count as one document: what they repeat of
each other at the same line is no repetition, but a row loses only lines of its own text.  An empty table gives no row.  Extra
columns are kept, whatever their names; only n_lines and n_removed, which are the
operator's, replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, met_by, row_of, unpacked

WORD = r"[^\x20\x09-\x0D]+"


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, a, c, h1, h2): original indices of a window's first and last line, and its hashes."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), F.trim(line, F.lit(" \t\r")).alias("line")))
    full = docs.select("doc_id", "t", F.filter(lines, lambda x: x["line"] != "").alias("l")).where(F.size("l") >= 3)
    at = full.select("doc_id", "t", "l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("p"))
    a, b, c = (F.element_at("l", F.col("p") + k) for k in range(3))
    text = F.concat_ws("\n", a["line"], b["line"], c["line"])
    return at.select("doc_id", "t", a["i"].alias("a"), c["i"].alias("c"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("h2"))


def _long_windows(docs: DataFrame, long_words: int) -> DataFrame:
    """The same columns of one line, or two, of more than ``long_words`` words."""
    able = docs.where(F.length("text") > 2 * long_words)  # as many words and the blanks between
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), F.trim(line, F.lit(" \t\r")).alias("line"), F.regexp_count(line, F.lit(WORD)).alias("n")))
    full = able.select("doc_id", "t", F.filter(lines, lambda x: x["line"] != "").alias("l")).where(F.size("l") > 0)
    at = full.select("doc_id", "t", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1)).alias("p"))
    a, b = (F.get("l", F.col("p") + k) for k in range(2))
    one = F.when(a["n"] > long_words, F.struct(a["i"].alias("a"), a["i"].alias("c"), a["line"].alias("text")))
    two = F.when(a["n"] + b["n"] > long_words, F.struct(a["i"].alias("a"), b["i"].alias("c"), F.concat_ws("\n", a["line"], b["line"]).alias("text")))
    found = at.select("doc_id", "t", F.explode(F.array_compact(F.array(one, two))).alias("w"))
    text = F.col("w.text")
    return found.select("doc_id", "t", "w.a", "w.c", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("h2"))


def covers_of(ids: DataFrame, scratch: Scratch, long_words: int | None) -> DataFrame:
    """(_id, _t, _covers) of documents (doc_id, text): spans of lines that later occurrences cover.

    Rows are told apart by doc_id and the text's hash, so a cover meets the lines it was found in.
    """
    ids = ids.withColumn("t", F.xxhash64("text"))
    windows = _windows(ids)
    if long_words is not None:
        windows = windows.union(_long_windows(ids, long_words))
    # a place in the order of doc_id (null last) and line, as one number that aggregates in place
    place = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit("9223372036854775808").cast("decimal(19,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("a")
    windows = scratch.table(windows.withColumn("place", place.cast("decimal(30,0)")))
    first = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1")
    first = scratch.table(first)
    later = met_by(windows, first, ["h1", "h2"], "n").where("place <> first")
    # covers of a document: its distinct spans, at most one per line and length of window
    return later.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("a", "c")).alias("_covers"))


def deduped_rows(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """(_row, text, n_lines, n_removed): every row of ``docs`` as a struct, and what becomes of its text."""
    scratch = Scratch(docs.sparkSession)
    covers = covers_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch, long_words)
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    rows = rows.join(covers, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t")), "left")
    text = F.col("_row").getField("text").cast("string")
    gone = F.array_distinct(F.flatten(F.transform("_covers", lambda s: F.sequence(s["a"], s["c"]))))
    out = rows.select("_row", F.split(text, "\n", -1).alias("_lines"), gone.alias("_gone"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.element_at(F.col("_lines"), i + 1)), "\n")
    n_lines = F.when(F.length(text) > 0, F.size("_lines")).otherwise(0).cast("long")
    n_removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    return out.select("_row", F.when(F.col("_gone").isNull(), text).otherwise(kept).alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def dedup_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """``docs`` with ``text`` freed from later occurrences of repeated three-line windows.

    Adds n_lines (lines of the text as it came) and n_removed.  Windows of one and two
    lines count as well if they have more than ``long_words`` words (None: never).
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return deduped_rows(docs, long_words).select(*unpacked(columns, text=F.col("text")), "n_lines", "n_removed")


#: The same in DuckDB, with the windows' texts in place of their hashes.
ORACLE = """
with l0 as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l1 as (select doc_id, generate_subscripts(lines, 1) - 1 as i, trim(unnest(lines), ' ' || chr(9) || chr(13)) as line from l0),
l2 as (select *, row_number() over (partition by doc_id order by i) as p from l1 where line <> ''),
w as (select doc_id, i as a, lead(i, 2) over d as c, line || chr(10) || lead(line) over d || chr(10) || lead(line, 2) over d as win from l2 window d as (partition by doc_id order by i)),
r as (select *, count(*) over (partition by win) as n, row_number() over (partition by win order by doc_id, a) as k from w where c is not null),
gone as (select distinct doc_id, unnest(range(a, c + 1)) as i from r where n > 1 and k > 1),
kept as (select l0.doc_id, coalesce(string_agg(x.line, chr(10) order by x.i), '') as text
  from l0 left join (select doc_id, generate_subscripts(lines, 1) - 1 as i, unnest(lines) as line from l0) x on x.doc_id = l0.doc_id
  and not exists (select 1 from gone g where g.doc_id = x.doc_id and g.i = x.i) group by l0.doc_id)
select l0.doc_id, kept.text, case when length(l0.text) > 0 then len(lines) else 0 end::bigint as n_lines,
  (select count(*) from gone g where g.doc_id = l0.doc_id)::bigint as n_removed from l0 join kept using (doc_id)
"""
