"""Exact range join of embeddings by cosine, partitioned by pivots.

On unit vectors the angle is a metric and cosine >= c means angle <= e = arccos(c).
Pivots, chosen farthest-first on a bounded sample, partition the vectors: each belongs to
the cell of its nearest pivot.  A vector y is replicated to another cell only if some
vector of that cell could be within e of it.  By the triangle inequality that needs
angle(y, pivot) <= radius of the cell + e and <= angle(y, own pivot) + 2 e; the plane
between the two pivots tightens this further (y is at most the chord of e beyond it).
Of two cells the one with the lower number compares the pair, so none is met twice.

Vectors within e / 2 of their pivot form the cell's core: by the triangle inequality they
all link with one another, so they are counted, not compared.  A cell's own vectors and
the replicas sent to it are cut into blocks, and tasks compare two blocks of the cell's
own or one of these with one of replicas, so a cell of any size is never gathered and two
replicas never meet; a core's blocks meet only the few vectors within 1.5 e of the pivot.

Scale: equal vectors are folded into one with a multiplicity first, and a vector that many
rows hold gets its result by a broadcast.  Pivots (at most
``max_pivots``) and per-cell figures are the only things that reach the driver.  Vectors
without any cluster structure in many dimensions leave an exact metric join nothing to
prune; the number of comparisons then nears n^2 / 2, in blocks, never as emitted pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components,
or that has no vec_id, links with nothing and is kept; vectors of different dimension never
link; repeated rows are vectors of their own; extra columns are ignored, whatever their
names; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, met_by, tune

SAMPLE = 4096
BLOCK = 12_000  # own vectors a task holds; of replicas, twice as many
_FAR = 1 << 24  # numbers of replica blocks begin here
_SLACK = 1e-7  # on angles: more than rounding can move them


def _vectors(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Farthest-first traversal of unit vectors."""
    chosen, near = [0], _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(number, len(sample)):
        far = int(near.argmax())
        if near[far] <= 0:
            break
        chosen.append(far)
        near = np.minimum(near, _angles(sample, sample[far : far + 1])[:, 0])
    return sample[chosen]


def reached(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(angles, own cell, mask of lower-numbered cells that may hold a partner)."""
    a = _angles(x, pivots)
    own = a.argmin(axis=1)
    mine = a[np.arange(len(x)), own][:, None]
    may = (a <= radius[None, :] + e + _SLACK) & (a <= mine + 2 * e + _SLACK)
    cos = np.cos(a)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots[own] @ pivots.T), 0))
    may &= (np.cos(mine) - cos) <= (np.sqrt(2 - 2 * np.cos(e)) + _SLACK) * apart + _SLACK
    may &= np.arange(len(pivots))[None, :] < own[:, None]
    return a, own, may


def _spread(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``rows`` repeated, with the number 0, 1, ... of the repetition."""
    out = np.repeat(rows, times)
    return out, np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least member of each one's set) after joining the sets of a[k] and b[k]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def near_pairs(x: np.ndarray, y: np.ndarray, x4: np.ndarray, y4: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y, unit vectors, whose cosine in double precision is >= least.

    ``x4`` and ``y4`` are the same in single precision.  Their products decide all pairs
    that rounding cannot have moved over the limit; the few others are computed again.
    """
    slack = (x.shape[1] + 8) * 2 * np.finfo(np.float32).eps  # over twice the bound on the rounding of a product
    cos = (x4 @ y4.T).ravel()
    at = np.flatnonzero(cos >= np.float32(least - slack))
    sure = cos[at] > np.float32(least + slack)
    r, c = np.divmod(at, len(y))
    for k in np.array_split(np.flatnonzero(~sure), len(at) // (1 << 14) + 1):
        sure[k] = np.einsum("ij,ij->i", x[r[k]], y[c[k]]) >= least
    return r[sure], c[sure]


#: Rows and columns of a tile of pairs: its cosines stay in a core's cache.
TILE = 512, 2048


def linked(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, ids: np.ndarray, same: bool, owned_x, owned_y, least: float):
    """Links of x with y (both owned-aware): counts for either side, and least ids reached.

    A pair counts if one of the two is owned by the cell.  ``same``: x and y are one set,
    whose pairs are met once and counted for both.
    """
    to_x, to_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    label = np.arange(len(ids))
    base = 0 if same else len(x)
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    for at in range(0, len(x), TILE[0]):
        rows = slice(at, at + TILE[0])
        for to in range(at // TILE[1] * TILE[1] if same else 0, len(y), TILE[1]):
            cols = slice(to, to + TILE[1])
            r, c = near_pairs(x[rows], y[cols], x4[rows], y4[cols], least)
            r, c = at + r, to + c
            some = (owned_x[r] | owned_y[c]) & ((c > r) | (not same))
            r, c = r[some], c[some]
            np.add.at(to_x, r, my[c])
            np.add.at(to_y, c, mx[r])
            label = united(label, r, base + c)
    if same:
        to_x = to_y = to_x + to_y
    out = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(out, label, ids)
    return to_x, to_y, out[label]


def _joined(least: float):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        vec = _unit(_vectors(table.column("vec")))
        cid, mult, side, own = (table.column(c).to_numpy() for c in ("cid", "mult", "side", "owned"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        own = own.astype(bool)
        same = bool(table.column("i")[0].as_py() == table.column("j")[0].as_py())
        if same:
            right = left
        ids = cid[left] if same else np.concatenate([cid[left], cid[right]])
        a, b, low = linked(vec[left], vec[right], mult[left], mult[right], ids, same, own[left], own[right], least)
        counts = a if same else np.concatenate([a, b])
        some = counts > 0
        return pa.Table.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array(low[some])], schema=schema)

    return run


def link_embeddings(vectors: DataFrame, least: float = 0.95, max_pivots: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    tune(spark)
    scratch, sc = Scratch(spark), spark.sparkContext
    e = float(np.arccos(least))
    # single precision, if given, travels as such: every task computes in double
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("sound", sound)
    good = rows.where("sound").withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0).cast("float" if single else "double")))  # -0.0 becomes 0.0
    good = good.withColumn("vec", F.col("vec").cast(kind))
    classes = scratch.table(good.groupBy("vec").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("mult")))
    dims = [(r[0], r[1]) for r in classes.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()]
    found, core = None, None
    for dim, n in dims:  # vectors of another dimension are another data set
        part = classes.where(F.size("vec") == dim)
        sample = part.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("vec").toArrow().column("vec")
        pivots = choose_pivots(_unit(_vectors(sample)), int(min(max_pivots, max(1, n // 4000))))
        got, kernel = _one_dimension(part, pivots, e, least, kind, sc)
        found = got if found is None else found.union(got)
        core = kernel if core is None else core.union(kernel)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    found = scratch.table(found)
    core = scratch.table(core)
    inner = core.groupBy("cell").agg(F.sum("mult").alias("all"), F.min("cid").alias("low"))
    of_core = core.join(inner, "cell").select("cid", (F.col("all") - F.col("mult")).alias("links"), "low")
    links = found.union(of_core).where("links > 0")
    edges = links.select(F.col("cid").alias("a"), F.col("low").alias("b"))
    component = connected_components(spark, edges, scratch).withColumnRenamed("id", "cid")
    total = links.groupBy("cid").agg(F.sum("links").alias("links"))
    per_class = scratch.table(classes.join(total, "cid", "left").join(component, "cid", "left").select("vec", F.col("cid"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"), "mult"))
    scratch.keep_only(per_class)
    out = met_by(good.select("vec_id", "vec"), per_class, ["vec"], "mult").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("not sound").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _one_dimension(part: DataFrame, pivots: np.ndarray, e: float, least: float, kind: str, sc):
    """((cid, links, low) rows found by comparing, core rows (cell, cid, mult)) of one dimension."""
    number, dim = pivots.shape
    raw = pa.float32() if kind == "array<float>" else pa.float64()
    fit = sc.broadcast(pivots)

    def radii(batches):
        radius, core = np.zeros(number), np.zeros(number, np.int64)
        for batch in batches:
            a = _angles(_unit(_vectors(batch.column("vec"))), fit.value)
            np.maximum.at(radius, a.argmin(axis=1), a.min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(range(number), pa.int32()), pa.array(radius)], names=["cell", "radius"])

    got = dict(part.select("vec").mapInArrow(radii, "cell int, radius double").groupBy("cell").agg(F.max("radius")).collect())
    radius = np.array([got.get(i, 0.0) for i in range(number)])
    shape = sc.broadcast(radius)

    def members(batch):
        """x, then arrays (row, cell, owned, core, near the core) of all memberships."""
        x = _unit(_vectors(batch.column("vec")))
        a, own, may = reached(x, fit.value, shape.value, e)
        row, cell = np.nonzero(may)
        row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([own, cell])
        owned = np.arange(len(row)) < len(x)
        core = owned & (a[row, cell] <= e / 2 - _SLACK)
        near = a[row, cell] <= 1.5 * e + _SLACK
        return x, row, cell, owned, core, near

    def sizes(batches):
        held = np.zeros((3, number), np.int64)
        for batch in batches:
            _, _, cell, owned, core, _ = members(batch)
            np.add.at(held, (np.where(core, 2, np.where(owned, 0, 1)), cell), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(number), pa.int32()), *(pa.array(h) for h in held)], names=["cell", "own", "replicas", "core"])

    count = np.zeros((3, number), np.int64)
    for r in part.select("vec").mapInArrow(sizes, "cell int, own long, replicas long, core long").groupBy("cell").agg(F.sum("own"), F.sum("replicas"), F.sum("core")).collect():
        count[:, r[0]] = r[1:]
    blocks = sc.broadcast(-(-count // np.array([[BLOCK], [2 * BLOCK], [BLOCK]])))
    schema = pa.schema([("cell", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("owned", pa.bool_()), ("cid", pa.int64()), ("mult", pa.int64()), ("vec", pa.list_(raw))])

    def targets(cid, row, cell, owned, core, near):
        """(membership, i, j, side) of every pair of blocks it takes part in; i = -1 - block marks cores."""
        own, replicas, cores = (b[cell] for b in blocks.value)
        hashed = (cid[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        # own vectors: with every block of the cell's own, then with every block of replicas
        k, t = _spread(np.flatnonzero(owned & ~core), (own + replicas)[owned & ~core])
        mine, far = hashed[k] % own[k], t >= own[k]
        yield k, np.where(far, mine, np.minimum(mine, t)), np.where(far, _FAR + t - own[k], np.maximum(mine, t)), np.where(~far & (mine > t), 1, 0)
        k, t = _spread(np.flatnonzero(~owned), own[~owned])
        yield k, t, _FAR + hashed[k] % replicas[k], np.ones(len(k), np.int64)
        # cores meet only what others send to side 1
        k = np.flatnonzero(core)
        yield k, -1 - hashed[k] % cores[k], np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        k, t = _spread(np.flatnonzero(near & ~core), cores[near & ~core])
        yield k, -1 - t, np.zeros(len(k), np.int64), np.ones(len(k), np.int64)

    def dealt(batches):
        """A membership once for each pair of blocks it takes part in."""
        for batch in batches:
            _, row, cell, owned, core, near = members(batch)
            own = _vectors(batch.column("vec")).astype(raw.to_pandas_dtype())
            cid, mult = batch.column("cid").to_numpy(), batch.column("mult").to_numpy()
            for where in targets(cid, row, cell, owned, core, near):
                for at in range(0, len(where[0]), 20_000):
                    k, i, j, side = (w[at : at + 20_000] for w in where)
                    flat = pa.array(own[row[k]].ravel())
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * dim), flat)
                    yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (cell[k], i, j, side)), pa.array(owned[k]), pa.array(cid[row[k]]), pa.array(mult[row[k]]), vec], schema=schema)

    def cores(batches):
        for batch in batches:
            _, row, cell, _, core, _ = members(batch)
            at = np.flatnonzero(core)
            cid, mult = batch.column("cid").to_numpy(), batch.column("mult").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(cell[at] + (dim << 32)), pa.array(cid[row[at]]), pa.array(mult[row[at]])], names=["cell", "cid", "mult"])

    tasks = part.select("cid", "mult", "vec").mapInArrow(dealt, f"cell int, i int, j int, side int, owned boolean, cid long, mult long, vec {kind}")
    found = tasks.groupBy("cell", "i", "j").applyInArrow(_joined(least), "cid long, links long, low long")
    return found, part.select("cid", "mult", "vec").mapInArrow(cores, "cell long, cid long, mult long")
