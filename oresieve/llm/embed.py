"""Embedding near-duplicates by collision counting over sorted one-dimensional projections, after public work on query-aware hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, sized

THRESHOLD = 0.93
#: Projections; half width of a window in standard deviations of the difference of two vectors that just link; the part of such
#: pairs that the count must let through; seed of the directions.
PROJECTIONS, WIDTH, RECALL, SEED = 32, 2.5, 1 - 1e-7, 2
#: How far a query looks along a sorted projection, in the same deviations: of pairs that link one in ten million is farther apart.
REACH = 5.33
#: Vectors of a block, and queries that are counted at once. A label has MOST_COPIES blocks, and as many copies of each vector, until
#: blocks of BLOCK_BYTES are not enough.
BLOCK, QUERIES, MOST_COPIES, BLOCK_BYTES = 2048, 128, 64, 32_000_000
SCALE = 2048


def calibrated_count(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with the wanted recall.

    On a normal direction, the projections of two unit vectors differ by a normal number whose deviation is their distance,
    so that they fall into one window with a known chance, on each direction anew: counts are binomial.
    """
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
    return projections


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, same: bool = False):
    """Yields (i, j) arrays of all pairs found with a cosine of the threshold or more, j > i if left and right are the same.

    The right side is sorted by every projection. A query takes the one on which it lies farthest out, as the fewest vectors are near
    there, and with others of that projection meets the run of vectors within reach. In the run, the windows around its own
    projections count collisions on every direction, and pairs with the calibrated count are verified.
    """
    if not len(left) or not len(right):
        return
    left, right = _unit(left.astype(np.float64)), _unit(right.astype(np.float64))
    directions = np.random.default_rng(SEED).standard_normal((left.shape[1], PROJECTIONS))
    distance = math.sqrt(2 - 2 * threshold)
    window, least = math.ceil(WIDTH * distance * SCALE) + 1, calibrated_count()
    reach = math.ceil(REACH * distance * SCALE) + 1

    def project(vectors):
        return np.clip(np.rint(vectors @ directions * SCALE), -15000, 15000).astype(np.int16)

    p, q = project(left), project(right)
    middle = np.median(q, axis=0)
    best = np.abs(p - middle).argmax(axis=1)
    own = p[np.arange(len(p)), best].astype(np.int64)
    queries = np.lexsort((own, own > middle[best], best))
    for d in np.unique(best):
        of = queries[best[queries] == d]
        order = np.argsort(q[:, d], kind="stable")
        sorted_ = np.ascontiguousarray(q[order].T)
        for side in (own[of] > middle[d], own[of] <= middle[d]):
            for k in range(0, int(side.sum()), QUERIES):
                query = of[side][k : k + QUERIES]
                lo = np.searchsorted(sorted_[d], own[query[0]] - reach, "left")
                hi = np.searchsorted(sorted_[d], own[query[-1]] + reach, "right")
                if lo == hi:
                    continue
                hits = np.zeros((len(query), hi - lo), np.uint8)
                for e in range(PROJECTIONS):
                    hits += np.abs(sorted_[e, lo:hi][None, :] - p[query, e][:, None]) <= window
                a, b = np.nonzero(hits >= least)
                i, j = query[a], order[lo:hi][b]
                if same:
                    i, j = i[j > i], j[j > i]
                for s in range(0, len(i), 1 << 16):
                    x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    true = np.einsum("ij,ij->i", left[x], right[y]) >= threshold
                    yield x[true], y[true]


def _block_links(table: pa.Table) -> pa.Table:
    """Of one pair of blocks: for each vector the rows it links with, and edges that span the links."""
    out = {"vec": [], "other": [], "links": []}
    if table.num_rows:
        ids = table.column("vec").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        dim = table.column("dim")[0].as_py()
        vectors = table.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left = np.flatnonzero(side == 0)
        left = left[np.argsort(ids[left])]
        right = left if same else np.flatnonzero(side == 1)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in linked_pairs(vectors[left], vectors[right], same=same):
            x, y = left[x], right[y]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            open_ = root[x] != root[y]
            for a, b in zip(x[open_].tolist(), y[open_].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    a, b = (a, b) if ids[a] < ids[b] else (b, a)
                    root[b] = a
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
        has = np.flatnonzero(links)
        off = np.flatnonzero(root != np.arange(len(ids)))
        out = {
            "vec": np.r_[ids[has], ids[off]],
            "other": np.r_[ids[has], ids[root[off]]],
            "links": np.r_[links[has], np.zeros(len(off), np.int64)],
        }
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """Returns (vec_id, n_links, component_id, kept) for each row.

    Rows link if their labels are equal and not null and their vectors, of one length, have a cosine of 0.93 or more in double
    precision. Vectors that are null, zero or empty or hold null or non-finite components link with nothing, nor do rows without vec_id,
    whose component_id is null. vec_id is of any type that has an order; rows may share one, and are rows of their own.
    kept: the row's vec_id is the smallest of its component, or null.
    Equal vectors of a label are one node with a number of copies, which links with itself as often: copies are never paired.
    A label's nodes are dealt by hash to blocks of about `block`, and tasks take pairs of blocks, so that none holds a whole label; blocks
    grow before a vector is copied more than MOST_COPIES times.
    n_links counts rows; no list of links is made, and the edges that leave a task span its links, under two blocks' number.
    """
    scratch = Scratch(table.sparkSession)
    e = F.col("e")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    ok = rows.where("ok").drop("ok").withColumn("dim", F.size("e"))
    nodes = ok.groupBy("label", "dim", "e").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.keep(nodes.withColumn("vec", F.monotonically_increasing_id()), "nodes")
    n = F.count(F.lit(1))
    blocks = F.least(F.ceil(n / block), F.greatest(F.lit(MOST_COPIES), F.ceil(n * F.first("dim") * 8 / BLOCK_BYTES)))
    groups = scratch.keep(nodes.groupBy(F.col("label").alias("g_label"), F.col("dim").alias("g_dim")).agg(blocks.cast("int").alias("blocks")), "labels")
    dealt = nodes.join(sized(groups, groups.count()), (nodes.label == groups.g_label) & (nodes.dim == groups.g_dim))
    own = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "vec", "copies", "e")
    parts = dealt.groupBy("label", "dim", "i", "j").applyInArrow(_block_links, "vec long, other long, links long")
    parts = scratch.keep(parts, "links")
    found = connected_components(parts.where("vec != other"), scratch, "vec", "other")
    counts = parts.where("vec = other").groupBy("vec").agg(F.sum("links").alias("links"))
    joined = nodes.join(counts, "vec", "left").join(found.withColumnRenamed("node", "vec"), "vec", "left")
    told = joined.select("label", "e", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component"))
    told = scratch.keep(told, "told")
    first = scratch.keep(told.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id")), "components")
    named_ = told.join(first, told.component == first.of).select(F.col("label").alias("n_label"), F.col("e").alias("n_e"), "n_links", "component_id")
    out = rows.where("ok").join(named_, (F.col("label") == F.col("n_label")) & (e == F.col("n_e"))).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
