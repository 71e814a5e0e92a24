"""Centroid clustering on whole numbers, filtered by kd-trees.

Vectors become integers once and are stored in the order of a kd-tree of their task. In each round a task takes its
vectors as they come, in runs of ``LEAF``; the runs are the leaves of a tree whose nodes hold counts, integer sums and
boxes (smallest and largest component). From the root down, the centroid nearest to a box's middle prunes every other
that is strictly farther from all points of the box. A node with one centroid left is assigned whole, by its count and
sums; the points of leaves with several are compared with those, exactly.

Scale: a round is one pass over the stored integers. It sends one row (count and sums) for each task and centroid, and
the driver gets those of all tasks summed: centroids x components numbers. No vector is shuffled or collected, but for
the first centroids; the trees bound work and memory by a batch, whatever the number of equal or near vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import scan, scan_with, stage, unstage

LEAF = 32
SCALE = 64
#: Largest squared length of a kept integer vector: squared distances then fit 63 bits.
MOST_NORM = float(1 << 60)


def kd_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows in the order of a kd-tree's leaves: halved at the median of the widest component, down to ``leaf`` rows."""
    order = np.arange(len(x))
    open_runs = [(0, len(x))]
    while open_runs:
        i, j = open_runs.pop()
        if j - i <= leaf:
            continue
        part = x[order[i:j]]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        half = leaf * max(1, round((j - i) / leaf / 2))  # leaves stay full, so runs of ``leaf`` rows are the leaves
        order[i:j] = order[i:j][np.argpartition(part[:, axis], min(half, j - i - 1))]
        open_runs += [(i, i + half), (i + half, j)]
    return order


def tree(x: np.ndarray, leaf: int = LEAF) -> list[dict[str, np.ndarray]]:
    """Levels of a tree over runs of ``leaf`` rows, root last: first row, count, sums, lo and hi of each node."""
    start = np.arange(0, len(x), leaf)
    level = {
        "start": start, "count": np.diff(np.append(start, len(x))), "sums": np.add.reduceat(x, start, axis=0),
        "lo": np.minimum.reduceat(x, start, axis=0), "hi": np.maximum.reduceat(x, start, axis=0),
    }
    out = [level]
    while len(level["start"]) > 1:
        at = np.arange(0, len(level["start"]), 2)
        how = {"start": np.minimum, "count": np.add, "sums": np.add, "lo": np.minimum, "hi": np.maximum}
        level = {k: how[k].reduceat(v, at, axis=0) for k, v in level.items()}
        out.append(level)
    return out


def undominated(lo: np.ndarray, hi: np.ndarray, mask: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``mask`` (nodes x centroids) without those that the centroid nearest to the box's middle strictly dominates.

    z* dominates z if |z - v|^2 > |z* - v|^2 at the corner v of the box that lies farthest towards z: then so it does
    everywhere in the box. In floating point, with a margin over its error, so nothing is ever pruned wrongly.
    """
    c = centroids.astype(np.float64)
    lo, hi = lo.astype(np.float64), hi.astype(np.float64)
    middle = (((lo + hi) / 2)[:, None, :] - c) ** 2
    best = np.where(mask, middle.sum(axis=2), np.inf).argmin(axis=1)
    step = c[None, :, :] - c[best][:, None, :]
    corner = np.where(step > 0, hi[:, None, :], lo[:, None, :])
    terms = step * (c[None, :, :] + c[best][:, None, :] - 2 * corner)
    out = mask & ~(terms.sum(axis=2) > np.abs(terms).sum(axis=2) * 2.0**-44)
    out[np.arange(len(best)), best] = True
    return out


def filtered(x: np.ndarray, centroids: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(owner of each row, or -1 where it lies in a node assigned whole; count and sums of those nodes by centroid; what was
    done). Ties go to the smaller number."""
    levels, k = tree(x, leaf), len(centroids)
    count, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    owner = np.full(len(x), -2, np.int64)
    mask = np.ones((1, k), bool)
    node = np.zeros(1, np.int64)
    done = {"nodes": 0, "whole": 0, "distances": 0}
    whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        mask = undominated(level["lo"][node], level["hi"][node], mask, centroids)
        done["nodes"] += len(node)
        one = mask.sum(axis=1) == 1
        if one.any():
            c = mask[one].argmax(axis=1)
            np.add.at(count, c, level["count"][node[one]])
            np.add.at(sums, c, level["sums"][node[one]])
            whole.append((level["start"][node[one]], level["count"][node[one]], c))
            done["whole"] += int(level["count"][node[one]].sum())
        node, mask = node[~one], mask[~one]
        if depth:
            below = len(levels[depth - 1]["start"])
            node, mask = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([mask, mask])
            node, mask = node[node < below], mask[node < below]
        if not len(node):
            break
    for start, n, c in whole:
        for s, m, j in zip(start.tolist(), n.tolist(), c.tolist()):
            owner[s : s + m] = -1 - j - 2  # told apart from leaves: -3 - centroid
    if len(node):
        rows = (levels[0]["start"][node][:, None] + np.arange(leaf)).ravel()
        many = np.repeat(mask, leaf, axis=0)[rows < len(x)]
        rows = rows[rows < len(x)]
        nearest, which = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
        for j in range(k):
            asked = np.flatnonzero(many[:, j])
            d = ((x[rows[asked]] - centroids[j]) ** 2).sum(axis=1)
            closer = d < nearest[asked]
            nearest[asked[closer]], which[asked[closer]] = d[closer], j
            done["distances"] += len(asked)
        owner[rows] = which
    return owner, count, sums, done


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def integers(vectors: DataFrame, width: int = 64, scale: int = SCALE, leaf: int = LEAF) -> DataFrame:
    """vec_id, x: the kept vectors as floor(scale * component), in kd order within a batch."""

    def one(b: pa.RecordBatch) -> dict:
        v = b.column("embedding")
        keep = np.flatnonzero(np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False), nan=-1) == width)
        v = v.take(pa.array(keep))
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * scale
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(x)
            fit = (x**2).sum(axis=1) <= MOST_NORM  # false for NaN (nulls too) and infinite ones
        x, keep = x[fit].astype(np.int64), keep[fit]
        order = kd_order(x, leaf)
        flat = pa.array(x[order].astype(np.int32).ravel())
        return {"vec_id": b.column("vec_id").take(pa.array(keep[order])), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), flat)}

    return scan(vectors.select("vec_id", "embedding"), "vec_id bigint, x array<int>", one)


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``1:<vec_id>``; of one id the smaller vector first, rows without an id last."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.select("x", key.alias("key")).orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in found], np.int64)


def partial_sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, sums: one row for each task and centroid that has vectors."""
    width = centroids.shape[1]

    def make():
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)

        def one(b: pa.RecordBatch) -> None:
            x = _matrix(b.column("x"), width)
            owner, n, s, _ = filtered(x, centroids)
            np.add(count, n, out=count)
            np.add(sums, s, out=sums)
            left = owner >= 0
            np.add.at(count, owner[left], 1)
            np.add.at(sums, owner[left], x[left])

        def last() -> dict:
            full = np.flatnonzero(count)
            return {"cluster": full, "n": count[full], "sums": sums[full].tolist()}

        return one, last

    return scan_with(rows.select("x"), "cluster int, n bigint, sums array<bigint>", make)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each component; centroids without vectors stay."""
    each = partial_sums(rows, centroids).select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    total = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # centroids x components
    out = centroids.copy()
    for r in total:
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    width = centroids.shape[1]

    def one(b: pa.RecordBatch) -> dict:
        x = _matrix(b.column("x"), width)
        owner = filtered(x, centroids)[0]
        owner = np.where(owner < 0, -3 - owner, owner)
        return {"vec_id": b.column("vec_id"), "cluster": owner, "distance": ((x - centroids[owner]) ** 2).sum(axis=1)}

    return scan(rows, "vec_id bigint, cluster int, distance bigint", one)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Null vectors, those of another length and those with a null, NaN or infinite component are not kept; neither are those
    whose integers have a squared length over 2^60, as their distances don't fit a long. Repeated rows are vectors each;
    a null vec_id is kept and starts a centroid only where others are too few. With fewer than k vectors there are as many
    centroids. An empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stage(integers(vectors, width), "integers")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    out = stage(assigned(rows, centroids), "assigned")
    unstage(rows)
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(j, s, total, digest[j]) for j, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """The same in SQL, round after round."""
    d = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    s = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width})",
        f"c0 AS (SELECT j, x AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS j, x FROM v) WHERE j < {k})",
    ]
    for r in range(rounds + 1):
        s.append(f"a{r} AS (SELECT vec_id, x, arg_min(j, o) AS j, min(o[1]) AS d FROM (SELECT n, vec_id, x, j, [{d}, j] AS o FROM (SELECT row_number() OVER () AS n, * FROM v) v, c{r}) GROUP BY n, vec_id, x)")
        if r < rounds:
            s.append(f"m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY j, i) GROUP BY j)")
            s.append(f"c{r + 1} AS (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.j = m{r}.j)")
    return "WITH " + ",\n".join(s) + f"""
SELECT vec_id, a.j::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"""
