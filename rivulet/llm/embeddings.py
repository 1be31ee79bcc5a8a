"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, exact verification.

Equal vectors form a class first; classes stand for their vectors from then on. Each table rotates a vector by three rounds of
random signs and the fast Hadamard transform, once for each part; a part's hash is the axis with the largest absolute
coordinate among its first `width` ones, and its sign. A vector lies in the bucket of its hashes and probes `probes` more,
those that change one part to its next best axis at the least loss. Two vectors are candidates where one's bucket is among the
other's buckets.

The parts follow from the number of classes: buckets are at least `spread` times as many (and more by what random vectors are
seen to crowd), so that the number of unrelated vectors a vector meets does not grow with the table. The number of tables follows from the parts: as many as a pair at the
threshold needs to meet with probability `recall`, which is measured on random pairs of the dimension while planning.

Buckets are dealt into pairs of bounded blocks, verified there by cosine in double precision, and never listed as pairs:
a task returns each vector's number of links and a forest of the links. A pair that meets in several buckets counts in the
first of them only, which the tasks tell from the codes that come with each vector. Buckets of one vector are dropped before
any vector is sent.

Defined cases: a vector that is null, zero, or holds null or non-finite components links with nothing and is kept; vectors
of different lengths never link; a null vec_id has no component and counts nowhere; rows are vectors of their own even where
they repeat a vec_id; equal rows get equal results; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import durable, group_starts, pairs_within, whole_groups
from rivulet.llm.components import blocks, components


@lru_cache(16)
def _signs(dim: int, tables: int, parts: int) -> np.ndarray:
    """The first tables are the same whatever their number."""
    return np.stack([np.random.default_rng([dim, t]).choice([-1.0, 1.0], (parts, 3, dim)) for t in range(tables)])


def padded_size(dim: int) -> int:
    return max(2, 1 << (dim - 1).bit_length())


def part_widths(dim: int, buckets: float) -> tuple[int, ...]:
    """Widths of the parts of a code: the fewest whose codes are at least so many; the last one may be narrower."""
    size, out, have = padded_size(dim), [], 1
    while not out or have < buckets:
        width = size
        while have > 1 and width > 1 and have * width >= buckets:
            width //= 2
        out.append(width)
        have *= 2 * width
    return tuple(out)


@lru_cache(64)
def crowding(dim: int, widths: tuple[int, ...], vectors: int = 20_000) -> float:
    """How many times more often random vectors share a bucket than they would if all buckets were as likely: parts of one
    vector depend on each other. Measured on as many parts as the vectors can tell."""
    while len(widths) > 1 and math.prod(2 * w for w in widths) > vectors**2 / 50:
        widths = widths[:-1]
    x = np.random.default_rng(11).normal(size=(vectors, dim))
    code = codes(x / np.linalg.norm(x, axis=1, keepdims=True), widths, 1, 0)[:, 0, 0]
    n = np.unique(code, return_counts=True)[1]
    return max(1.0, float((n * (n - 1)).sum()) * math.prod(2 * w for w in widths) / (vectors * (vectors - 1)))


def parts_for(dim: int, n: int, spread: float) -> tuple[int, ...]:
    """Widths of the parts by which a vector meets no more than n / (spread * n) random ones in its bucket."""
    widths = part_widths(dim, spread * n)
    for _ in range(4):
        need = spread * n * crowding(dim, widths)
        if math.prod(2 * w for w in widths) >= need:
            break
        widths = part_widths(dim, need)
    return widths


@lru_cache(16)
def tables_for(dim: int, widths: tuple[int, ...], probes: int, cosine: float, recall: float, pairs: int = 2000) -> int:
    """Tables by which random pairs at the threshold meet with probability recall."""
    r = np.random.default_rng(7)
    a, b = r.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    x, y = codes(a, widths, 2, probes), codes(cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * b, widths, 2, probes)
    met = ((x[..., :1] == y).any(2) | (y[..., :1] == x).any(2)).mean()
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - max(met, 1e-3)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the last axis, whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[-1], 1
    while h < n:
        x = x.reshape(*x.shape[:-1], -1, 2, h) if x.shape[-1] == n else x
        x = np.stack([x[..., 0, :] + x[..., 1, :], x[..., 0, :] - x[..., 1, :]], -2).reshape(*x.shape[:-3], n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, widths: tuple[int, ...], tables: int, probes: int) -> np.ndarray:
    """Bucket codes, vectors x tables x (1 + probes), the vector's own first; -1 where there is nothing left to probe.
    x: unit vectors as rows."""
    size = padded_size(x.shape[1])
    wide = np.zeros((len(x), size))
    wide[:, : x.shape[1]] = x
    out = np.full((len(x), tables, 1 + probes), -1, np.int64)
    signs = _signs(size, tables, len(widths))
    row = np.arange(len(x))
    for t in range(tables):
        own, others, loss, weight = np.zeros(len(x), np.int64), [], [], 1
        for p, width in enumerate(widths):
            y = wide
            for r in range(3):
                y = hadamard(y * signs[t, p, r])
            y = y[:, : min(width, size)]
            ranked = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : probes + 1]
            value = np.take_along_axis(y, ranked, 1)
            axis = 2 * ranked + (value > 0)
            own += axis[:, 0] * weight
            others.append((axis[:, 1:] - axis[:, :1]) * weight)
            loss.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
            weight *= 2 * y.shape[1]
        cheapest = np.argsort(np.concatenate(loss, 1), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = own
        out[:, t, 1 : 1 + cheapest.shape[1]] = own[:, None] + np.concatenate(others, 1)[row[:, None], cheapest]
    return out


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels after the links a, b."""
    while len(a):
        m = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], m)
        np.minimum.at(root, root[b], m)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _links(tables: int, probes: int, cosine: float, small: int = 128, step: int = 256):
    """Over rows sorted by group (bucket, i, j): rows (node, n_links, root), the links counted there and a forest of them."""
    keys = ["bucket", "i", "j"]

    def groups(rows: pd.DataFrame) -> pd.DataFrame:
        node, block, copies, table, bucket = (rows[c].to_numpy() for c in ("node", "block", "copies", "table", "code"))
        across = (rows["i"] != rows["j"]).to_numpy()
        x = np.frombuffer(b"".join(rows["vector"]), "<f8").reshape(len(rows), -1)
        c = np.frombuffer(b"".join(rows["codes"]), "<i8").reshape(len(rows), tables, 1 + probes)
        own = c[np.arange(len(rows)), table, 0] == bucket
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def count(u: np.ndarray, v: np.ndarray, root: np.ndarray) -> np.ndarray:
            at, first, place = table[u], np.ones(len(u), bool), bucket[u]
            for t in range(tables):
                there = c[u, t, 0] >= 0
                forth = there & (c[u, t, :1] == c[v, t]).any(1)  # the first's own bucket is among the second's
                back = there & (c[v, t, :1] == c[u, t]).any(1)
                first &= ~((forth | back) & (t < at)) & ((t != at) | (np.where(forth, c[u, t, 0], c[v, t, 0]) == place))
            u, v = u[first], v[first]
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            return _merge(root, u, v)

        starts = group_starts(rows, keys)
        sizes = np.diff(np.append(starts, len(rows)))
        little = np.repeat(sizes <= small, sizes)
        place = np.flatnonzero(little)
        u, v = pairs_within(sizes[sizes <= small])
        for lo in range(0, len(u), 50_000):
            a, b = place[u[lo : lo + 50_000]], place[v[lo : lo + 50_000]]
            able = (own[a] | own[b]) & (~across[a] | (block[a] != block[b]))
            a, b = a[able], b[able]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            root = count(a[near], b[near], root)
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            for k in range(s, s + n, step):
                mine = np.arange(k, min(k + step, s + n))
                near = (x[mine] @ x[s : s + n].T) >= cosine
                near &= (mine[:, None] < np.arange(s, s + n)) & (own[mine, None] | own[s : s + n])
                if across[s]:
                    near &= block[mine, None] != block[s : s + n]
                a, b = np.nonzero(near)
                for lo in range(0, len(a), 100_000):
                    root = count(mine[a[lo : lo + 100_000]], s + b[lo : lo + 100_000], root)
        some = links > 0
        return pd.DataFrame({"node": node[some], "n_links": links[some], "root": node[root[some]]})

    def run(batches):
        for rows in whole_groups(batches, keys):
            yield from by_length(rows)

    def by_length(rows: pd.DataFrame):
        """A group's vectors have one length; different groups may differ."""
        length = rows["vector"].map(len)
        for n in length.unique():
            yield groups(rows[length == n].reset_index(drop=True))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, probes: int = 3, recall: float = 0.99, spread: float = 4.0, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding."""
    wide = F.col("embedding").cast("array<double>")
    sound = F.coalesce((F.size("wide") > 0) & ~F.exists("wide", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("wide", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", wide.alias("wide")).withColumn("sound", sound)
    # Adding 0 makes -0 equal to 0; the text of the array is the class.
    rows = rows.select("vec_id", F.when(F.col("sound"), F.transform("wide", lambda x: x + F.lit(0.0))).alias("wide"))
    rows = rows.withColumn("node", F.when(F.col("wide").isNotNull(), F.unhex(F.md5(F.to_json("wide").cast("binary")))))
    classes = rows.where("node is not null and vec_id is not null").groupBy("node").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("wide").alias("wide"))

    def unit(batches):
        for batch in batches:
            x = [np.asarray(v, np.float64) for v in batch["wide"]]
            x = [v / np.abs(v).max() for v in x]  # keeps squares within range
            x = [v / np.linalg.norm(v) for v in x]
            yield pd.DataFrame({"node": batch["node"], "id": batch["id"], "copies": batch["copies"], "dim": [len(v) for v in x], "vector": [v.astype("<f8").tobytes() for v in x]})

    classes = durable(classes.mapInPandas(unit, "node binary, id long, copies long, dim int, vector binary"))
    # The parts and tables of each length of vectors; only numbers of vectors by length come to the driver.
    plans = {}
    for dim, n in classes.groupBy("dim").count().collect():
        widths = parts_for(dim, n, spread)
        plans[dim] = widths, tables_for(dim, widths, probes, cosine, recall)
    tables = max([t for _, t in plans.values()], default=1)

    def describe(batches):
        for batch in batches:
            for dim in sorted(batch["dim"].unique()):
                part = batch[batch["dim"] == dim]
                x = np.frombuffer(b"".join(part["vector"]), "<f8").reshape(len(part), dim)
                code = np.full((len(x), tables, 1 + probes), -1, np.int64)
                widths, own = plans[dim]
                code[:, :own] = codes(x, widths, own, probes)
                yield part[["node", "id", "copies", "dim", "vector"]].assign(codes=[v.tobytes() for v in code], code=code.reshape(len(x), -1).tolist())

    schema = "node binary, id long, copies long, dim int, vector binary, codes binary, code array<long>"
    known = durable(classes.mapInPandas(describe, schema), replaces=classes)
    places = known.select("node", "dim", F.posexplode("code").alias("p", "code")).where("code >= 0").select("node", F.expr(f"p div {1 + probes}").cast("int").alias("table"), "code", (F.col("p") % (1 + probes) == 0).alias("own"), "dim")
    places = places.withColumn("bucket", F.xxhash64("dim", "table", "code"))
    # A bucket can hold a candidate pair only if it is some vector's own and another one's too.
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("o")).where("m > 1 and o").select("bucket")
    dealt = blocks(places.join(shared, "bucket"), "bucket", "node", block)
    met = dealt.join(known.select("node", "copies", "vector", "codes"), "node").select("bucket", "i", "j", "block", "node", "copies", "table", "code", "vector", "codes")
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = durable(met.mapInPandas(_links(tables, probes, cosine), "node binary, n_links long, root binary"))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    parts_of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = parts_of.join(known.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("c"))
    placed = known.select("node", "id", "copies").join(counts, "node", "left").join(parts_of.join(least, "component").select("node", "c"), "node", "left")
    placed = placed.where("copies > 1 or c is not null").select("node", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n"), F.coalesce("c", "id").alias("c"))
    return rows.select("vec_id", "node").join(placed, "node", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("c", "vec_id"), F.lit(True)).alias("kept")
    )
