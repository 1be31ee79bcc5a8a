"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification.

Documents with equal shingle sets form a class, and classes stand for their documents from then on. A signature holds
`bands * rows` minima (16 bits each); classes that agree in a band share a bucket and are candidates. Candidates are never
listed: groups of rows with signatures and whole sets go to tasks, which prune, verify and return a forest of the links.

1. Stars: in each bucket every member meets the bucket's first one, in blocks of bounded size. The links are merged.
2. Buckets that still hold several components: all pairs of members of different components meet in bounded pairs of
   blocks. A pair that shares several bands is looked at in the first of them only.

A task compares signatures 32 minima at a time. After m agreements of n the posterior of the similarity under a flat prior is
Beta(m + 1, n - m + 1); a pair is dropped once its chance to reach the threshold falls under `miss`. What survives is
verified exactly on the full sets, unless the task has linked both sides already. So every surviving candidate is verified or
lies within a component: no link is lost to a cap.

Scale: a class is shipped once for each of its buckets that are still mixed, so a group of m near copies costs about m rows
once the stars have joined it. Blocks are sized by rows and by shingles; sets are hashed words of 8 bytes. A bucket of m rows
without any link between them costs m * m / 2 signature comparisons and m / block copies of each row, but no rows out.

Defined cases: null, empty and blank texts have an empty set and link with nothing; fewer words than a shingle make one
shingle; a null doc_id has no component, is kept and links with nothing; rows are documents of their own even where they
repeat a doc_id (component_id is the smallest doc_id of all rows reachable); equal rows get equal results; columns other than
doc_id and text are not read; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import durable, group_starts, long_id, pairs_within, slices, text_id, whole_groups
from rivulet.llm.components import blocks, components

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
STEP = 32


class Words(dict):
    """64-bit hash of each word; at most `remember` words are kept."""

    def __init__(self, remember: int = 600_000):
        super().__init__()
        self.remember = remember

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.remember:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def shingles(self, text: str | None, k: int) -> np.ndarray:
        """Sorted distinct hashes of the runs of k words; words are what lies between spaces and the bytes 9 to 13."""
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k, n = min(k, len(h)), max(1, len(h) - k + 1)
        total = np.full(n, k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                total = (total ^ h[i : i + n]) * MULTIPLIER
                total ^= total >> np.uint64(29)
        return np.unique(total)


@lru_cache(4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240101)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(sets: np.ndarray, n: int) -> bytes:
    a, b = _permutations(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(sets), 2048):
        low = np.minimum(low, (sets[k : k + 2048, None] * a + b).min(0))
    low = (low ^ (low >> np.uint64(32))) * MULTIPLIER
    return (low >> np.uint64(48)).astype("<u2").tobytes()


@lru_cache(8)
def least_matches(n: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For 32, 64, ... n minima compared: the fewest agreements whose posterior chance of the threshold is at least miss."""

    def chance(m: int, k: int) -> float:  # P(Beta(m+1, k-m+1) >= t) as a binomial tail
        return sum(math.comb(k + 1, i) * threshold**i * (1 - threshold) ** (k + 1 - i) for i in range(m + 1))

    return tuple(next(m for m in range(k + 1) if m == k or chance(m, k) >= miss) for k in range(STEP, n + 1, STEP))


def survivors(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which rows of a and b outlast the batches of minima."""
    left, total = np.arange(len(b)), np.zeros(len(b), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        total[left] += (a[left, part] == b[left, part]).sum(1)
        left = left[total[left] >= need]
        if not len(left):
            break
    return left


class Sets:
    """The sets of a frame's rows, their shingles numbered, for exact sizes of intersections."""

    def __init__(self, column: pd.Series):
        self.size = column.map(len).to_numpy() // 8
        self.begin = np.cumsum(self.size) - self.size
        known, number = np.unique(np.frombuffer(b"".join(column), "<u8"), return_inverse=True)
        self.number, self.flag = number, np.zeros(len(known), bool)

    def linked(self, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
        """Whether 100 * intersection >= percent * union, for each pair of rows. Pairs with one u should follow each other."""
        out = np.zeros(len(u), bool)
        small, large = np.minimum(self.size[u], self.size[v]), np.maximum(self.size[u], self.size[v])
        able = np.flatnonzero(100 * small >= percent * large)
        cut = np.flatnonzero(np.diff(u[able], prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = able[a:b]
            x = u[at[0]]
            own = self.number[self.begin[x] : self.begin[x] + self.size[x]]
            self.flag[own] = True
            n = self.size[v[at]]
            first = np.cumsum(n) - n
            both = np.add.reduceat(self.flag[self.number[np.repeat(self.begin[v[at]] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
            self.flag[own] = False
            out[at] = 100 * both >= percent * (len(own) + n - both)
        return out


class Forest:
    """Merges labels by links and tells which links joined something."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                out[k] = True
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root[a] != self.root[b]


def _largest(group: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which rows are of the component that most rows of their group have."""
    order = np.lexsort((part, group))
    g, p = group[order], part[order]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])]))
    count = np.diff(np.append(new, len(order)))
    best = np.lexsort((-p[new], count, g[new]))
    last = np.flatnonzero(np.append(g[new][best][1:] != g[new][best][:-1], True))
    return p[new][best][last][group] == part


def _forests(bands: int, rows: int, least: tuple[int, ...], percent: int, keys: list[str], small: int = 128, step: int = 20_000):
    """Over rows sorted by group (keys), with node, component, signature and shingles: a forest of the links a, b that the
    groups' pairs have. With a column hub only pairs with a hub count; else those of different components in different
    blocks (or in the one block of i = j), in the first band that they share."""

    def search(table: pd.DataFrame) -> pd.DataFrame:
        node = table["node"].to_numpy()
        part = pd.factorize(table["component"], sort=True)[0]
        sig = np.frombuffer(b"".join(table["signature"]), "<u2").reshape(len(table), -1)
        sets, forest, found = Sets(table["shingles"]), Forest(int(part.max()) + 1), []
        starts = group_starts(table, keys)
        sizes = np.diff(np.append(starts, len(table)))
        stars = "hub" in table
        if stars:
            hub = table["hub"].to_numpy()
        else:
            largest = _largest(np.repeat(np.arange(len(sizes)), sizes), part)
            i, j, block, band = (table[c].to_numpy() for c in ("i", "j", "block", "band"))

        def verify(u: np.ndarray, v: np.ndarray) -> None:
            able = forest.apart(part[u], part[v])
            if not stars:
                able &= (i[u] == j[u]) | (block[u] != block[v])
            u, v = u[able], v[able]
            left = survivors(sig[u], sig[v], least)
            u, v = u[left], v[left]
            if not stars:
                first = (sig[u].reshape(-1, bands, rows) == sig[v].reshape(-1, bands, rows)).all(2).argmax(1) == band[u]
                u, v = u[first], v[first]
                u, v = np.where(largest[u], v, u), np.where(largest[u], u, v)
                order = np.argsort(u, kind="stable")
                u, v = u[order], v[order]
            true = sets.linked(u, v, percent)
            u, v = u[true], v[true]
            new = forest.join(part[u], part[v])
            found.append((u[new], v[new]))

        if stars:
            for s, m in zip(starts.tolist(), sizes.tolist(), strict=True):
                inner = np.arange(s, s + m)
                for h in inner[hub[s : s + m]]:
                    for k in range(0, m, step):
                        others = inner[~hub[s : s + m]][k : k + step]
                        verify(np.full(len(others), h), others)
        else:
            little = sizes <= small
            place = np.flatnonzero(np.repeat(little, sizes))
            u, v = pairs_within(sizes[little])
            for k in range(0, len(u), step):
                verify(place[u[k : k + step]], place[v[k : k + step]])
            for s, m in zip(starts[~little].tolist(), sizes[~little].tolist(), strict=True):
                # Members of the largest component need no search of their own.
                own = s + np.flatnonzero(~largest[s : s + m])
                wide = max(1, step // m)
                for k in range(0, len(own), wide):
                    x = np.repeat(own[k : k + wide], m)
                    y = np.tile(np.arange(s, s + m), len(own[k : k + wide]))
                    once = largest[y] | (y > x)
                    verify(x[once], y[once])
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        return pd.DataFrame({"a": node[a], "b": node[b]}, dtype=object)

    def run(batches):
        for table in whole_groups(batches, keys):
            yield search(table)

    return run


def _grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int, miss: float, block: int) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id, kept for every row."""
    n = bands * rows
    least = least_matches(n, percent / 100, miss)

    def describe(batches):
        words = Words()
        for batch in slices(batches):
            sets = [words.shingles(x, k) for x in batch["text"]]
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n_shingles": [len(s) for s in sets], "node": marks, "signature": [signature(s, n) if len(s) else None for s in sets]})

    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    known = durable(long_id(docs.select(text_id(), "text", digest).mapInPandas(describe, "doc_id string, digest string, n_shingles long, node binary, signature binary")))
    classes = known.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = durable(classes)

    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * (2 * rows) + 1, F.lit(2 * rows))))
    banded = classes.select("node", "n", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    members = durable(banded.join(shared, "key"))
    # Only what may have a near copy goes on, with its signature and its whole set. A text whose set is another one's has
    # only the doc_id in common with the class.
    chosen = classes.select("id", "node", "signature").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(chosen, "id").select("text", "node", "signature")

    def sets_of(batches):
        words = Words()
        for batch in slices(batches):
            sets = [words.shingles(x, k).tobytes() for x in batch["text"]]
            same = [hashlib.blake2b(s, digest_size=16).digest() == bytes(m) for s, m in zip(sets, batch["node"], strict=True)]
            yield pd.DataFrame({"node": batch["node"], "signature": batch["signature"], "shingles": sets})[same]

    sets = durable(texts.mapInPandas(sets_of, "node binary, signature binary, shingles binary").dropDuplicates(["node"]))

    roots = members.groupBy("key").agg(F.min("node").alias("root"))
    stars = members.join(roots, "key").where("node != root").select("root", "node", "n").distinct()
    # A root with many members has them dealt out to several copies of itself; every block of members is bounded.
    size = stars.groupBy("root").agg(F.ceil(F.sum(1 + F.col("n") / 500) / block).cast("int").alias("parts"))
    dealt = stars.join(size, "root").select("root", "node", F.expr("pmod(xxhash64(node), parts)").cast("int").alias("i"), F.lit(False).alias("hub"))
    dealt = dealt.union(dealt.select("root", F.col("root").alias("node"), "i", F.lit(True)).distinct()).join(sets, "node").withColumn("component", F.col("node"))
    dealt = dealt.repartition("root", "i").sortWithinPartitions("root", "i")
    found = components(dealt.mapInPandas(_forests(bands, rows, least, percent, ["root", "i"]), "a binary, b binary"))

    placed = members.join(found, "node", "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    dealt = blocks(placed.join(mixed, "key"), "key", "node", block, 1 + F.col("n") / 500).drop("n").join(sets, "node")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    fresh = dealt.mapInPandas(_forests(bands, rows, least, percent, ["key", "i", "j"]), "a binary, b binary")
    # A forest's ends lie in components, which their nodes' own links of the first round hold together.
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(fresh))

    linked = found.join(classes.select("node", "id"), "node")
    least_id = linked.groupBy("component").agg(F.min("id").alias("c"))
    linked = linked.join(least_id, "component").select("node", "c")
    # Most classes are one document without links; those need no place.
    placed = classes.select("node", "id", "copies").join(linked, "node", "left").where("copies > 1 or c is not null").select("node", F.coalesce("c", "id").alias("c"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return known.drop("signature").join(placed, "node", "left").select("doc_id", "digest", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, miss: float = 1e-4, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: links where 100 * intersection >= percent * union of k-word shingles."""
    return _grouped(docs, k, percent, bands, rows, miss, block).drop("digest")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, miss: float = 1e-4, block: int = 1024) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id, with all its columns.

    Rows with equal doc_id and equal text are one document; rows with equal doc_id and different texts are looked at each by
    itself, and two of them that lie in one group both stay if theirs is the smallest doc_id. Rows without a doc_id stay.
    """
    known = F.coalesce("digest", F.lit("")).alias("digest")
    kept = _grouped(docs, k, percent, bands, rows, miss, block).where("kept and doc_id is not null").select("doc_id", known).distinct()
    rows_ = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("digest"))
    one = rows_.where("doc_id is not null").join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return one.select("doc").union(rows_.where("doc_id is null").select("doc")).select("doc.*")
