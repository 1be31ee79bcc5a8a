"""Exact repeated substrings of a fixed length over all documents, by blockwise suffix sorting with a difference cover.

Sorting every suffix of the corpus would shuffle many times the input, so suffixes are first dealt into buckets, and only
buckets that can hold a twin are sorted, one after the other, in tasks of bounded memory:

1. Anchors. Each window of `length` bytes names the leftmost of its smallest strings of GRAM bytes (by hash) as its anchor. Equal
   windows have equal anchors at equal offsets, so an anchor's bytes are what a bucket's suffixes share. An anchor with the
   bytes of all its windows is a context. A context that a document holds twice is a repeat as it is; it is sent on once.
2. Equal contexts are one, with their number (map-side combined). Where it is two or more, all windows of all of them repeat.
   Anchors that occur once are dropped before (their windows are unique), and a bucket of one context needs no sorting.
3. Sorting. Of the other buckets each distinct context is cut from one text that holds it. A bucket of more than `limit`
   contexts is split by the bytes that its suffixes share around the anchor: windows go by ranges of their offset, and all
   windows of a range share at least length - SPREAD bytes. In a block of whole buckets the suffixes at a difference cover modulo 7
   are ranked lexicographically to a depth of length - 6 bytes at least (prefix tripling from words of 7 bytes). The windows of
   a bucket are then put in lexicographic order: by their first word, ties by the ranks of the two samples at the pair's
   common cover shift (each residue class is sorted, then classes are merged), and last by their last 14 bytes. Neighbours
   are compared byte by byte.
4. Marks return to their documents, and covered bytes are removed.

Hashes choose anchors and bring rows together; whether two windows are equal is decided by their bytes, or by two hashes of 64 bits
each (anchor and context) where whole contexts are equal. Documents are told apart by 96 bits of doc_id and text.

Defined cases: null, empty and short texts have no windows and stay whole; equal rows are different documents; matches never
cross documents; ids may be null or repeat; other columns are not read; an empty table gives no rows; long texts are
handled whole, and periodic ones send each distinct context once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import durable, group_starts, long_id, slices, text_id, whole_groups

GRAM = 48
#: Windows of a context that its shape can count.
WINDOWS = 1 << 10
#: Offsets of a range into which the windows of a large bucket are split.
SPREAD = 22
#: Perfect difference cover: every difference modulo 7 occurs between two of its members. Fixed values.
PERIOD, COVER = 7, (0, 1, 3)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MASK = (1 << 64) - 1


def cover_shift() -> np.ndarray:
    """[a][b]: least d such that both a + d and b + d, modulo the period, lie in the cover."""
    return np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


@lru_cache(4)
def _bytes_to_words(which: int) -> np.ndarray:
    return np.random.default_rng(97 + which).integers(0, MASK, 256, dtype=np.uint64, endpoint=True)


class Rolling:
    """Hashes of any substring of a byte array, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), base, np.uint64)]))
            self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), pow(base, -1, 1 << 64), np.uint64)]))
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(_bytes_to_words(which)[data] * power[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.total[start + length] - self.total[start]) * self.inverse[start]
            h ^= h >> np.uint64(32)
            h *= np.uint64(BASES[0])
            return h ^ (h >> np.uint64(29))


def sliding_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest key of every window of `width` keys; keys are below 2^32."""
    n = len(key) - width + 1
    x = (key << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    pad = -len(x) % width
    x = np.concatenate([x, np.full(pad, MASK, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).reshape(-1)
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(texts: list[bytes], length: int, limit: int = 1 << 21):
    """For runs of texts of about `limit` bytes: (first text, its number of texts, data, starts of texts, rolling hash, and of
    each anchor: its text, place, first window and last window)."""
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        data = np.frombuffer(b"".join(texts[k:j]), np.uint8)
        sizes = np.array([len(x) for x in texts[k:j]])
        starts = np.cumsum(sizes) - sizes
        roll = Rolling(data)
        empty = np.zeros(0, np.int64)
        found = (empty,) * 4
        if len(data) >= length:
            n = len(data) - length + 1
            at = sliding_argmin(roll(np.arange(len(data) - GRAM + 1), GRAM) >> np.uint64(32), length - GRAM + 1)[:n]
            room = np.maximum(sizes - length + 1, 0)
            window = np.repeat(starts, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
            if len(window):
                owner = np.repeat(np.arange(len(sizes)), room)
                place = at[window]
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(window)]]) - 1
                found = owner[first], place[first], window[first], window[last]
        yield k, j - k, data, starts, roll, *found
        k = j


def contexts_of(roll: Rolling, owner, place, first, last, length: int):
    """Of each anchor: its 24 bytes' hash, its context's hash, whether it is the first of its text with that context, and
    whether the text holds the context again."""
    gram = roll(place, GRAM)
    with np.errstate(over="ignore"):
        context = roll(first, last - first + length) + ((place - first) * 512 + (last - first)).astype(np.uint64) * np.uint64(BASES[1])
        key = (gram * np.uint64(BASES[0])) ^ context
    order = np.lexsort((key, owner))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])]) if len(order) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    fresh, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    fresh[order], again[order] = new, np.bincount(run)[run] > 1 if len(order) else new
    return gram, context, fresh, again


def packed(check: np.ndarray, offset: np.ndarray, more: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A context's document check, its anchor's offset, its windows beyond the first one, and whether the document repeats it."""
    return (check.astype(np.int64) << 21) | (offset.astype(np.int64) << 11) | (more.astype(np.int64) << 1) | again


def unpacked(shape: int) -> tuple[int, int, int]:
    return shape >> 21, (shape >> 11) & 0x3FF, (shape >> 1) & 0x3FF


def words(data: np.ndarray) -> np.ndarray:
    """The PERIOD bytes from each place on as a number, the first one highest; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(PERIOD, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for i in range(PERIOD):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def sample_number(place: np.ndarray) -> np.ndarray:
    """Number of a sampled place; a period further on is len(COVER) numbers further on."""
    return place // PERIOD * len(COVER) + np.searchsorted(COVER, place % PERIOD)


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks without gaps."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def cover_ranks(word: np.ndarray, depth: int) -> np.ndarray:
    """By number, the lexicographic rank of each sampled suffix by its first `depth` bytes (a multiple of the period)."""
    place = (np.arange(-(-len(word) // PERIOD))[:, None] * PERIOD + np.array(COVER)).reshape(-1)
    rank, have = dense(word[np.minimum(place, len(word) - 1)]), PERIOD
    while have < depth:
        # Three ranks in a row make one three times as deep; they overlap where that would be too deep.
        reach, whole, span = min(3 * have, depth), rank, int(rank.max()) + 2
        for back in [have, reach - have] if reach > 2 * have else [reach - have]:
            k = min(back // PERIOD * len(COVER), len(rank))
            after = np.zeros(len(rank), np.int64)
            after[: len(rank) - k] = rank[k:] + 1
            if (int(whole.max()) + 1) * span >= 1 << 62:
                whole = dense(whole)
            whole = whole * span + after
        rank, have = dense(whole), reach
    return rank


def sorted_repeats(data: np.ndarray, bucket: np.ndarray, window: np.ndarray, length: int) -> np.ndarray:
    """Which windows (starts in data) have an equal one in their bucket, by sorting each bucket's windows."""
    out = np.zeros(len(window), bool)
    if not len(window):
        return out
    word = words(data)
    # By bucket and first word; what is alone there has no twin.
    order = np.lexsort((word[window], bucket))
    b, x = bucket[order], word[window[order]]
    new = np.concatenate([[True], (b[1:] != b[:-1]) | (x[1:] != x[:-1])])
    group = np.cumsum(new) - 1
    tied = np.bincount(group)[group] > 1
    at, group = order[tied], dense(group[tied])
    if not len(at):
        return out
    # Ties go by cover ranks and at last by the last two words.
    w, depth = window[at], (length - PERIOD + 1) // PERIOD * PERIOD
    rank, shift = cover_ranks(word, depth), cover_shift()
    y, z = word[w + length - 2 * PERIOD], word[w + length - PERIOD]
    order = np.lexsort((z, y))
    tail = np.zeros(len(w), np.int64)
    tail[order] = np.cumsum(np.concatenate([[False], (y[order][1:] != y[order][:-1]) | (z[order][1:] != z[order][:-1])]))
    spans = int(rank.max()) + 1, int(tail.max()) + 1
    if (int(group.max()) + 1) * spans[0] * spans[1] >= 1 << 63:
        raise ValueError("the block is too large")

    def key(members: np.ndarray, d: int) -> np.ndarray:
        return (group[members] * spans[0] + rank[sample_number(w[members] + d)]) * spans[1] + tail[members]

    classes = [np.flatnonzero(w % PERIOD == a) for a in range(PERIOD)]
    classes = [m[np.argsort(key(m, int(shift[a][a])), kind="stable")] for a, m in enumerate(classes)]
    place = [np.arange(len(m)) for m in classes]
    for a in range(PERIOD):
        for b in range(a + 1, PERIOD):
            if len(classes[a]) and len(classes[b]):
                p, q = key(classes[a], int(shift[a][b])), key(classes[b], int(shift[a][b]))
                place[a] = place[a] + np.searchsorted(q, p, "left")
                place[b] = place[b] + np.searchsorted(p, q, "right")
    merged = np.zeros(len(w), np.int64)
    merged[np.concatenate(place)] = np.concatenate(classes)
    # Neighbours that agree in their group and last words are compared in full.
    near = np.flatnonzero((group[merged][1:] == group[merged][:-1]) & (tail[merged][1:] == tail[merged][:-1]))
    u, v = w[merged[near]], w[merged[near + 1]]
    for k in range(PERIOD, length - 2 * PERIOD, PERIOD):
        same = word[u + k] == word[v + k]
        near, u, v = near[same], u[same], v[same]
    out[at[merged[near]]] = out[at[merged[near + 1]]] = True
    return out


def remove_repeats(docs: DataFrame, length: int = 200, limit: int = 2048, with_text: bool = False, block: int = 1 << 21) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for every row."""
    if not GRAM + 2 * PERIOD <= length < WINDOWS:
        raise ValueError(f"length must be {GRAM + 2 * PERIOD} to {WINDOWS - 1}")
    spread = max(1, min(SPREAD, (length - GRAM) // 2))
    text = F.coalesce("text", F.lit(""))
    # A document's key, and 32 bits more by which documents with one key are told apart.
    key, check = F.xxhash64(F.lit(1), text_id(), text).alias("key"), F.shiftrightunsigned(F.xxhash64(F.lit(2), text_id(), text), 32).alias("check")
    rows = docs.select(text_id(), text.alias("text"), key, check)

    def find(batches):
        """The distinct contexts of each document, and the places of those that it holds again: each as a bucket of its own
        that counts twice, so that it is settled like any repeat."""
        for batch in slices(batches):
            keys, checks, texts = batch["key"].to_numpy(), batch["check"].to_numpy(), [x.encode() for x in batch["text"]]
            for k, _, _, starts, roll, owner, place, first, last in anchors(texts, length):
                gram, context, fresh, again = contexts_of(roll, owner, place, first, last, length)
                near, at = (first - starts[owner]).astype(np.int32), k + owner
                shape = packed(checks[at], place - first, last - first, again)
                yield pd.DataFrame({"gram": gram.view(np.int64), "context": context.view(np.int64), "key": keys[at], "first": near, "shape": shape})[fresh]
                if again.any():
                    o, a, z = at[again], near[again], near[again] + (last - first)[again]
                    # Those that follow each other go together, as many windows at once as a shape can say.
                    new = np.concatenate([[True], (o[1:] != o[:-1]) | (a[1:] != z[:-1] + 1)])
                    part = (a - a[new][np.cumsum(new) - 1]) // (WINDOWS - length)
                    new[1:] |= part[1:] != part[:-1]
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(o)) - 1
                    o, a, more = o[begin], a[begin], z[end] - a[begin]
                    shape = packed(checks[o], np.zeros(len(o), np.int64), more, np.ones(len(o), bool))
                    with np.errstate(over="ignore"):
                        own = (keys[o].view(np.uint64) ^ (a.astype(np.uint64) + np.uint64(1)) * np.uint64(BASES[0])) * np.uint64(BASES[1])
                    yield pd.DataFrame({"gram": own.view(np.int64), "context": 0, "key": keys[o], "first": a, "shape": shape})

    found = rows.select("doc_id", "text", "key", "check").mapInPandas(find, "gram long, context long, key long, first int, shape long")
    times = (1 + F.col("shape").bitwiseAND(F.lit(1))).alias("n")
    common = found.groupBy("gram").agg(F.sum(times).alias("n")).where("n > 1").select("gram")
    marked = durable(found.join(common, "gram"))

    distinct = marked.groupBy("gram", "context").agg(F.sum(times).alias("n"), *[F.first(c).alias(c) for c in ("key", "first", "shape")])
    settled = marked.join(distinct.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    settled = settled.select("key", "first", "shape", F.lit(None).cast("long").alias("gram"), F.lit(False).alias("alone"), F.lit(False).alias("split"))
    sizes = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    chosen = distinct.join(sizes, "gram").select("key", "first", "shape", "gram", (F.col("n") == 1).alias("alone"), (F.col("m") > limit).alias("split"))
    marks = settled.union(chosen).groupBy("key").agg(F.collect_set(F.struct("first", "shape", "gram", "alone", "split")).alias("marks"))

    schema = "kind int, doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, key long, check long, gram long, first int, offset int, alone boolean, data binary, full binary"
    columns = [x.split()[0] for x in schema.split(", ")]

    def result(doc, raw: bytes, windows: np.ndarray) -> dict:
        kept, removed, spans = raw, 0, 0
        if windows.any():
            step = np.zeros(len(raw) + 1, np.int32)
            at = np.flatnonzero(windows)
            step[at] += 1
            step[at + length] -= 1
            gone = np.cumsum(step)[:-1] > 0
            removed, spans = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return {"kind": 0, "doc_id": doc, "n_bytes": len(raw), "n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None}

    def frame(out: list[dict]) -> pd.DataFrame:
        # Columns of objects, as a column without any value would else become one of floats.
        return pd.DataFrame({c: pd.Series([x.get(c) for x in out], dtype=object) for c in columns})

    def pieces_of(raw: bytes, key: int, check: int, first: int, most: int, more: int, mark) -> Iterator[dict]:
        """A context for its bucket; of a large bucket one piece for each range of offsets, in the bucket of its shared bytes."""
        one = {"kind": 1, "key": key, "check": check, "alone": mark["alone"]}
        if not mark["split"]:
            yield one | {"gram": mark["gram"], "first": first, "offset": most, "data": raw[first : first + more + length]}
            return
        anchor, least = first + most, most - more
        for lo in range(least // spread * spread, most + 1, spread):
            a, z = max(lo, least), min(lo + spread - 1, most)
            shared = hashlib.blake2b(raw[anchor - lo : anchor - lo - spread + 1 + length], digest_size=8, salt=lo.to_bytes(4, "little"))
            yield one | {"gram": int.from_bytes(shared.digest(), "little", signed=True), "first": anchor - z, "offset": z, "data": raw[anchor - z : anchor - a + length]}

    def first_pass(batches):
        """Documents without contexts to sort are settled (kind 0); the others wait (3), and the contexts go out (1)."""
        for batch in slices(batches):
            out, size = [], 0
            for doc, key, check, text, marks in zip(batch["doc_id"], batch["key"].tolist(), batch["check"].tolist(), batch["text"], batch["marks"], strict=True):
                raw, waits = text.encode(), False
                windows = np.zeros(max(0, len(raw) - length + 1), bool)
                for m in marks if marks is not None else ():
                    owner, most, more = unpacked(m["shape"])
                    if owner != check:
                        continue
                    if m["gram"] is None or not m["alone"]:
                        windows[m["first"] : m["first"] + more + 1] = True
                    if m["gram"] is not None:
                        waits |= m["alone"]
                        new = list(pieces_of(raw, key, check, m["first"], most, more, m))
                        out += new
                        size += sum(len(x["data"]) for x in new)
                if waits:
                    out.append({"kind": 3, "doc_id": doc, "key": key, "check": check, "data": raw, "full": np.packbits(windows).tobytes()})
                    size += len(raw)
                else:
                    out.append(result(doc, raw, windows))
                if size > 1 << 23:  # bounds what is built at once
                    yield frame(out)
                    out, size = [], 0
            yield frame(out)

    met = durable(rows.join(marks, "key", "left").select("doc_id", "key", "check", "text", "marks").mapInPandas(first_pass, schema), replaces=marked)

    def sort_buckets(batches):
        for table in whole_groups(batches, ["gram"]):
            # Blocks of whole buckets of about `block` bytes.
            starts = group_starts(table, ["gram"])
            size = np.add.reduceat(table["data"].map(len).to_numpy(), starts)
            begin = starts[np.flatnonzero(np.diff(np.cumsum(size) // block, prepend=-1))]
            for a, z in zip(begin, [*begin[1:], len(table)], strict=True):
                yield sort_block(table.iloc[a:z])

    def sort_block(part: pd.DataFrame) -> pd.DataFrame:
        size = part["data"].map(len).to_numpy()
        data = np.frombuffer(b"".join(part["data"]), np.uint8)
        start, room = np.cumsum(size) - size, size - length + 1
        context = np.repeat(np.arange(len(size)), room)
        inner = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        # The suffixes of a bucket share its bytes at one offset.
        bucket = dense(part["gram"].to_numpy())[context] * WINDOWS + part["offset"].to_numpy()[context] - inner
        hit = sorted_repeats(data, bucket, start[context] + inner, length)
        some = np.unique(context[hit & part["alone"].to_numpy()[context]])
        ends = np.cumsum(room)
        out = part[["key", "check", "first"]].iloc[some].reset_index(drop=True)
        out["n"] = room[some].astype(np.int32)
        out["bits"] = pd.Series([np.packbits(hit[ends[c] - room[c] : ends[c]]).tobytes() for c in some], dtype=object)
        return out

    contexts = met.where("kind = 1").select("gram", "key", "check", "first", "offset", "alone", "data")
    sorted_ = contexts.repartition("gram").sortWithinPartitions("gram").mapInPandas(sort_buckets, "key long, check long, first int, n int, bits binary")
    bits = sorted_.groupBy("key").agg(F.collect_set(F.struct("check", "first", "n", "bits")).alias("marks"))

    def second_pass(batches):
        for batch in slices(batches):
            out = []
            for doc, check, data, full, marks in zip(batch["doc_id"], batch["check"].tolist(), batch["data"], batch["full"], batch["marks"], strict=True):
                raw = bytes(data)
                windows = np.unpackbits(np.frombuffer(full, np.uint8))[: max(0, len(raw) - length + 1)].astype(bool)
                for m in marks if marks is not None else ():
                    if m["check"] == check:
                        windows[m["first"] : m["first"] + m["n"]] |= np.unpackbits(np.frombuffer(m["bits"], np.uint8))[: m["n"]].astype(bool)
                out.append(result(doc, raw, windows))
            yield frame(out)

    late = met.where("kind = 3").select("doc_id", "key", "check", "data", "full").join(bits, "key", "left").select("doc_id", "check", "data", "full", "marks").mapInPandas(second_pass, schema)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    return long_id(met.where("kind = 0").select(*names).union(late.select(*names)))
