"""Exact repeats of runs of sentences: every run is hashed, runs are joined globally, later copies are removed.

A text is cut after sentence ends and line ends. Between these it is cut after words chosen by their hashes (the smallest one
of every 9 words in a row; two characters of a script without spaces count as a word), so cuts depend on at most 8 words to
either side and no piece has more than 9 words: of 50 words in a row that two texts share, at least 17 words in two or more
whole pieces are cut alike, wherever they stand.
A run starts or ends at each piece and takes at least `least` pieces and `chars` characters; a text that is too short for
one is a run as a whole. Runs are compared in lower case without surrounding white space, by 64-bit hashes. The first
document of a run is the one with the smallest doc_id; in every other one the run's pieces are removed, and within a document
every later copy of a run is removed.

Scale: a run is a row of a hash and two ids. First documents come from a map-side combined minimum, so a passage
that a third of all documents hold is one row of each map task; its removal is a join, whose hot side AQE splits.

Defined cases: null and empty texts have no pieces and stay; a null doc_id is never first and only loses its own repeats;
rows that share a doc_id count as one document; repeated rows get equal results; other columns are not read; an empty table gives
no rows; texts are searched whole.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import durable, long_id, slices, text_id

#: Letters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana and ideographs.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Kinds of characters, as bits: white space, letters and digits, those without spaces, sentence marks, full-width marks and line ends.
SPACE, WORD, ALONE, STOP, END = 1, 2, 4, 8, 16
PATTERNS = {SPACE: r"\s", WORD: r"\w", ALONE: rf"(?=\w)[{SPACELESS}]", STOP: r"[.!?]", END: r"[\n\u3002\uff01\uff1f\uff1b\uff0e\uff61]"}
#: Words in a row of which the one with the smallest hash is cut after, if none of them ends a sentence or line.
WORDS = 9
BASE = 0x9E3779B97F4A7C15
POWERS = [np.zeros(0, np.uint64)] * 2


@cache
def _kinds() -> np.ndarray:
    """The kind of each character."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for bit, pattern in PATTERNS.items():
        for m in re.finditer(f"(?:{pattern})+", every):
            out[m.start() : m.end()] |= bit
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n at least."""
    if len(POWERS[0]) <= n:
        for k, x in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            POWERS[k] = np.multiply.accumulate(np.array([1] + 2 * n * [x], np.uint64))
    return POWERS[0], POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _spans(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of x[a:b] for each a and b."""
    powers, inverse = _powers(len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers[: len(x)], out=total[1:])
    return _mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def _cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's units (a word, or a letter without spaces, with what follows it): first character, end without white space
    and end; hash with white space (without it where the text is cut after the unit), and whether it is."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join([x if len(x) == 1 else y for y in text for x in [y.lower()]])
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, at = _kinds()[code], np.arange(len(code))
    space, word, alone = (kind & SPACE) > 0, (kind & WORD) > 0, (kind & ALONE) > 0
    begins = ~space
    begins[1:] &= space[:-1] | alone[1:] | (word[1:] & ((kind[:-1] & (ALONE | END)) > 0))
    start = np.flatnonzero(begins)
    if not len(start):
        return (start,) * 5
    end = np.append(start[1:], len(code))
    last = lambda mask: np.maximum.accumulate(np.where(mask, at, -1))[end - 1]
    bare = last(~space) + 1
    closed = (last((kind & STOP) > 0) > np.maximum(last(word), start - 1)) & (bare < end)
    closed |= last((kind & END) > 0) >= start
    letters = _mixed(code.astype(np.uint64) + np.uint64(1))
    full = _spans(letters, np.concatenate([start, start]), np.concatenate([end, bare]))
    full, short = full[: len(start)], full[len(start) :]
    rank, chosen = np.where(closed, 0, (full >> np.uint64(2)).astype(np.int64) + 1), closed
    chosen[-1] = True
    row, unit, width = rank, None, WORDS
    single = alone[start]
    if single.any():
        # A word takes two places, of which the second is never the smallest.
        place = np.cumsum(2 - single)
        row, unit, width = np.full(place[-1], np.iinfo(np.int64).max), np.zeros(place[-1], np.int64), 2 * WORDS
        row[place - 2 + single], unit[place - 2 + single] = rank, np.arange(len(rank))
    if len(row) >= width:
        least = np.lib.stride_tricks.sliding_window_view(row, width).argmin(axis=1) + np.arange(len(row) - width + 1)
        chosen[least if unit is None else unit[least]] = True
    return start, bare, end, np.where(chosen, short, full), chosen


def pieces(text: str) -> np.ndarray:
    """Ends of the pieces, which together are the whole text."""
    _, _, end, _, chosen = _cut(text)
    return end[chosen] if len(end) else np.array([len(text)] * bool(text), np.int64)


def runs(text: str, least: int, chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first piece and last piece (exclusive) of each run, and the ends of the pieces."""
    start, bare, end, h, chosen = _cut(text)
    if not len(start):
        return start, start, start, pieces(text)
    cut = np.concatenate([[0], np.flatnonzero(chosen) + 1])
    n = len(cut) - 1
    # White space counts within a piece, not around it.
    size = np.concatenate([[0], np.cumsum(bare[cut[1:] - 1] - start[cut[:-1]])])
    at = np.arange(n + 1)
    # The shortest run from each piece on, and the shortest one up to each piece.
    last, first = np.maximum(at + least, np.searchsorted(size, size + chars)), np.minimum(at - least, np.searchsorted(size, size - chars, "right") - 1)
    pairs = np.sort(np.concatenate([(at * (n + 1) + last)[last <= n], (first * (n + 1) + at)[(first >= 0) & (last[first] != at)]]))
    first, last = pairs // (n + 1), pairs % (n + 1)
    if not len(pairs):
        first, last = np.array([0]), np.array([n])
    return _spans(h, cut[first], cut[last]).view(np.int64), first, last, end[chosen]


def remove_repeats(docs: DataFrame, least: int = 2, chars: int = 60) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed_chars, text (what is left) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hashed(batches):
        for batch in slices(batches):
            keys = [np.unique(runs(text or "", least, chars)[0]) for text in batch["text"]]
            yield pd.DataFrame({"hash": np.concatenate(keys), "doc_id": np.repeat(batch["doc_id"].to_numpy(), list(map(len, keys)))})

    # Written once, as both the first documents and the hits are found from it.
    spans = durable(rows.where("doc_id is not null").mapInPandas(hashed, "hash long, doc_id long"))
    origin = spans.groupBy("hash").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("other")).where("origin < other").select("hash", "origin")
    hits = spans.join(origin, "hash").where("doc_id > origin").groupBy("doc_id").agg(F.collect_list("hash").alias("hits"))

    def cut(batches):
        for batch in slices(batches):
            out = []
            for text, hits in zip(batch["text"], batch["hits"], strict=True):
                key, first, last, ends = runs(text or "", least, chars)
                away = np.ones(len(key), bool)
                away[np.unique(key, return_index=True)[1]] = False
                if hits is not None:
                    away |= np.isin(key, hits)
                gone = np.bincount(first[away], minlength=len(ends) + 1) - np.bincount(last[away], minlength=len(ends) + 1)
                lost = np.cumsum(gone)[:-1] > 0
                if lost.any():
                    bounds = [0, *ends.tolist()]
                    kept = "".join([text[a:b] for a, b, x in zip(bounds, bounds[1:], lost, strict=False) if not x])
                else:
                    kept = text
                out.append((len(ends), int(lost.sum()), len(text or "") - len(kept or ""), kept))
            frame = pd.DataFrame(out, columns=["n_sentences", "n_removed", "removed_chars", "text"], index=batch.index)
            frame.insert(0, "doc_id", batch["doc_id"])
            yield frame

    met = rows.join(hits, "doc_id", "left").select(text_id(), "text", "hits")
    return long_id(met.mapInPandas(cut, "doc_id string, n_sentences long, n_removed long, removed_chars long, text string"))
