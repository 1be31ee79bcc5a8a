"""Toxic spans and scores from a linear-chain conditional random field.

Tokens are runs of letters and digits, each lower-cased by itself, so that offsets hold in the text as it is. Token labels for training come from labelled documents: a word or prefix
that many toxic and hardly any clean documents hold marks its tokens in toxic documents as toxic; every other token is
clean. The field has two states, weights for words and prefixes, and transition weights, fitted by gradient
ascent on the conditional likelihood of short stretches of tokens. Forward-backward runs over whole texts; the token
marginals give the offending offsets, and their sum, maximum and mean go through a logistic curve fitted on documents.

Only the fit is bounded: by `per_class` documents of each label (the first by a hash of doc_id) with at most `longest`
characters, and by `stretches`. Executors cut these documents into tokens and send them compressed; the driver turns one at a
time into numbers. Scoring reads every whole text, one task per partition, without a shuffle.

Defined cases: null and empty texts have no tokens and get the curve's value for no evidence; null and repeated doc_ids are
scored row by row, and equal rows alike; null labels are not learned from, and a document with both labels counts as both;
without both labels in the training rows (so with empty tables too) every score is 0; columns other than doc_id, text and toxic
are not read, and `reject` passes columns of any name through; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import SLICE_ROWS, long_id, slices, text_id

TOKEN = re.compile(r"[^\W_]+")
#: Tokens of a block in the two-level forward-backward pass.
BLOCK = 64


def tokens_of(text: str) -> list[str]:
    low = text.lower()
    # Lower-casing never makes a text shorter, so one of equal length has each character in its place.
    return TOKEN.findall(low) if len(low) == len(text) else [t.lower() for t in TOKEN.findall(text)]


class Packed(Sequence):
    """Documents as compressed tokens, unpacked one at a time."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    @staticmethod
    def pack(text: str) -> bytes:
        return zlib.compress("\n".join(tokens_of(text)).encode(), 1)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> list[str]:
        whole = zlib.decompress(self.rows[k]).decode()
        return whole.split("\n") if whole else []


@lru_cache(20_000)
def features(token: str) -> list[str]:
    """The word itself and its first four, five and six characters."""
    return [f"w:{token}", *(f"p{k}:{token[:k]}" for k in (4, 5, 6) if len(token) > k)]


class Weights(dict):
    """Emission of the toxic state against the clean one by token; at most `remember` tokens are kept."""

    def __init__(self, by_feature: dict[str, float], bias: float, remember: int = 300_000):
        super().__init__()
        self.by_feature, self.bias, self.remember = by_feature, bias, remember

    def __missing__(self, token: str) -> float:
        if len(self) >= self.remember:
            self.clear()
        value = self[token] = self.bias + sum(self.by_feature.get(f, 0.0) for f in features(token))
        return value


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """P(toxic) of every token; adds the expected numbers of transitions to pairs (2 x 2), if given. emission: of all sequences, joined; lengths: of the sequences; transition: 2 x 2 log weights.

    Exact for any length: products of the step matrices over blocks, a pass over each sequence's blocks, then one within them.
    """
    out = np.zeros(len(emission))
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return out
    per = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    n = int(first[-1])
    token = np.arange(len(emission))
    begin = np.repeat(np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    place = np.repeat(first[:-1] * BLOCK, lengths) + token - begin
    toxic, real = np.zeros(n * BLOCK), np.zeros(n * BLOCK, bool)
    toxic[place], real[place] = np.clip(emission, -30, 30), True
    psi = np.exp(np.stack([-np.maximum(toxic, 0), np.minimum(toxic, 0)], -1)).reshape(n, BLOCK, 2)
    real = real.reshape(n, BLOCK)
    a = np.exp(transition - transition.max())
    product = np.tile(np.eye(2), (n, 1, 1))
    steps = range(min(BLOCK, int(lengths.max())))
    for t in steps:
        step = (product @ a) * psi[:, t, None, :]
        step /= step.sum((1, 2), keepdims=True)
        product = np.where(real[:, t, None, None], step, product)
    left, right = np.ones((n, 2)), np.ones((n, 2))
    for k in range(1, int(per.max())):
        at = first[:-1][per > k] + k
        x = np.einsum("ni,nij->nj", left[at - 1], product[at - 1])
        left[at] = x / x.sum(1, keepdims=True)
        at = first[1:][per > k] - k - 1
        x = np.einsum("nij,nj->ni", product[at + 1], right[at + 1])
        right[at] = x / x.sum(1, keepdims=True)
    forward, x = np.empty((n, BLOCK, 2)), left
    for t in steps:
        y = (x @ a) * psi[:, t]
        x = np.where(real[:, t, None], y / y.sum(1, keepdims=True), x)
        forward[:, t] = x
    p, x = np.zeros((n, BLOCK)), right
    for t in reversed(steps):
        both = forward[:, t] * x
        p[:, t] = both[:, 1] / both.sum(1)
        if pairs is not None:
            joint = (forward[:, t - 1] if t else left)[:, :, None] * a * (psi[:, t] * x)[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            inner = real[:, t].copy()
            if t == 0:
                inner[first[:-1]] = False
            pairs += joint[inner].sum(0)
        y = (psi[:, t] * x) @ a.T
        x = np.where(real[:, t, None], y / y.sum(1, keepdims=True), x)
    out[:] = p.reshape(-1)[place]
    return out


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: log of one plus the expected toxic tokens, the largest marginal, the mean marginal."""
    ends = np.cumsum(lengths)
    sums = np.diff(np.concatenate([[0.0], np.cumsum(p)])[np.concatenate([[0], ends])])
    top = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, (ends - lengths)[some])
    return np.stack([np.log1p(np.maximum(sums, 0)), top, sums / np.maximum(lengths, 1)], 1)


@dataclass
class Model:
    by_feature: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray | None = None  # weights of the evidence, then the intercept

    def score(self, texts: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, then the marginals of all tokens, joined, and the documents' numbers of tokens."""
        return self.score_tokens([tokens_of(x) for x in texts], weights)

    def score_tokens(self, tokens: list[list[str]], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in tokens], np.int64)
        p = marginals(np.fromiter((weights[t] for x in tokens for t in x), float, int(lengths.sum())), lengths, self.transition)
        if self.curve is None:
            return np.zeros(len(tokens)), p, lengths
        z = evidence(p, lengths) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p, lengths


def _numbered(documents: Sequence[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """The tokens of each document as numbers into the list of distinct tokens, which keeps the driver's memory small."""
    known: dict[str, int] = {}
    return [np.fromiter((known.setdefault(t, len(known)) for t in x), np.int32) for x in documents], list(known)


def _markers(tokens: list[np.ndarray], words: list[str], toxic: np.ndarray, least: int, gain: int, odds: float) -> set[str]:
    """The fewest words and prefixes that explain the toxic documents, greedily.

    Candidates are held by at least `least` toxic documents, and there `odds` times as often as in clean ones; each one taken
    explains at least `gain` documents that those before it do not. So rare words that copies of a document share stay out.
    """
    seen, clean = Counter(), Counter()
    for d in np.flatnonzero(toxic):
        seen.update({f for t in np.unique(tokens[d]) for f in features(words[t])})
    able = {f for f, n in seen.items() if n >= least}
    for d in np.flatnonzero(toxic == 0):
        clean.update({f for t in np.unique(tokens[d]) for f in features(words[t]) if f in able})
    n1, n0 = toxic.sum() + 1, len(toxic) - toxic.sum() + 1
    able = {f for f in able if seen[f] / n1 >= odds * (clean[f] + 0.5) / n0}
    holders: dict[str, set[int]] = {f: set() for f in able}
    for d in np.flatnonzero(toxic):
        for f in {f for t in np.unique(tokens[d]) for f in features(words[t]) if f in able}:
            holders[f].add(int(d))
    taken: set[str] = set()
    left = set(map(int, np.flatnonzero(toxic)))
    while holders:
        best = max(holders, key=lambda f: (len(holders[f] & left) - 10 * clean[f], len(holders[f]), f))
        if len(holders[best] & left) < gain:
            return taken
        left -= holders.pop(best)
        taken.add(best)
    return taken


def fit(documents: Sequence[list[str]], toxic: np.ndarray, stretches: int = 4000, width: int = 32, rounds: int = 40, share: float = 0.005, seed: int = 7) -> Model:
    """Fits the field and the document curve to documents as lists of tokens. Deterministic for the same rows in the same order."""
    toxic = np.asarray(toxic, int)
    if toxic.min(initial=1) == toxic.max(initial=0) or not len(toxic):
        return Model()
    random = np.random.default_rng(seed)
    tokens, words = _numbered(documents)
    marks = _markers(tokens, words, toxic, max(3, int(share * toxic.sum())), max(1, int(0.001 * toxic.sum())), 20.0)
    marked = np.array([not marks.isdisjoint(features(t)) for t in words], bool)
    labelled = [marked[x] if y else np.zeros(len(x), bool) for x, y in zip(tokens, toxic, strict=True)]
    pieces: list[tuple[int, int]] = []
    for d in random.permutation(len(tokens)):
        if len(pieces) >= stretches or not len(tokens[d]):
            continue
        hits = np.flatnonzero(labelled[d])
        starts = {max(0, int(h) - int(random.integers(width))) for h in hits[:: max(1, len(hits) // 3)]} if len(hits) else set()
        if not toxic[d]:
            starts |= {int(random.integers(max(1, len(tokens[d]) - width))) for _ in range(3)}
        pieces += [(d, s) for s in sorted(starts)]
    xs = [[words[t] for t in tokens[d][s : s + width]] for d, s in pieces]
    lengths = np.array([len(x) for x in xs])
    y = np.concatenate([labelled[d][s : s + width] for d, s in pieces]) if pieces else np.zeros(0, bool)
    del tokens, words, labelled
    names: dict[str, int] = {}
    counts = Counter(f for x in xs for t in x for f in features(t))
    rows, cols = [], []
    at = 0
    for x in xs:
        for t in x:
            for f in features(t):
                if counts[f] >= 3:
                    rows.append(at)
                    cols.append(names.setdefault(f, len(names)))
            at += 1
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    w, bias, trans = np.zeros(len(names)), -2.0, np.zeros((2, 2))
    g2, b2, t2 = np.full(len(names), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    inner = np.ones(len(y), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    state = y.astype(int)
    observed = np.bincount(state[inner - 1] * 2 + state[inner], minlength=4).reshape(2, 2)
    for _ in range(rounds):
        e = bias + np.bincount(rows, w[cols], len(y))
        expected = np.zeros((2, 2))
        p = marginals(e, lengths, trans, expected)
        gap = y - p
        grad, gb, gt = np.bincount(cols, gap[rows], len(names)) - 0.1 * w, gap.sum(), observed - expected - 1.0 * trans
        g2, b2, t2 = g2 + grad**2, b2 + gb**2, t2 + gt**2
        w, bias, trans = w + 0.5 * grad / np.sqrt(g2), bias + 0.5 * gb / np.sqrt(b2), trans + 0.1 * gt / np.sqrt(t2)
    model = Model({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 0.02}, float(bias), trans)
    weights = Weights(model.by_feature, model.bias)
    parts = []
    for k in range(0, len(documents), 256):
        model.curve = np.zeros(4)
        _, p, n = model.score_tokens([documents[d] for d in range(k, min(k + 256, len(documents)))], weights)
        parts.append(evidence(p, n))
    x = np.concatenate(parts)
    x1, curve = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(4)
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    for _ in range(40):  # Newton steps on the penalised likelihood
        q = 1 / (1 + np.exp(-np.clip(x1 @ curve, -30, 30)))
        h = (x1 * (weight * q * (1 - q))[:, None]).T @ x1 + np.diag([0.1, 0.1, 0.1, 1e-6])
        curve = curve + np.clip(np.linalg.solve(h, x1.T @ (weight * (toxic - q)) - np.array([0.1, 0.1, 0.1, 0]) * curve), -3, 3)
    model.curve = curve
    return model


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 200_000) -> Model:
    """Fits on at most per_class training documents of each label, the first by a hash of doc_id, none of them held out.

    The sample goes to the driver: the tokens of 2 x per_class texts of at most `longest` characters, compressed, whatever the
    size of the tables.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(per_class).union(known.where("toxic = 0").orderBy(*order).limit(per_class))

    def pack(batches):
        for batch in slices(batches):
            yield batch[["doc_id", "toxic"]].assign(tokens=[Packed.pack(x) for x in batch["text"]])

    sample = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").select(text_id(), "toxic", "text")
    rows = sample.mapInPandas(pack, "doc_id string, toxic int, tokens binary").collect()
    rows.sort(key=lambda r: (int(r["doc_id"]), r["toxic"], r["tokens"]))
    return fit(Packed([bytes(r["tokens"]) for r in rows]), np.array([r["toxic"] for r in rows], int))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, span_at: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, spans (array of start and end in code points, end exclusive) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = Weights(model.by_feature, model.bias)
        for batch in slices(batches):
            texts = [x or "" for x in batch["text"]]
            s, p, lengths = model.score(texts, weights)
            spans, at = [], 0
            for text, n in zip(texts, lengths, strict=True):
                hits = np.flatnonzero(p[at : at + n] >= span_at)
                found = []
                if len(hits):
                    wanted = set(hits.tolist())
                    low = text.lower()
                    places = [m.span() for m in TOKEN.finditer(low if len(low) == len(text) else text)]
                    found = [{"start": a, "end": b} for k, (a, b) in enumerate(places) if k in wanted]
                spans.append(found)
                at += n
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": s, "predicted": (s >= threshold).astype("int32"), "spans": spans})

    return long_id(docs.select(text_id(), "text").mapInPandas(run, "doc_id string, score double, predicted int, spans array<struct<start:int,end:int>>"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""

    def run(batches):
        import pyarrow as pa

        weights = Weights(model.by_feature, model.bias)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(k, SLICE_ROWS)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(model.score(texts, weights)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
