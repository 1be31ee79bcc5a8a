"""Parts of the corpus operators that need no Spark, against brute force."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rivulet.llm import embeddings, media, minhash, packing, pii, substring, suffix, toxicity
from rivulet.llm.tokens import Ids

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_marginals_by_enumeration():
    r = np.random.default_rng(0)
    for n in (1, 2, 6):
        e, t = 2 * r.normal(size=n), r.normal(size=(2, 2))
        total, hits, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[k] * s[k] for k in range(n)) + sum(t[s[k - 1], s[k]] for k in range(1, n))) * np.exp(t[:, s[0]]).sum()
            total += w
            hits += w * np.array(s)
            for k in range(1, n):
                pairs[s[k - 1], s[k]] += w
        got = np.zeros((2, 2))
        assert np.allclose(toxicity.marginals(e, np.array([n]), t, got), hits / total) and np.allclose(got, pairs / total)


def test_marginals_over_blocks_and_empty_sequences():
    r = np.random.default_rng(1)
    e, t = r.normal(size=500), r.normal(size=(2, 2))
    alone = np.concatenate([toxicity.marginals(e[:301], np.array([301]), t), toxicity.marginals(e[301:], np.array([199]), t)])
    assert np.allclose(toxicity.marginals(e, np.array([0, 301, 0, 199]), t), alone)
    assert len(toxicity.marginals(np.zeros(0), np.zeros(0, int), t)) == 0


def test_fit_without_both_labels():
    assert toxicity.fit([["a", "b"]], np.array([1])).score(["x", ""], toxicity.Weights({}, 0.0))[0].tolist() == [0, 0]
    assert toxicity.fit([], np.array([], int)).curve is None


def test_fit_separates():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda bad: " ".join(r.choice(words) if not bad or r.random() > 0.2 else r.choice(["vilest", "rotten"]) for _ in range(40))
    y = np.array([k % 3 == 0 for k in range(300)], int)
    model = toxicity.fit([toxicity.tokens_of(text(v)) for v in y], y)
    s, _, _ = model.score([text(v) for v in y], toxicity.Weights(model.by_feature, model.bias))
    assert ((s >= 0.7) == y).mean() > 0.97


@pytest.mark.parametrize("text", ["", " \n\t", "It's don't WE'LL 3² ½x", "<|endoftext|> a", "ΑΣ ΑΣ. İx 漢字", "é é\x85x\xa0y_z", "a" * 3000 + " !!!" * 40, "l'été l'Été"])
def test_ids_are_the_tokenizers(text):
    t = Tokenizer.from_file(FILE)
    ids = Ids(FILE, remember=5)
    for _ in range(2):
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def best_sum(counts, room):
    reach = {0}
    for k, n in counts.items():
        for _ in range(n):
            reach |= {x + k for x in reach if x + k <= room}
    return max(reach)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 4), max_size=8), st.integers(0, 60))
def test_fill_is_optimal(counts, room):
    chosen = packing.fill(counts, room)
    assert all(n <= counts[k] for k, n in chosen.items()) and sum(k * n for k, n in chosen.items()) == best_sum(counts, room)


@pytest.mark.parametrize("pool", [2, 16, 1000])
def test_packer_places_every_id_once(pool):
    r = random.Random(5)
    docs = {k: np.arange(n, dtype="<u4").tobytes() for k, n in enumerate([1, 64, 128, 63, 200] + [r.randint(1, 150) for _ in range(200)])}
    p = packing.Packer(64, pool, 9)
    rows = [x for k, d in docs.items() for x in p.add(k, d)] + list(p.end())
    placed, windows = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, tokens, seq, offset, ids in rows:
        placed[doc].append((start, n))
        windows[seq].append((offset, n))
        assert crc == zlib.crc32(docs[doc][4 * start : 4 * (start + n)]) and tokens == len(docs[doc]) // 4 and n * 4 == len(ids)
    for d in docs:
        at = 0
        for start, n in sorted(placed[d]):
            assert start == at and n > 0
            at += n
        assert at == len(docs[d]) // 4
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(sum(n for _, n in w) < 64 for w in windows.values()) <= 1


@pytest.mark.parametrize("n", [192, 192 * 16, 192 * 17, 192 * 65])
def test_media_round_trip(n):
    data = os.urandom(n)
    stored = media.write(data)
    info = media.inspect(stored)
    assert info["codec"] == "raw " and info["n_samples"] == n // 192 and media.payload_of(stored, info) == data
    at, size = info["key_offsets"][-1], info["key_sizes"][-1]
    assert stored[at : at + size] == data[(len(info["key_offsets"]) - 1) * 64 * 192 :][:192]


def test_broken_media():
    good = media.write(b"x" * 192)
    for bad in (b"", b"\0" * 7, good[:-1], good[:100], good.replace(b"stts", b"xxxx"), good.replace(b"co64", b"stsz").replace(b"stco", b"xxxx"), os.urandom(400)):
        assert media.inspect(bad)["error"]


def test_difference_cover():
    shift = suffix.cover_shift()
    assert all((a + shift[a][b]) % 7 in (0, 1, 3) and (b + shift[a][b]) % 7 in (0, 1, 3) for a in range(7) for b in range(7))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=60, max_size=400), st.integers(21, 40), st.integers(1, 3), st.booleans())
def test_sorted_repeats_by_brute_force(letters, length, buckets, periodic):
    data = np.array(letters * 2 if periodic else letters, np.uint8)
    window = np.arange(len(data) - length + 1)
    bucket = window % buckets
    n = Counter((b, data[w : w + length].tobytes()) for b, w in zip(bucket, window, strict=True))
    assert suffix.sorted_repeats(data, bucket, window, length).tolist() == [n[b, data[w : w + length].tobytes()] > 1 for b, w in zip(bucket, window, strict=True)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=30, max_size=300), st.sampled_from([7, 14, 28, 56, 70, 189]))
def test_cover_ranks_are_lexicographic(letters, depth):
    data = np.array(letters, np.uint8)
    rank = suffix.cover_ranks(suffix.words(data), depth)
    place = np.array([p for p in range(len(data)) if p % 7 in (0, 1, 3)])
    text = [bytes(data[p : p + depth]).ljust(depth, b"\0") for p in place]
    whole = [k for k, p in enumerate(place) if p + depth <= len(data)]  # beyond the end ranks tell zeros from nothing
    got = rank[suffix.sample_number(place)]
    for i in whole:
        for j in whole:
            assert (got[i] < got[j]) == (text[i] < text[j]) and (got[i] == got[j]) == (text[i] == text[j])


def test_sliding_argmin():
    r = np.random.default_rng(2)
    key = r.integers(0, 9, 200).astype(np.uint64)
    assert suffix.sliding_argmin(key, 7).tolist() == [k + int(np.argmin(key[k : k + 7])) for k in range(194)]


def test_least_matches_bounds_the_miss():
    least = minhash.least_matches(160, 0.8, 1e-4)
    assert list(least) == sorted(least) and least[-1] < 0.8 * 160
    assert minhash.least_matches(160, 0.8, 1e-2)[-1] > least[-1]


def test_survivors():
    a = np.zeros((3, 160), "<u2")
    b = a.copy()
    b[1, :100] = 1
    assert minhash.survivors(a, b, minhash.least_matches(160, 0.8, 1e-4)).tolist() == [0, 2]
    assert minhash.survivors(a[:0], b[:0], minhash.least_matches(160, 0.8, 1e-4)).tolist() == []


def test_pruning_and_bands_miss_next_to_nothing():
    """Pairs at the threshold itself: how many share a band, and how many outlast the pruning."""
    r, shared, kept, n = np.random.default_rng(1), 0, 0, 400
    least = minhash.least_matches(192, 0.8, 1e-4)
    for _ in range(n):
        both, a, b = (r.integers(0, 1 << 63, k, dtype=np.uint64) for k in (160, 20, 20))  # 160 of 200 in common
        x, y = (np.frombuffer(minhash.signature(np.unique(np.concatenate([both, c])), 192), "<u2")[None] for c in (a, b))
        shared += (x.reshape(32, 6) == y.reshape(32, 6)).all(1).any()
        kept += len(minhash.survivors(x, y, least)) == 1
    assert shared >= 0.99 * n and kept >= 0.99 * n


def test_shingles():
    w = minhash.Words()
    assert len(w.shingles(None, 4)) == len(w.shingles(" \n", 4)) == 0
    assert len(w.shingles("a b", 4)) == 1 and len(w.shingles("a b c d e", 4)) == 2
    assert w.shingles("A b\x0bc", 4).tolist() == w.shingles("a  b c", 4).tolist()
    assert w.shingles("É b", 4).tolist() != w.shingles("é b", 4).tolist()


def test_hadamard_and_codes():
    h = embeddings.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    x = np.random.default_rng(4).normal(size=(50, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embeddings.codes(x, (16, 16), 3, 4)
    assert c.shape == (50, 3, 5) and all(len(set(row)) == 5 for v in c for row in v)


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_codes_of_short_vectors(dim):
    x = np.random.default_rng(4).normal(size=(30, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    widths = embeddings.part_widths(dim, 100)
    c = embeddings.codes(x, widths, 2, 3)
    assert c.shape == (30, 2, 4) and (c[:, :, 0] >= 0).all() and embeddings.tables_for(dim, widths, 3, 0.95, 0.99) >= 1


def test_meetings_do_not_grow_and_recall():
    met = {}
    for n in (2_000, 10_000, 50_000):
        r = np.random.default_rng(n)
        x = r.normal(size=(n, 64))
        y = r.normal(size=(300, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x[:300] * y).sum(1, keepdims=True) * x[:300]
        y = 0.95 * x[:300] + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        widths = embeddings.parts_for(64, n, 4)
        tables = embeddings.tables_for(64, widths, 3, 0.95, 0.99)
        a, b = embeddings.codes(x, widths, tables, 3), embeddings.codes(y, widths, tables, 3)
        assert ((a[:300, :, :1] == b).any(2) | (b[:, :, :1] == a[:300]).any(2)).any(1).mean() >= 0.95
        pairs = 0
        for t in range(tables):
            own = Counter(a[:, t, 0].tolist())
            pairs += sum(own[k] * m for k, m in Counter(a[:, t].ravel().tolist()).items()) - n
        met[n] = pairs / n
    # Widths are powers of two, so the number of buckets is up to twice what was asked for.
    assert max(met.values()) < 12 and max(met.values()) < 2 * min(met.values()), met


def test_runs_of_sentences():
    text = "One two three four five six. Seven eight nine ten eleven. Twelve thirteen is late.\nEnd here."
    assert "".join(text[a:b] for a, b in zip([0, *substring.pieces(text)], substring.pieces(text), strict=False)) == text
    a = substring.runs(text, 2, 30)[0]
    b = substring.runs("Something else first. " + text.upper(), 2, 30)[0]
    assert set(a.tolist()) <= set(b.tolist())
    assert len(substring.runs("", 2, 30)[0]) == 0


def test_pii_model_on_fresh_phrases():
    model = pii.fit()
    right = wrong = 0
    for k, t, b, a, y in pii.phrases(500, 77):
        row = {n: float(f[1](pii.KINDS.index(k), t, b, a)) for n, f in pii.FEATURES.items()}
        said = model.margin(row) >= model.thresholds[k]
        right += said and y
        wrong += said and not y
    assert right > 200 and wrong < 0.05 * right


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(v) > 255 for v in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out
