"""Corpus operators on small tables with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import chat, components, embeddings, media, minhash, mixing, packing, pii, queries, substring, suffix, toxicity
from rivulet.llm.oracle import ORACLE
from tests.llm.test_local import FILE, base_spans

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
TEXTS = ["one two three four five six seven", "one two three four five six seven", None, "", " \n", "a", LONG, "mail bob@example.org or 10.0.0.1 now", "one two three four five six seven"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ["a", "a", None, "b"][k % 4], k, "x", 1) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "a", 0, "x", 1), (None, "lost row here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string, node int")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in ORACLE])
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in expected)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (7, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.reject(docs, model, 2.0).columns == docs.columns and toxicity.reject(docs, model, 2.0).count() == docs.count()


def test_toxicity_held_out_accuracy(spark, data):
    got = queries.op1_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.85


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi %25 <|im_start|> </s>[INST]"), (1, 1, "assistant", "a<|im_end|>\n"), (2, 0, "assistant", "x"), (3, 0, "user", None), (3, 1, None, "z"), (4, 0, "user", "q"), (4, 0, "user", "q"),
        (5, 0, "odd\nrole", "%0A"), (None, None, "user", "n"), (6, 0, "system", ""), (6, 1, "user", "u"), (6, 2, "assistant", ""), *[(7, k, ["user", "assistant"][k % 2], f"t{k}") for k in range(301)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    for c, r in got.items():
        expected = [(role or "", text or "") for cid, turn, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in r.turns] == expected and r.n_turns == len(expected)
        assert [r.formatted[s.start : s.start + s.length] for s in r.segments if s.loss] == [F_escape(t) for role, t in expected if role == "assistant"]
    assert [got[c].valid for c in (1, 2, 4, 5, 6, 7)] == [True, False, False, False, True, True]
    assert [got[c].first_bad for c in (1, 2, 4, 5)] == [None, 0, 1, 0]
    assert chat.format_chats(df.where("false")).count() == 0


def F_escape(text):
    for c in ("%", *chat.Template().controls):
        text = text.replace(c, "%25" if c == "%" else f"%{ord(c[0]):02X}{c[1:]}")
    return text


def test_mixing_deviation(spark):
    rows = [(k, "aaaabbbccd"[k % 10]) for k in range(4000)] + [(None, None), (5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 4, 100, 2).select("doc.*", "block", "slot", "offset").collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert all(n <= 4 for n in Counter(r.slot for r in got).values())
    weights = {"a": 50, "b": 30, "c": 15, "d": 5, None: 1}
    total, last = sum(weights.values()), {}
    for t, (s, _) in slots.items():
        last[s] = max(last.get(s, 0), t)
    given = Counter()
    for t in range(min(last["a"], last["b"], last["c"], last["d"]) + 1):
        if t in slots:
            given[slots[t][0]] += 1
        for s, w in weights.items():
            if t <= last[s]:
                assert abs(given[s] - (t + 1) * w / total) < 1
    assert mixing.mix(df.where("false")).count() == 0


def test_media_and_packing_edges(spark, docs):
    got = media.text_media(docs, with_media=True).collect()
    assert len(got) == docs.count()
    for r, t in [(r, t) for r in got for t in [dict(enumerate(TEXTS)).get(r.doc_id)] if r.doc_id is not None]:
        raw = (t or "").encode()
        stored = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.media_sha256) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), hashlib.sha256(bytes(r.media)).hexdigest())
    shown = media.media_columns(media.text_media(docs, True).select("doc_id", "media"), "media", "doc_id").collect()
    assert all(r.codec == "raw " and r.error is None for r in shown)
    pieces = packing.pack(docs, FILE, 64).collect()
    assert sum(r.length for r in pieces) == sum(n for _, n in {(r.doc_id, r.doc_tokens) for r in pieces if r.doc_id != 0}) + 2 * next(r.doc_tokens for r in pieces if r.doc_id == 0)
    assert packing.pack(docs.where("false"), FILE).count() == media.text_media(docs.where("false")).count() == 0


def test_pii_edges(spark, docs):
    tricky = ["a@b.c@d.e_x@q.r", "1.2.3.4.5.6.7.8 300.1.1.1 00255.0.0.01", "4111 1111 1111 1111", "+49 (0) 30 12345-678+1 2", "😀 x@y.zz", "1" * 4000 + "@" + "a" * 4000, "+1" + "(" * 9000, "5 " * 2500, "12 a " * 2500, "call me at 555-123-4567 ok"]
    df = docs.unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string"), allowMissingColumns=True)
    for r in pii.detect(df).collect():
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] == base_spans(r.doc.text or "")
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[7] == "mail [EMAIL] or [IP] now" and clean[104] == "😀 [EMAIL]" and clean[2] is None and clean[109] == "call me at [TEL] ok"
    assert pii.redact(df).columns == df.columns and pii.redact(df.where("false")).count() == 0


def test_pii_is_linear_in_long_texts(spark):
    import time

    one = "call me at 555-123-4567 or +1 (555) 123-4567 x, mail bob@example.org, host 10.0.0.1, ssn 123-45-6789; "
    text = one * (1_000_000 // len(one))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.redact(spark.createDataFrame([(0, one)], df.schema)).collect()
    began = time.perf_counter()
    (row,) = pii.redact(df).collect()
    assert time.perf_counter() - began < 60
    assert row.text == "call me at [TEL] or [PHONE] x, mail [EMAIL], host [IP], ssn [SSN]; " * (len(text) // len(one))
    (found,) = pii.detect(df).collect()
    assert [(pii.KINDS[s.kind], s.start, s.end) for s in found.base] == base_spans(text)


def near(a, b, k):
    sets = []
    for t in (a, b):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    return bool(sets[0] and sets[1]) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def closure(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_minhash_by_brute_force(spark, docs):
    r = np.random.default_rng(6)
    made = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in r.integers(0, 500, 120)]
        for _ in range(7):
            copy = list(words)
            for k in r.integers(0, 120, r.integers(0, 7)):
                copy[k] = f"e{r.integers(0, 10**6)}"
            made.append(" ".join(copy))
    df = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(made)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows = {d: t for d, t in df.collect()}
    ids = sorted(i for i in rows if i is not None)
    expected = closure(ids, [(a, b) for a in ids for b in ids if a < b and near(rows[a], rows[b], 4)])
    got = minhash.near_duplicates(df, k=4, block=3).collect()
    assert len(got) == df.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)
    kept = minhash.keep_first(df, k=4)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i in ids if expected[i] == i)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 100}


def test_embeddings_by_brute_force(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(12, 16))
    x = [b + 0.12 * r.normal(size=16) for b in base for _ in range(8)] + [base[0]] * 5
    rows = [(k, [float(v) for v in y]) for k, y in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0] * 3), (905, [1.0] * 3), (906, []), (None, [1.0] * 16), (907, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near_ = unit @ unit.T >= 0.95
    expected = closure(range(len(x)), [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if near_[a, b]])
    for block in (5, 2048):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
        assert {k: got[k].component_id for k in range(len(x))} == expected
        assert {k: got[k].n_links for k in range(len(x))} == {k: int(near_[k].sum()) - 1 for k in range(len(x))}
        assert [got[k].n_links for k in (900, 901, 902, 903, 904, 906, 907)] == [0, 0, 0, 0, 1, 0, 0] and got[905].component_id == 904 and got[None].kept
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_substring(spark, docs):
    passage = "The first thing is told here at some length. Then comes a second one, as long. A third follows and ends it all."
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(50, "Alpha beta gamma. " + passage + " Tail one."), (51, "Other start here. " + passage + " Tail two."), (52, passage + " " + passage), (None, passage)], "doc_id long, text string"))
    got = defaultdict(list)
    for r in substring.remove_repeats(df).collect():
        got[r.doc_id].append(r)
    assert got[50][0].n_removed == 0 and got[51][0].text == "Other start here. Tail two." and got[52][0].text == "" and len(got[None]) == 2
    assert got[2][0].text is None and got[3][0].text == "" and sum(map(len, got.values())) == df.count()
    assert substring.remove_repeats(df.where("false")).count() == 0


@pytest.mark.parametrize(("length", "limit"), [(64, 2048), (100, 2048), (64, 2), (100, 1)])
def test_suffix_by_brute_force(spark, docs, length, limit):
    shared = "".join(chr(97 + (k * k + 3 * k) % 26) for k in range(190))
    extra = ["x" * 200, "ab" * 90, f"start {shared} end", f"other {shared[5:]} words", f"{shared} é {shared}", f"tail {shared[:120]}!", ("xyz" * 60 + "q") * 3, "é" * 90, *[f"{k} {shared[k : 150 + k]} {k * k}" for k in range(12)]]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(200 + k, t) for k, t in enumerate(extra)]
    count = Counter(b[s : s + length] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - length + 1))
    expected = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        expected.append((str(d), len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix.remove_repeats(df, length, limit, block=1000)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted(expected)
    assert suffix.remove_repeats(df.where("false"), length).count() == 0


def test_suffix_without_any_context(spark):
    df = spark.createDataFrame([(1, "nothing repeats here, however long the text may go on"), (2, "x")], "doc_id long, text string").coalesce(1)
    assert [r.n_removed for r in suffix.remove_repeats(df, 64).collect()] == [0, 0]
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, 10)


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    at = docs
    for k, (name, stage) in enumerate(p.STAGES):
        after = stage(spark, at, data)
        if k < 4:
            after = p.durable(after)
            assert sorted(after.columns) == sorted(docs.columns), name
        before_ids, ids = {r.doc_id for r in at.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before_ids
        if name in ("pii", "mixing", "packing"):
            assert ids == before_ids
        if name == "minhash":
            known = minhash.near_duplicates(at.select("doc_id", "text"), k=5).where("kept").select("doc_id").collect()
            assert ids == {r.doc_id for r in known}
        at = after
    assert at.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
