"""The whole job: cases in which an operator once did a part of it."""

import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import media, minhash, mixing, substring, toxicity


def covered(passage, other, before, after):
    """Share of the passage's characters in runs that the other text has too, when it stands between two texts."""
    known = set(substring.runs(other, 2, 60)[0].tolist())
    text = before + passage + after
    key, first, last, ends = substring.runs(text, 2, 60)
    bounds, found = [0, *ends.tolist()], np.zeros(len(text), bool)
    for k, a, b in zip(key.tolist(), first, last, strict=True):
        if k in known:
            found[bounds[a] : bounds[b]] = True
    return found[len(before) : len(before) + len(passage)].mean()


def test_every_passage_of_50_words_holds_runs(data):
    r, shares = random.Random(1), []
    texts = [x for (x,) in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    for text in texts * 5:
        words = text.split(" ")
        if len(words) >= 70:
            k = r.randrange(len(words) - 50)
            shares.append(covered(" ".join(words[k : k + 50]), text, " ".join(r.choice(texts).split(" ")[:13]) + " ", " " + " ".join(r.choice(texts).split(" ")[:12])))
    assert len(shares) > 200 and min(shares) > 0 and np.mean(np.array(shares) < 0.5) < 0.02
    kana = "".join(chr(0x4E00 + r.randrange(3000)) + "。" * (r.random() < 0.05) for _ in range(400))
    assert covered(kana[100:250], kana, "前置文章", "後続文章") > 0.5


def test_runs_reach_both_ends_of_a_text():
    text = "A first sentence stands here and is long enough for a run of its own. Then comes another one of some length to follow it. Short end. Bye."
    _, first, last, ends = substring.runs(text, 2, 60)
    assert set(range(len(ends))) == {k for a, b in zip(first, last, strict=True) for k in range(a, b)}
    assert len(substring.runs("Too short. Ok.", 2, 60)[0]) == len(substring.runs("one", 2, 60)[0]) == 1


def test_later_copies_lose_all(spark):
    long = " ".join(f"word{k * k % 97} is told in sentence {k}." for k in range(12))
    texts = [long + " Short end. Bye.", "Too short. Ok.", "x" * 70, "one"]
    df = spark.createDataFrame([(10 * c + k, t) for c in range(3) for k, t in enumerate(texts)] + [(50, "Before it. " + texts[0] + " And after it.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    assert [got[k] for k in range(4)] == texts and [got[10 * c + k] for c in (1, 2) for k in range(4)] == [""] * 8
    assert got[50] == "Before it. And after it."


def test_sequences_follow_the_schedule(spark):
    import corpus_pipeline as p

    ids = spark.createDataFrame([(k, "aab"[k % 3]) for k in range(3000)], "doc_id long, source string")
    order = [r.doc_id for r in mixing.mix(ids).select("doc.doc_id", "slot", "offset").orderBy("slot", "offset").collect()]
    rows = [(k, "aab"[k % 3], " ".join(str(k + j) for j in range(2 + order.index(k) // 30))) for k in range(3000)]
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        mixed = p.durable(p.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"), ""))
        sizes = [len(open(f.removeprefix("file:"), "rb").read()) for f in mixed.inputFiles()]
        assert len(sizes) > 8 and max(sizes) > 3 * min(sizes)
        part = {r.doc_id: r.sequence_id >> 33 for r in p.pack_sequences(spark, mixed, "").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = [part[k] for k in order]
    assert p.in_file_order(ids).count() == 3000
    assert len(parts) == 3000 and len(set(parts)) > 8 and parts == sorted(parts)


def test_mixing_weights_are_exact(spark):
    rows = [(k, "abc"[k % 3]) for k in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in ({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 3 / 7, "b": 2 / 7, "c": 2 / 7}):
        slots = {r.slot: r.source for r in mixing.mix(df, weights, block_rows=1).select("doc.source", "slot").collect()}
        given, total = dict.fromkeys("abc", 0), sum(weights.values())
        for t in range(7000):
            given[slots[t]] += 1
            assert all(abs(given[s] - (t + 1) * w / total) < 1 + 1e-6 for s, w in weights.items())


def test_mixing_many_sources_keep_their_weights(spark):
    counts = spark.createDataFrame([(f"s{k}", 100) for k in range(2000)], "key string, rows long")
    weights = {str(k): 1 for k in range(1, 2000)} | {"0": 20}
    got = {r.key: r.n / r.q for r in mixing.slots_by_source(counts, None, weights).collect()}
    assert abs(got["s0"] - 20 / 2019) < 1e-12
    lacking = {r.key: r.n / r.q for r in mixing.slots_by_source(counts.limit(2), None, {"0": 0.25}).collect()}
    assert sorted(round(x, 6) for x in lacking.values()) == [round(1 / 1001, 6), round(1000 / 1001, 6)]
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 0.1234567891, "b": 1})


def track(number, kind, scale, sizes, offset, sync):
    n, table = len(sizes), lambda *x: struct.pack(f">{len(x)}I", *x)
    marks = [] if sync is None else [media.full(b"stss", table(len(sync), *sync))]
    stbl = media.box(
        b"stbl", media.full(b"stsd", table(1), media.box(kind, bytes(8))), media.full(b"stts", table(1, n, 2) if n else table(0)), *marks,
        media.full(b"stsc", table(1, 1, n, 1) if n else table(0)), media.full(b"stsz", table(0, n, *sizes)), media.full(b"stco", table(1, offset) if n else table(0)),
    )
    return media.box(b"trak", media.full(b"tkhd", table(0, 0, number)), media.box(b"mdia", media.full(b"mdhd", table(0, 0, scale, n)), media.box(b"minf", stbl)))


def test_every_track_of_a_file(spark):
    payload = media.box(b"mdat", bytes(range(100)))
    data = payload + media.box(b"moov", track(1, b"mp4a", 48, [5, 6, 7], 8, None), track(2, b"avc1", 30, [20, 10, 30], 26, [1, 3]))
    info = media.inspect(data)
    assert info["error"] is None and [t["codec"] for t in info["tracks"]] == ["mp4a", "avc1"] and [t["timescale"] for t in info["tracks"]] == [48, 30]
    assert [(t["key_offsets"], t["key_sizes"]) for t in info["tracks"]] == [([8, 13, 19], [5, 6, 7]), ([26, 56], [20, 30])]
    shown = media.media_columns(spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, media binary"), "media", "id").orderBy("id").collect()
    assert [(t.codec, t.duration, [tuple(k) for k in t.keyframes]) for t in shown[0].tracks] == [("mp4a", 6, [(8, 5), (13, 6), (19, 7)]), ("avc1", 6, [(26, 20), (56, 30)])] and shown[1].tracks == []


def test_fragments():
    table = lambda *x: struct.pack(f">{len(x)}I", *x)
    moov = media.box(b"moov", track(7, b"avc1", 30, [], 0, None), media.box(b"mvex", media.full(b"trex", table(7, 1, 3, 0, 0x10000))))
    moof = lambda at: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", table(7), flags=0x20000), media.full(b"trun", table(3, at, 0, 4, 5, 6), flags=0x205)))
    at = len(moof(0)) + 8
    info = media.inspect(moov + moof(at) + media.box(b"mdat", bytes(15)))
    assert info["error"] is None and info["duration"] == 9 and info["offsets"].tolist() == [len(moov) + at + k for k in (0, 4, 9)]
    assert info["key_offsets"] == [len(moov) + at] and info["key_sizes"] == [4]


def test_crafted_containers_are_errors():
    deep = b""
    for _ in range(2000):
        deep = media.box(b"moov", deep)
    assert "nested" in media.inspect(deep)["error"]
    good = media.write(b"x" * 192 * 20)
    for kind, at in ((b"stsz", 12), (b"stts", 8), (b"stss", 8), (b"stsc", 8), (b"stco", 8)):
        k = good.index(kind) + at + (4 if kind == b"stsz" else 0)
        assert media.inspect(good[:k] + b"\xff\xff\xff\xff" + good[k + 4 :])["error"], kind
    fixed = good.index(b"stsz") + 8
    assert media.inspect(good[:fixed] + b"\0\0\0\0" + b"\xff\xff\xff\xff" + good[fixed + 8 :])["error"]
    r = random.Random(5)
    for _ in range(2000):
        data = bytearray(good)
        for _ in range(3):
            data[r.randrange(len(data) // 8)] = r.randrange(256)
        media.inspect(bytes(data))  # says something, and never fails


def read_back(data):
    """Payload, duration and keyframes of a stored text by a reader of its own: offsets of fixed boxes found by their names."""
    at = lambda kind: data.index(kind) + 4
    u = lambda k: struct.unpack_from(">I", data, k)[0]
    size, n = u(at(b"stsz") + 4), u(at(b"stsz") + 8)
    chunks = [u(at(b"stco") + 8 + 4 * k) for k in range(u(at(b"stco") + 4))]
    runs = [struct.unpack_from(">III", data, at(b"stsc") + 8 + 12 * k) for k in range(u(at(b"stsc") + 4))]
    places = []
    for c, offset in enumerate(chunks, 1):
        per = [p for first, p, _ in runs if first <= c][-1]
        places += [offset + size * k for k in range(per)]
    keys = [u(at(b"stss") + 8 + 4 * k) for k in range(u(at(b"stss") + 4))]
    return b"".join(data[p : p + size] for p in places), u(at(b"stts") + 8) * u(at(b"stts") + 12), [places[k - 1] for k in keys], n, size


def test_op6_by_an_independent_reader(spark, data):
    import hashlib

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in media.text_media(docs, with_media=True).collect():
        raw = texts[r.doc_id].encode()
        payload, duration, keys, n, size = read_back(bytes(r.media))
        assert payload == raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert r.feature == f"codec=raw;timescale=50;duration={duration};samples={n};keyframes=" + ",".join(f"{k}+{size}" for k in keys)


def test_toxic_offsets_hold_in_the_text_itself(spark):
    words = ["calm", "river", "stone", "table", "green", "window", "quiet", "paper"]
    r = random.Random(3)
    clean = [" ".join(r.choice(words) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(r.choice(words) for _ in range(12)) + " rotten rotten awful " + " ".join(r.choice(words) for _ in range(12)) for _ in range(60)]
    model = toxicity.fit([x.split() for x in clean + bad], np.array([0] * 60 + [1] * 60))
    df = spark.createDataFrame([(1, "İstanbul and İzmir are rotten rotten awful towns"), (2, "Calm ROTTEN rotten awful river")], "doc_id long, text string")
    for row in toxicity.score(df, model).collect():
        text = {1: "İstanbul and İzmir are rotten rotten awful towns", 2: "Calm ROTTEN rotten awful river"}[row.doc_id]
        assert row.predicted == 1 and {text[s.start : s.end].lower() for s in row.spans} <= {"rotten", "awful"} and len(row.spans) >= 2
    # Transitions matter: an undecided token is toxic among toxic ones, and clean among clean ones.
    among = lambda e: toxicity.marginals(np.array([e, 0.0, e]), np.array([3]), model.transition)[1]
    assert among(4.0) > 0.6 > 0.4 > among(-4.0)


def test_op1_scores_like_the_model_alone(spark, data):
    from rivulet.llm import queries

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, data).collect()}
    assert got.keys() == texts.keys()
    weights = toxicity.Weights(model.by_feature, model.bias)
    for d, text in texts.items():
        emission = np.array([weights[t] for t in toxicity.tokens_of(text)])
        # One chain at a time, step by step, in logarithms.
        trans, n = model.transition, len(emission)
        psi = np.stack([np.zeros(n), np.clip(emission, -30, 30)], 1)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        for k in range(n):
            # Before the first token either state is as likely.
            a[k] = psi[k] + np.logaddexp((a[k - 1, 0] if k else 0) + trans[0], (a[k - 1, 1] if k else 0) + trans[1])
        for k in range(n - 2, -1, -1):
            b[k] = np.logaddexp(trans[:, 0] + psi[k + 1, 0] + b[k + 1, 0], trans[:, 1] + psi[k + 1, 1] + b[k + 1, 1])
        p = 1 / (1 + np.exp((a + b)[:, 0] - (a + b)[:, 1])) if n else np.zeros(0)
        z = np.array([np.log1p(p.sum()), p.max(initial=0), p.mean() if n else 0]) @ model.curve[:-1] + model.curve[-1]
        assert abs(got[d].score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6
        assert got[d].predicted == (got[d].score >= 0.7) and got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_op5_by_brute_force(spark, data):
    from rivulet.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = {d: substring.runs(t or "", 2, 60) for d, t in texts.items()}
    first = {}
    for d in sorted(texts):
        for key in found[d][0].tolist():
            first.setdefault(key, d)
    got = {r.doc_id: r for r in queries.op5_substring(spark, data).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        keys, begin, end, ends = found[d]
        lost, seen = set(), set()
        for key, a, b in zip(keys.tolist(), begin.tolist(), end.tolist(), strict=True):
            if first[key] != d or key in seen:
                lost |= set(range(a, b))
            seen.add(key)
        bounds = [0, *ends.tolist()]
        kept = "".join((text or "")[bounds[k] : bounds[k + 1]] for k in range(len(ends)) if k not in lost)
        assert (got[d].n_removed, got[d].text or "") == (len(lost), kept), d


def test_op10_against_the_tokenizer(spark, data):
    from collections import defaultdict

    import public_tokenizers
    from tokenizers import Tokenizer

    from rivulet.llm import queries

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op10_packing(spark, data).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for d, rows in pieces.items():
        ids, at = [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 1], 0
        for r in sorted(rows, key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part)) and r.length > 0
            at += r.length
        assert at == len(ids)
    used = waste = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used, waste = used + at, waste + (0 if at & (at - 1) == 0 else 2048 - at)
    parts = len({s >> 33 for s in sequences})
    assert waste <= 2048 * parts and waste < 0.05 * used + 2048 * parts


def test_rows_without_a_conversation_stand_alone(spark):
    from rivulet.llm import chat

    rows = [(None, 0, "user", f"t{k}", "x") for k in range(5)] + [(None, 0, "user", "t0", "x"), (3, 0, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    got = chat.parse_chats(chat.format_chats(df)).collect()
    assert sorted((r.conv_id is None, len(r.turns)) for r in got) == [(False, 1), *[(True, 1)] * 4, (True, 2)]


def test_mixing_bounds_what_it_plans(spark):
    many = spark.createDataFrame([(k, str(k)) for k in range(4001)], "doc_id long, source string")
    with pytest.raises(Exception, match="sources"):
        mixing.mix(many).count()
    few = spark.createDataFrame([(k, "ab"[k % 5 == 0]) for k in range(100)], "doc_id long, source string").withColumn("slot", F.lit(1))
    assert mixing.mix(few).count() == 100


def test_null_texts_go_through_the_whole_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)
    at = p.durable(docs.union(odd).union(odd.withColumn("doc_id", F.lit(None).cast("long"))))
    for k, (_, stage) in enumerate(p.STAGES):
        at = stage(spark, at, data)
        if k < 4:
            assert at.columns == docs.columns
            at = p.durable(at)
    ids = {r.doc_id for r in at.select("doc_id").collect()}
    assert {r.doc_id for r in odd.select("doc_id").collect()} <= ids and None in ids


def test_a_large_group_around_the_threshold(spark):
    """250 copies of one text, each with edits of its own: most pairs lie a little below the threshold, some above."""
    from tests.llm.test_spark import closure, near

    r = random.Random(9)
    base = [f"w{k}" for k in range(110)]
    texts = []
    for d in range(250):
        words = list(base)
        for k in r.sample(range(110), 2 if d % 3 == 0 else 3):
            words[k] = f"e{d}x{k}" if r.random() < 0.7 else f"e{k}"
        texts.append(" ".join(words))
    linked = [(a, b) for a in range(250) for b in range(a + 1, 250) if near(texts[a], texts[b], 4)]
    expected = closure(range(250), linked)
    assert 100 < len(linked) < 0.5 * 250 * 249 / 2 and 20 < len(set(expected.values())) < 230
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("component", F.lit(2))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df, k=4, block=64).collect()}
    assert got == expected


def test_rows_with_one_id_are_looked_at_apart(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(5, text, 1), (5, "something else that stands alone here", 2), (3, text, 3), (6, None, 4), (6, None, 5)], "doc_id long, text string, digest int")
    kept = minhash.keep_first(df).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(3, text), (5, "something else that stands alone here"), (6, "")]
