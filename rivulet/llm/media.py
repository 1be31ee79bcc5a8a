"""ISO media containers: a writer for byte payloads and a reader of codec, duration and keyframe byte ranges.

The reader walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample tables stts, stsz, stsc, stco/co64
and stss of each track and the runs of fragments (tfhd, trun and their defaults in trex), and never decodes payloads. Boxes
nested deeper than DEEPEST, tables that claim more entries than they have bytes, and samples that claim more bytes than the
file has are errors before anything is allocated.

Defined cases: broken containers give a null codec and an error text, never a failed task; a null value gives nulls and the
error 'no data'; a null or empty text is a payload of spaces; rows are handled one by one, so null and repeated ids stay and equal
texts give equal values; other columns are not read; an empty table gives no rows; texts are stored whole, whatever their
length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rivulet.llm.common import long_id, slices, text_id

#: Boxes that hold boxes. Fixed values of the container format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Bytes of one media sample, samples of one chunk, distance of keyframes and samples a second of what the writer stores.
SAMPLE, CHUNK, SYNC, RATE = 192, 16, 64, 50
#: Levels of boxes beyond which a file is taken as broken.
DEEPEST = 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write(payload: bytes) -> bytes:
    """A container whose only track holds payload as unsigned 8-bit samples, 192 bytes to a media sample."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK)
    sync = range(1, n + 1, SYNC)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    wide = len(payload) + 64 * 1024 + 16 * n > (1 << 32) - 1

    def moov(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.uint64) * np.uint64(SAMPLE * CHUNK)
        entry = box(b"raw ", bytes(6), struct.pack(">H8xHH4xI", 1, 1, 8, (SAMPLE * RATE) << 16))
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        information = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), information)
        header = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 1 << 16, 0x100), matrix, bytes(24), struct.pack(">I", 2)), box(b"trak", header, media))

    start = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = len(start) + len(moov(0)) + head
    return start + moov(at) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, first byte of the body, its end) of every box, parents before children."""
    open_: list[tuple[int, int, tuple]] = [(start, end, ())]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            if start != end:
                raise ValueError(f"{end - start} stray bytes at {start}")
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError(f"box {kind!r} at {start} is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield (*path, kind), start + head, start + size
        open_.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(path) >= DEEPEST:
                raise ValueError(f"boxes are nested deeper than {DEEPEST} at {start}")
            open_.append((start + head, start + size, (*path, kind)))


def entries(table: memoryview, at: int, width: int) -> int:
    """The number of entries that a table says at `at - 4`, if it has the bytes for them."""
    n = struct.unpack_from(">I", table, at - 4)[0]
    if n * width > len(table) - at:
        raise ValueError(f"a table of {len(table)} bytes claims {n} entries")
    return n


def sample_ranges(t: dict[bytes, memoryview], end: int) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and sizes of a track's samples, from stsz, stsc and stco or co64."""
    fixed = struct.unpack_from(">I", t[b"stsz"], 4)[0]
    n = struct.unpack_from(">I", t[b"stsz"], 8)[0] if fixed else entries(t[b"stsz"], 12, 4)
    if n * fixed > end:
        raise ValueError(f"{n} samples of {fixed} bytes are more than the file")
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(t[b"stsz"], ">u4", n, 12).astype(np.int64)
    wide = b"co64" in t
    table = t[b"co64"] if wide else t[b"stco"]
    chunks = np.frombuffer(table, ">u8" if wide else ">u4", entries(table, 8, 8 if wide else 4), 8).astype(np.int64)
    runs = np.frombuffer(t[b"stsc"], ">u4", 3 * entries(t[b"stsc"], 8, 12), 8).astype(np.int64).reshape(-1, 3)
    begin = np.append(runs[:, 0], len(chunks) + 1)
    if len(runs) and (begin[0] != 1 or (np.diff(begin) <= 0).any()) or sum(int(x) * int(y) for x, y in zip(runs[:, 1], np.diff(begin), strict=True)) != n:
        raise ValueError("sample tables disagree")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    chunk = np.repeat(np.arange(len(chunks)), per)[:n]
    if len(chunk) != n:
        raise ValueError("sample tables disagree")
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    first = first[first < max(n, 1)]
    base = np.zeros(len(chunks), np.int64)
    base[: len(first)] = before[first] if n else 0
    return chunks[chunk] + before - base[chunk], sizes


def fragment_samples(data: memoryview, moof: tuple[int, list], defaults: dict[int, tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Track, first bytes, sizes, durations and sync marks of each run (trun) of a moof: its first byte and its traf boxes."""
    begin, trafs = moof
    done = begin
    for traf in trafs:
        head = next(body for kind, body in traf if kind == b"tfhd")
        flags, track = struct.unpack_from(">II", head)
        at, base = 8, begin if flags & 0x20000 else done
        if flags & 1:
            base, at = struct.unpack_from(">Q", head, at)[0], at + 8
        at += 4 if flags & 2 else 0
        usual = list(defaults.get(track, (0, 0, 0)))
        for k, bit in enumerate((8, 0x10, 0x20)):
            if flags & bit:
                usual[k], at = struct.unpack_from(">I", head, at)[0], at + 4
        done = base
        for body in [body for kind, body in traf if kind == b"trun"]:
            flags, n = struct.unpack_from(">II", body)
            flags, at = flags & 0xFFFFFF, 8
            if flags & 1:
                done, at = base + struct.unpack_from(">i", body, at)[0], at + 4
            first = None
            if flags & 4:
                first, at = struct.unpack_from(">I", body, at)[0], at + 4
            bits = [x for x in (0x100, 0x200, 0x400, 0x800) if flags & x]
            if at + 4 * n * len(bits) > len(body):
                raise ValueError("a run of samples is cut off")
            if n > len(data):
                raise ValueError("more samples than bytes")
            table = np.frombuffer(body, ">u4", n * len(bits), at).astype(np.int64).reshape(n, len(bits))
            long, size, mark = (table[:, bits.index(x)] if x in bits else np.full(n, usual[k], np.int64) for k, x in enumerate((0x100, 0x200, 0x400)))
            if first is not None and n:
                mark = mark.copy()
                mark[0] = first
            yield track, done + np.cumsum(size) - size, size, long, mark & 0x10000 == 0
            done += int(size.sum())


def read_track(t: dict[bytes, memoryview], more: list[tuple], end: int) -> dict:
    """One track from its boxes and its fragments' runs."""
    runs = np.frombuffer(t[b"stts"], ">u4", 2 * entries(t[b"stts"], 8, 8), 8).astype(np.int64).reshape(-1, 2)
    at, sizes = sample_ranges(t, end)
    keys = np.arange(len(at))
    if b"stss" in t:
        keys = np.frombuffer(t[b"stss"], ">u4", entries(t[b"stss"], 8, 4), 8).astype(np.int64) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= len(at)):
            raise ValueError("a keyframe lies beyond the samples")
    duration = int((runs[:, 0] * runs[:, 1]).sum())
    for first, size, long, sync in more:
        keys = np.concatenate([keys, len(at) + np.flatnonzero(sync)])
        at, sizes, duration = np.concatenate([at, first]), np.concatenate([sizes, size]), duration + int(long.sum())
    if len(at) and ((at + sizes).max() > end or at.min() < 0):
        raise ValueError("a sample lies beyond the end")
    return {
        "codec": bytes(t[b"stsd"][12:16]).decode("latin-1"), "timescale": struct.unpack_from(">I", t[b"mdhd"], 20 if t[b"mdhd"][0] == 1 else 12)[0], "duration": duration,
        "n_samples": len(at), "key_offsets": at[keys].tolist(), "key_sizes": sizes[keys].tolist(), "offsets": at, "sizes": sizes,
    }


def inspect(data: bytes) -> dict:
    """Codec, time scale, duration, samples and keyframe byte ranges of every track (tracks, in the order of the file) and
    of the first one; error instead if the container is broken."""
    out = {"codec": None, "timescale": None, "duration": None, "n_samples": None, "key_offsets": [], "key_sizes": [], "tracks": [], "error": None}
    try:
        view, traks, moofs, defaults = memoryview(data), [], [], {}
        for path, a, b in boxes(view, 0, len(data)):
            if path[-1] == b"trak":
                traks.append({})
            elif b"trak" in path and (path[-1] in (b"stsd", b"tkhd") or path[-2] in (b"stbl", b"mdia")):
                traks[-1].setdefault(path[-1], view[a:b])
            elif path[-1] == b"trex":
                track, _, *usual = struct.unpack_from(">5I", view[a:b], 4)
                defaults[track] = tuple(usual)
            elif path[-1] == b"moof":
                moofs.append((a - (8 if view[a - 4 : a] == b"moof" else 16), []))
            elif path[-1] == b"traf" and b"moof" in path:
                moofs[-1][1].append([])
            elif path[-2:-1] == (b"traf",) and b"moof" in path:
                moofs[-1][1][-1].append((path[-1], view[a:b]))
        if not traks:
            raise ValueError("no track")
        more = {}
        for moof in moofs:
            for track, *run in fragment_samples(view, moof, defaults):
                more.setdefault(track, []).append(run)
        tracks = []
        for t in traks:
            head = t.get(b"tkhd")
            track = struct.unpack_from(">I", head, 20 if head[0] == 1 else 12)[0] if head is not None else None
            tracks.append(read_track(t, more.pop(track, []), len(data)))
        if more:
            raise ValueError("fragments of an unknown track")
        return out | tracks[0] | {"tracks": tracks}
    except (KeyError, ValueError, IndexError, OverflowError, StopIteration, struct.error) as e:
        return out | {"error": str(e)[:200] or type(e).__name__}


def payload_of(data: bytes, info: dict) -> bytes:
    """The samples' bytes, read from the places that the sample tables name."""
    return b"".join([data[a : a + n] for a, n in zip(info["offsets"].tolist(), info["sizes"].tolist(), strict=True)])


def media_columns(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Adds codec, timescale, duration, n_samples, keyframes (array of offset and size) of the first track, error, and tracks
    (array of the same fields for every track) for a binary column.

    A null value gives nulls and the error 'no data'; rows and repeats are kept as they are.
    """

    def run(batches):
        for batch in slices(batches):
            found = [inspect(bytes(x)) if x is not None else inspect(b"") | {"error": "no data"} for x in batch[column]]
            out = batch[list(keep)].copy()
            for name in ("codec", "timescale", "duration", "n_samples"):
                out[name] = pd.Series([x[name] for x in found], dtype="object" if name == "codec" else "Int64", index=out.index)
            frames = lambda x: [{"offset": a, "size": n} for a, n in zip(x["key_offsets"], x["key_sizes"], strict=True)]
            out["keyframes"] = [frames(x) for x in found]
            out["error"] = [x["error"] for x in found]
            out["tracks"] = [[{k: t[k] for k in ("codec", "timescale", "duration", "n_samples")} | {"keyframes": frames(t)} for t in x["tracks"]] for x in found]
            yield out

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    kept.sort(key=lambda x: keep.index(x.split("`")[1]))
    return df.select(*keep, *([column] if column not in keep else [])).mapInPandas(run, ", ".join([*kept, "codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,size:long>>, error string", "tracks array<struct<codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<offset:long,size:long>>>>"]))


def text_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stores each whole text as a container and reads it back: digests of payload and container, and its feature string.

    A null text is empty; the payload is padded with spaces to a positive multiple of 192 bytes. Equal texts give equal values.
    """

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        data = write(raw.ljust(max(SAMPLE, -(-len(raw) // SAMPLE) * SAMPLE), b" "))
        info = inspect(data)
        back = payload_of(data, info)
        keys = ",".join(f"{a}+{n}" for a, n in zip(info["key_offsets"], info["key_sizes"], strict=True))
        feature = f"codec={info['codec'].strip()};timescale={info['timescale']};duration={info['duration']};samples={info['n_samples']};keyframes={keys}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, info["duration"] / info["timescale"], data

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "media"]

    def run(batches):
        for batch in slices(batches):
            out = pd.DataFrame([one(x) for x in batch["text"]], columns=names, index=batch.index)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out if with_media else out.drop(columns="media")

    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double"
    return long_id(docs.select(text_id(), "text").mapInPandas(run, schema + (", media binary" if with_media else "")))
