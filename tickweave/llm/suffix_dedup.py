"""Removal of repeated byte strings by suffix arrays (difference-cover algorithm).

Each byte covered by a string of ``length`` bytes that also starts anywhere else,
in the same text or another, is removed. The suffix sort is distributed by content:

1. Every window of ``length`` bytes goes to the bin of the least hash among its
   64-byte strings, so equal windows share a bin. Neighbouring windows of one bin
   travel as one run (a stretch of text), so far only as digest, place and length.
   Digests are 128 bits of a cryptographic hash of the bytes: equal ones are equal bytes.
2. Bins with one run hold no repeat. If a bin's runs are all the same stretch,
   every window in them repeats. All other bins are sorted: one copy of each
   different stretch is fetched, and the bins' suffix arrays are built by the
   difference-cover algorithm (sort sampled triples, recurse on their names, merge
   the remaining suffixes); neighbours in it that agree in ``length`` bytes repeat.
3. A bin of more than ``HOT`` runs is too much for one task's sort: the windows of its
   different stretches are dealt out by such a digest of their bytes, packed, and
   equal ones counted, ``PIECES`` pieces a task one after the other.

A repeat between two runs of one bin at once makes a text's own windows count as
well. Bins are sorted some at a time (``BATCH`` bytes), so memory is bounded.

Defined cases: null text is empty; repeated rows repeat each other's strings; ids
may be null or repeat with different texts; matches never cross texts; texts
shorter than ``length`` stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, small_batches, staged
from .shingles import BASE, INVERSE, mixed, powers

GRAM, LONGEST, SEGMENT, BATCH, HOT, PIECES = 64, 256, 1 << 18, 1 << 20, 2048, 32


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols from 1 on (fewer than 2 ** 21 of them, values under 2 ** 21)."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    bits = np.int64(int(max(int(s.max()), n) + 1).bit_length())
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    extra = 1 if n % 3 == 1 else 0  # an empty suffix, so that the two sampled classes stay apart
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    cover = np.concatenate([one, two])
    triple = (t[cover] << (2 * bits)) | (t[cover + 1] << bits) | t[cover + 2]
    names, inverse = np.unique(triple, return_inverse=True)
    if len(names) == len(cover):
        order = np.empty(len(cover), np.int64)
        order[inverse] = np.arange(len(cover))
    else:
        order = suffix_array(inverse + 1)
    sampled = cover[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << bits) | rank[zero + 1], kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((t[first] << bits) | rank[first + 1], (t[zero] << bits) | rank[zero + 1])
    pair = lambda i: (t[i] << (2 * bits)) | (t[i + 1] << bits) | rank[i + 2]
    before += np.searchsorted(pair(second), pair(zero))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, sampled
    return out


def least(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """of (minimum or maximum) over every window of ``width`` values."""
    have, out = 1, x
    while have * 2 <= width:
        out = of(out[:-have], out[have:])
        have *= 2
    return of(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def prefix_hash(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): (sums[e] - sums[s]) * inverse[s] is the hash of bytes s to e."""
    size = 1 << max(10, int(len(b) + 1).bit_length())
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[: len(b)], out=sums[1:])
    return sums, powers(INVERSE, size)


def digest_of(raw: bytes) -> bytes:
    """128 bits that stand for these bytes."""
    return hashlib.blake2b(raw, digest_size=16).digest()


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, bin, digest, repeats itself perhaps) of all runs of all texts."""
    parts_, held, size = [], [], 0
    for k, raw in enumerate(texts):
        for s in range(0, max(0, len(raw) - length + 1), SEGMENT):
            piece = raw[s : s + SEGMENT + length - 1]
            if size + len(piece) > 2 * SEGMENT and held:
                parts_.append(_runs(held, length))
                held, size = [], 0
            held.append((k, s, piece))
            size += len(piece)
    if held:
        parts_.append(_runs(held, length))
    if not parts_:
        return (*(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64)), [], np.zeros(0, np.int32))
    return tuple(sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*parts_, strict=True))


def _runs(held: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
    sums, inverse = prefix_hash(b)
    width = length - GRAM + 1
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(b) - GRAM + 1])
    low = least(grams, width)
    sizes = np.array([len(x[2]) for x in held])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.zeros(len(low) + 1, np.int64)  # windows that do not cross texts
    np.add.at(inside, begin, 1)
    np.add.at(inside, np.minimum(begin + sizes - length + 1, len(low)), -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    new[begin[begin < len(low)]] = True
    new &= ok
    start = np.flatnonzero(new)
    stop = np.ones(len(low) + 1, bool)  # a run ends before the next one or where windows cross
    stop[:-1] = new | ~ok
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, "right")]
    count = (end - start + LONGEST - 1) // LONGEST  # long runs are cut
    if (count > 1).any():
        which = np.repeat(np.arange(len(start)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        start, end = start[which] + nth * LONGEST, np.minimum(start[which] + (nth + 1) * LONGEST, end[which])
    n = end - start
    raw = b.tobytes()
    digest = [digest_of(raw[x:y]) for x, y in zip(start.tolist(), (end + length - 1).tolist(), strict=True)]
    # A run can hold equal windows only if its bin's 64 bytes are in it twice.
    most = least(np.concatenate([np.zeros(width - 1, np.uint64), np.where(ok, low, 0), np.zeros(width - 1, np.uint64)]), width, np.maximum)
    anchor = np.flatnonzero(grams == most[: len(grams)])
    values, group = np.unique(grams[anchor], return_inverse=True)
    place = np.sort((group.astype(np.int64) << 32) | anchor)
    mine = np.searchsorted(values, low[start]).astype(np.int64) << 32
    twice = np.searchsorted(place, mine | (end + width - 2), "right") - np.searchsorted(place, mine | start) > 1
    owner = np.searchsorted(begin, start, "right") - 1
    texts, offset = np.array([x[0] for x in held]), np.array([x[1] for x in held])
    return texts[owner], (start - begin[owner] + offset[owner]).astype(np.int32), n.astype(np.int32), low[start].view(np.int64), digest, twice.astype(np.int32)


def repeated_windows(stretches: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch, which of its windows start a string that also starts elsewhere (in these, or in its copies)."""
    b = np.frombuffer(b"".join(stretches), np.uint8)
    sizes = np.array([len(s) for s in stretches])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    valid = np.zeros(len(b), bool)
    for s, n in zip(begin, sizes, strict=True):
        valid[s : s + n - length + 1] = True
    order = suffix_array(b.astype(np.int64) + 1)
    order = order[valid[order]]
    view = np.lib.stride_tricks.sliding_window_view(b, length)
    twice = np.zeros(len(b), bool)
    for s in range(0, len(order) - 1, 20_000):
        x, y = order[s : s + 20_000], order[s + 1 : s + 20_001]
        same = (view[x[: len(y)]] == view[y]).all(axis=1)
        twice[x[: len(y)][same]] = True
        twice[y[same]] = True
    out = []
    for k, (s, n) in enumerate(zip(begin, sizes, strict=True)):
        out.append(np.ones(n - length + 1, bool) if counts[k] > 1 else twice[s : s + n - length + 1])
    return out


def _stretch_rows(keys: list[tuple[int, bytes]], flags: list[np.ndarray]) -> pa.RecordBatch:
    """(bin, digest, starts, lengths) of the repeated windows of each stretch that has some."""
    bins, digests, starts, lengths = [], [], [], []
    for (b, d), flag in zip(keys, flags, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
        if len(edge):
            bins.append(b)
            digests.append(d)
            starts.append(edge[::2].astype(np.int32))
            lengths.append((edge[1::2] - edge[::2]).astype(np.int32))
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(digests, pa.binary()), pa.array(starts, ints), pa.array(lengths, ints)], names=["bin", "digest", "starts", "lengths"])


FOUND = "bin long, digest binary, starts array<int>, lengths array<int>"


def _sorted_bins(stretches: DataFrame, length: int) -> DataFrame:
    """stretches(bin, digest, copies, bytes) -> FOUND, by suffix arrays of whole bins, BATCH bytes at a time."""

    def run(batches):
        keys, counts, held, size, last = [], [], [], 0, None
        for batch in batches:
            for b, d, n, raw in zip(*(batch.column(c).to_pylist() for c in ("bin", "digest", "copies", "bytes")), strict=True):
                if b != last and size > BATCH // 2:
                    yield _stretch_rows(keys, repeated_windows(held, np.array(counts), length))
                    keys, counts, held, size = [], [], [], 0
                last = b
                keys.append((b, d))
                counts.append(n)
                held.append(raw)
                size += len(raw)
        if held:
            yield _stretch_rows(keys, repeated_windows(held, np.array(counts), length))

    return stretches.repartition(parts(stretches.sparkSession), "bin").sortWithinPartitions("bin").mapInArrow(run, FOUND)


def _pieces(batches, names: list[str]):
    """The columns of each piece (rows of one ``part``, sorted together), put end to end."""
    last, held = None, []
    for batch in batches:
        part = batch.column("part").to_numpy()
        for k in range(len(part)):
            if part[k] != last and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            last = part[k]
            held.append([batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in names])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _packed(to: np.ndarray, columns: dict[str, np.ndarray], pieces: int) -> pa.RecordBatch:
    """One row for each piece that ``to`` names: part, and its share of the columns as lists."""
    order = np.argsort(to, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=pieces))]).astype(np.int32)
    full = np.flatnonzero(np.diff(at))
    offsets = pa.array(np.concatenate([at[full], at[-1:]]))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns.values())], names=["part", *columns])


def _hashed_bins(stretches: DataFrame, length: int) -> DataFrame:
    """The same for hot bins: windows dealt out by digest, then those that repeat by stretch; rows of both deals are packed."""
    width = parts(stretches.sparkSession)
    pieces = width * PIECES

    def deal(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for d, n, raw in zip(batch.column("digest").to_pylist(), batch.column("copies").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                m = len(raw) - length + 1
                window = np.frombuffer(b"".join(digest_of(raw[i : i + length]) for i in range(m)), np.int64).reshape(-1, 2)
                name = np.frombuffer(d, np.int64)
                for col, v in zip(cols, (window[:, 0], window[:, 1], np.full((m, 2), name), np.arange(m), np.full(m, n)), strict=True):
                    col.append(v)
            if not cols[0]:
                continue
            h, g, name, at, n = (np.concatenate(c) for c in cols)
            yield _packed((h.view(np.uint64) % np.uint64(pieces)).astype(np.int64), {"h": h, "g": g, "a": name[:, 0], "b": name[:, 1], "at": at, "copies": n.astype(np.int64)}, pieces)

    def count(batches):
        for h, g, a, b, at, n in _pieces(batches, ["h", "g", "a", "b", "at", "copies"]):
            order = np.lexsort((g, h))
            same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
            twice = n[order] > 1
            twice[1:] |= same
            twice[:-1] |= same
            keep = order[twice]
            if len(keep):
                yield _packed((a[keep].view(np.uint64) % np.uint64(pieces)).astype(np.int64), {"a": a[keep], "b": b[keep], "at": at[keep]}, pieces)

    def gather(batches):
        for a, b, at in _pieces(batches, ["a", "b", "at"]):
            order = np.lexsort((at, b, a))
            a, b, at = a[order], b[order], at[order]
            other = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            starts = np.flatnonzero(other | np.concatenate([[True], at[1:] != at[:-1] + 1]))
            lengths = np.diff(np.concatenate([starts, [len(at)]]))
            first = np.flatnonzero(other[starts])
            offsets = pa.array(np.concatenate([first, [len(starts)]]).astype(np.int32))
            names = [x.tobytes() for x in np.stack([a, b], 1)[starts[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(at[starts].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(lengths.astype(np.int32)))], names=["digest", "starts", "lengths"])

    longs = lambda *names: "part int, " + ", ".join(f"{c} array<long>" for c in names)
    sorted_ = lambda df: df.repartition(width, "part").sortWithinPartitions("part")
    counted = sorted_(stretches.mapInArrow(deal, longs("h", "g", "a", "b", "at", "copies"))).mapInArrow(count, longs("a", "b", "at"))
    found = sorted_(counted).mapInArrow(gather, "digest binary, starts array<int>, lengths array<int>")
    # A stretch is in one bin only: its windows share their least hash.
    return found.join(stretches.select("bin", "digest"), "digest").select("bin", "digest", "starts", "lengths")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    width = parts(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")) if kind in ("bigint", "int") else F.xxhash64("doc_id", "text")
    whole = whole.select("doc_id", place.alias("k"), F.xxhash64("text").alias("tag"), "text")

    def cut(batches):
        for batch in batches:
            text, start, n, bin_, digest, twice = runs_of([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], length)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("tag").take(at), pa.array(start), pa.array(n), pa.array(bin_), pa.array(digest, pa.binary()), pa.array(twice)], names=["k", "tag", "start", "n", "bin", "digest", "twice"])

    runs = staged(whole.select("k", "tag", "text").mapInArrow(cut, "k long, tag long, start int, n int, bin long, digest binary, twice int"), "windows")
    stats = runs.groupBy("bin").agg(F.count("*").alias("runs"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("twice").alias("twice"))
    stats = stats.where("runs > 1 or twice > 0").select("bin", ((F.col("lo") == F.col("hi")) & (F.col("twice") == 0)).alias("plain"), (F.col("runs") > HOT).alias("hot"))
    shared = staged(runs.drop("twice").join(stats, "bin"), "runs")

    texts = whole.repartition(width, "k", "tag")  # one exchange, used by both joins below
    mixed_bins = shared.where("not plain")
    one = mixed_bins.groupBy("bin", "digest", "hot").agg(F.count("*").alias("copies"), F.min(F.struct("k", "tag", "start", "n")).alias("at"))
    wanted = one.select("bin", "digest", "copies", "hot", F.col("at.k").alias("k"), F.col("at.tag").alias("tag"), F.col("at.start").alias("start"), F.col("at.n").alias("n"))
    lists = wanted.groupBy("k", "tag").agg(F.collect_list(F.struct("start", "n", "bin", "digest", "copies", "hot")).alias("runs"))

    def fetch(batches):
        seen = set()  # rows of one id and text are in one task: their stretches are taken once
        for batch in batches:
            rows = []
            for k, tag, text, runs_ in zip(*[batch.column(c).to_pylist() for c in ("k", "tag", "text", "runs")], strict=True):
                if (k, tag) in seen:
                    continue
                seen.add((k, tag))
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(r["bin"], r["digest"], r["copies"], r["hot"], raw[r["start"] : r["start"] + r["n"] + length - 1]) for r in runs_]
            for s in range(0, len(rows), 20_000):
                cols = zip(*rows[s : s + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["bin", "digest", "copies", "hot", "bytes"])

    fetched = texts.join(lists.hint("shuffle_hash"), ["k", "tag"]).select("k", "tag", "text", "runs").mapInArrow(fetch, "bin long, digest binary, copies long, hot boolean, bytes binary")
    fetched = staged(fetched, "stretches")
    found = _sorted_bins(fetched.where("not hot").drop("hot"), length).unionByName(_hashed_bins(fetched.where("hot").drop("hot"), length))
    parts_ = found.select("bin", "digest", F.explode(F.arrays_zip("starts", "lengths")).alias("x"))
    spans = mixed_bins.join(parts_, ["bin", "digest"]).select("k", "tag", (F.col("start") + F.col("x.starts")).alias("start"), F.col("x.lengths").alias("n"))
    spans = spans.unionByName(shared.where("plain").select("k", "tag", "start", "n"))
    # A set: rows of one id and text have the same spans, and each needs them once.
    every = spans.groupBy("k", "tag").agg(F.collect_set(F.struct("start", "n")).alias("spans"))

    def drop(batches):
        for batch in batches:
            n_bytes, removed, n_spans, kept = [], [], [], []
            for text, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                stays, last, gone, count = [], 0, 0, 0
                for start, end in merged(sorted((x["start"], x["start"] + x["n"] + length - 1) for x in spans_ or [])):
                    stays.append(raw[last:start])
                    gone, count, last = gone + end - start, count + 1, end
                stays.append(raw[last:])
                n_bytes.append(len(raw))
                removed.append(gone)
                n_spans.append(count)
                kept.append(b"".join(stays))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(every.hint("shuffle_hash"), ["k", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(drop, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out
