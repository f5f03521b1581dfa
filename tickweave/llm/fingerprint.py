"""Document fingerprints by a randomised edit embedding.

All texts share one random walk. At time t the walk stands on a character; a bit
fixed by (t mod 256, class of the character) says whether it steps on or stays.
Reading the character under the walk at every time turns edit distance into
Hamming distance: after an edit two walks soon stand on the same place again. A
fingerprint samples fixed times, 32 in each octave of time, and keeps four bits
of a hash of what stands there (three characters from the walk's place). The
likeness of two fingerprints is the part of time in which they agree, each sample
standing for its stretch of time, corrected for agreement by chance.

Near copies are found by bit-sampled banding: a band draws samples from the whole
fingerprint, by their stretches of time; texts with an equal band meet and are
verified on their whole fingerprints, then all pairs of what is linked so.

Defined cases: null text is empty and has the fingerprint ''; equal texts have
equal fingerprints; documents are ordered by (id descending, text), null ids
last, so repeated ids have an order as well; the one document of a one-row table
is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import parts, small_batches, staged
from .jaccard import band_keys, bands_for, by_node, clusters, in_units, joined, with_blocks

CLASSES, PERIOD, PER_OCTAVE, OCTAVES = 32, 256, 32, 36
PIECE = 300_000
_TABLES: dict[str, object] = {}


def _tables() -> dict:
    if not _TABLES:
        rng = np.random.default_rng(20240229)
        moves = rng.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
        moves[:, 0] = True
        stay = np.zeros((CLASSES, PERIOD), np.int64)  # times spent, arriving in this phase
        for c in range(CLASSES):
            go = np.flatnonzero(np.concatenate([moves[c], moves[c]]))
            stay[c] = go[np.searchsorted(go, np.arange(PERIOD))] - np.arange(PERIOD) + 1
        one = ((np.arange(PERIOD) + stay) % PERIOD).astype(np.uint8)
        two = one[np.arange(CLASSES)[None, :, None], one[:, None, :]]
        three = one[np.arange(CLASSES)[None, None, :, None], two[:, :, None, :]]
        flat = three.reshape(-1, PERIOD)
        times, width = [np.arange(0, 64, 2)], [np.full(32, 2.0)]
        for k in range(6, 6 + OCTAVES):
            step = (1 << k) // PER_OCTAVE
            times.append((1 << k) + np.arange(PER_OCTAVE, dtype=np.int64) * step + rng.integers(0, step, PER_OCTAVE))
            width.append(np.full(PER_OCTAVE, float(step)))
        _TABLES.update(stay=stay, one=one, three=[x.tobytes() for x in flat], times=np.concatenate(times).astype(np.int64), width=np.concatenate(width))
    return _TABLES


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(codes: np.ndarray, start: int = 0) -> np.ndarray:
    """The time at which the walk reaches each character, and the time of its end; it begins at time ``start``."""
    t = _tables()
    stay, one, three = t["stay"], t["one"], t["three"]
    out = np.empty(len(codes) + 1, np.int64)
    for s in range(0, len(codes), PIECE):
        c = ((codes[s : s + PIECE].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59)).astype(np.int64)
        n = len(c)
        c = np.concatenate([c, np.zeros(-n % 3, np.int64)]).reshape(-1, 3)
        keys = (c[:, 0] * CLASSES + c[:, 1]) * CLASSES + c[:, 2]
        phase = np.frombuffer(bytes(accumulate(keys.tolist(), lambda p, k: three[k][p], initial=start % PERIOD)), np.uint8)[:-1]
        p1 = one[c[:, 0], phase]
        p2 = one[c[:, 1], p1]
        spent = np.stack([stay[c[:, 0], phase], stay[c[:, 1], p1], stay[c[:, 2], p2]], 1).reshape(-1)[:n]
        out[s] = start
        np.cumsum(spent, out=out[s + 1 : s + n + 1])
        out[s + 1 : s + n + 1] += start
        start = int(out[s + n])
    out[len(codes)] = start
    return out


def sampled(codes: np.ndarray, reached: np.ndarray) -> str:
    """The fingerprint: a hexadecimal digit for each sampled time before the walk's end."""
    times = _tables()["times"]
    times = times[: np.searchsorted(times, reached[-1])]
    if not len(codes):
        return ""
    at = np.searchsorted(reached, times, "right") - 1
    h = np.zeros(len(at), np.uint64)
    for k in range(3):
        i = at + k
        x = np.where(i < len(codes), codes[np.minimum(i, len(codes) - 1)], 0).astype(np.uint64)
        h = (h + x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return "".join(map("0123456789abcdef".__getitem__, (h & np.uint64(15)).tolist()))


def fingerprint(text: str | None) -> str:
    codes = codes_of(text or "")
    return sampled(codes, walk(codes))


def likeness(a: str | None, b: str | None) -> float:
    """0 to 1: the part of time in which two fingerprints agree, beyond chance."""
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    most, least = max(len(a), len(b)), min(len(a), len(b))
    width = _tables()["width"][:most]
    same = np.frombuffer(a[:least].encode(), np.uint8) == np.frombuffer(b[:least].encode(), np.uint8)
    share = float((width[:least] * same).sum() / width.sum())
    return max(0.0, (share - 1 / 16) / (15 / 16))


class _Doc:
    """A text with its walk."""

    def __init__(self, doc_id, text: str | None):
        self.id, self.text = doc_id, text or ""
        self.codes = codes_of(self.text)
        self.reached = walk(self.codes)
        self.print = sampled(self.codes, self.reached)

    def edited(self, other: _Doc) -> tuple:
        """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); see op10's contract."""
        n = len(self.codes)
        half = n // 2
        codes = np.concatenate([self.codes[: n - half], other.codes[:half]])
        reached = np.concatenate([self.reached[: n - half], walk(other.codes[:half], int(self.reached[n - half]))])
        text = self.text[: n - half] + other.text[:half]
        print_ = sampled(codes, reached)
        return n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), self.print, print_, likeness(self.print, print_), likeness(self.print, other.print)


FIELDS = [("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double")]
NOTHING = (None,) * len(FIELDS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text: no shuffle."""
    small_batches(docs.sparkSession)
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FIELDS: each text against its edit by the next document, by descending id.

    Texts are shuffled once, packed by zstandard, by ranges of the id. Each task streams its sorted
    rows, holding two. Its first and last row also go out with their texts (two
    rows a task); a small join pairs each last row with the next task's first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    one = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed_ = [squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(packed_, pa.binary())], names=["doc_id", "h", "z"])

    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ranged = one.mapInArrow(pack, f"doc_id {kind}, h long, z binary").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    schema = f"role int, part int, doc_id {kind}, text string, " + ", ".join(f"{n} {k}" for n, _, k in FIELDS)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), id_type, pa.string(), *(f[1] for f in FIELDS)]
        names = ["role", "part", "doc_id", "text", *(f[0] for f in FIELDS)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        here, held, open_ = TaskContext.get().partitionId(), None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc_id, z in zip(batch.column("doc_id").to_pylist(), batch.column("z").to_pylist(), strict=True):
                text = open_(z).decode("utf-8", "surrogatepass") if z else ""
                doc = _Doc(doc_id, text)
                if held is None:
                    out.append((1, here, doc_id, text, *NOTHING))
                else:
                    out.append((0, here, held.id, None, *held.edited(doc)))
                held = doc
            if out:
                yield packed(out)
        if held is not None:
            yield packed([(2, here, held.id, held.text, *NOTHING)])

    found = staged(ranged.mapInArrow(run, schema), "fingerprints")
    # One row a task: the task after each that had rows (the last one's is the first).
    firsts = found.where("role = 1").select("part", F.col("text").alias("next_text"))
    ids = firsts.select("part")
    follow = ids.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    ends = found.where("role = 2").select("part", "doc_id", "text").join(follow, "part").join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "next_text")

    def last(batches):
        for batch in batches:
            rows = [(doc_id, *_Doc(doc_id, a).edited(_Doc(None, b))) for doc_id, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [id_type, *(f[1] for f in FIELDS)], strict=True)], names=["doc_id", *(f[0] for f in FIELDS)])

    columns = ["doc_id", *(f[0] for f in FIELDS)]
    closed = ends.mapInArrow(last, f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, _, k in FIELDS))
    return found.where("role = 0").select(*columns).unionByName(closed.select(*columns))


def alike(prints: list[str], first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the pairs between two masks whose likeness is ``least`` or more."""
    most = max(map(len, prints))
    table = np.zeros((len(prints), most), np.uint8)
    for k, p in enumerate(prints):
        table[k, : len(p)] = np.frombuffer(p.encode(), np.uint8)
    sizes, width = np.array([len(p) for p in prints]), _tables()["width"][:most].astype(np.float32)
    total = np.concatenate([[0], np.cumsum(width)])
    left, right = [], []
    for i in range(len(prints)):
        share = ((table == table[i]) & (table[i] > 0)) @ width / np.maximum(total[np.maximum(sizes, sizes[i])], 1e-9)
        good = ((share - 1 / 16) / (15 / 16) >= least) & ((second & first[i]) | (first & second[i]))
        good[: i + 1] = False
        found = np.flatnonzero(good)
        left.append(np.full(len(found), i))
        right.append(found)
    return np.concatenate(left), np.concatenate(right)


def draws(bands: int, per_band: int) -> np.ndarray:
    """(samples, bands * per_band): row n - 1 has the samples that the bands of a fingerprint of n samples hold.

    A place of a band draws from all samples that a fingerprint has, each by its
    stretch of time (the least of exponential times). Of two fingerprints it draws
    the same sample, with equal bits, with probability the part of time in which they
    agree: wherever the edits are, and with unequal lengths.
    """
    width = _tables()["width"]
    times = np.random.default_rng(7).exponential(size=(len(width), bands * per_band)) / width[:, None]
    least = np.minimum.accumulate(times)
    at = np.where(times == least, np.arange(len(width))[:, None], 0)
    return np.maximum.accumulate(at)


def banded(prints: list[str], table: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """(fingerprints, bands) keys of fingerprints that are not empty."""
    values = np.zeros((len(prints), bands * per_band), np.uint64)
    for k, p in enumerate(prints):
        at = table[len(p) - 1]
        values[k] = at * 256 + np.frombuffer(p.encode(), np.uint8)[at]
    return band_keys(values, bands, per_band)


def near_copies(prints: DataFrame, least: float = 0.8, recall: float = 0.999, per_band: int = 8) -> DataFrame:
    """prints(doc_id, fingerprint, ..) with copy_id, class_id, n_links, as the Jaccard join has them.

    Bands hold draws() from the whole of a fingerprint; there are as many as let a pair
    at ``least`` share one with probability ``recall``. Equal fingerprints are one
    class; a band's classes are verified on whole fingerprints, and so are all pairs of
    what that links (so a pair that shares no band is found through others as well).
    Empty texts are alike only to each other.
    """
    small_batches(prints.sparkSession)
    bands = bands_for(1 / 16 + 15 / 16 * least, recall, per_band)
    prints = prints.withColumn("_node", F.unhex(F.md5(F.coalesce("fingerprint", F.lit("")))))
    classes = prints.groupBy(F.col("_node").alias("node")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min(F.coalesce("fingerprint", F.lit(""))).alias("fingerprint"))
    classes = staged(classes.withColumn("bytes", F.length("fingerprint").cast("long")), "classes")

    def run(batches):
        table = draws(bands, per_band)
        for batch in batches:
            keys = banded(batch.column("fingerprint").to_pylist(), table, bands, per_band)
            at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("fingerprint"), pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1)))], names=["node", "fingerprint", "bands"])

    keyed = classes.where("fingerprint <> ''").select("node", "fingerprint").mapInArrow(run, "node binary, fingerprint string, bands array<long>")
    found = staged(clusters(keyed, least, alike, "fingerprint"), "clusters")
    members = with_blocks(found, classes, "bytes", 1).join(classes.select("node", "fingerprint"), "node")
    checked = staged(joined(in_units(members, "fingerprint"), least, lambda batch: batch.column("fingerprint").to_pylist(), alike), "verified")
    info = by_node(classes, checked).select(F.col("node").alias("_node"), "copy_id", "class_id", "n_links")
    return prints.join(info, "_node").drop("_node")
