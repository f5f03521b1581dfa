"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Sets are the hashes of a text's shingles of five words (a shorter text with words
is one shingle). Equal word sequences (by a 128-bit cryptographic digest) are one
class first. Rows and bands are chosen together: bands for the target recall at the
threshold, rows so that unlike texts meet least within a number of hashes.

Classes meet where a band hash is equal (a bucket). Buckets with the same members
count once. Each bucket compares its members' whole signatures; those that agree
as texts at the threshold do, but for five deviations, are linked, so a bucket that
unlike texts share links none of them. What is linked, directly or through others,
is a cluster. A cluster's full sets are sent in blocks (every pair of blocks is one
unit of work, bounded in rows and bytes), and all its pairs are verified, as join()
counts links. keep_one() needs classes only, and verifies no more pairs than settle
them (spanned). No pair is ever a row. Result: one row per document.

Defined cases: a text without words (null, empty) has no links and is its own
class; rows repeat as they come and count as copies of each other; a null id
stays null and never names a class unless all of the class are null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, parts, small_batches, staged
from .components import SALTS, components
from .shingles import digest, mixed, shingled, word_hashes, words_of

#: Rows and bytes of sets in one block of a unit; hashes of a signature.
BLOCK, BLOCK_BYTES, HASHES = 512, 8 << 20, 240


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands with which a pair at the threshold shares one with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def banding(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) for the recall within a number of hashes, with which pairs at half the threshold meet least."""
    fit = [(bands_for(threshold, recall, r), r) for r in range(1, 33)]
    fit = [x for x in fit if x[0] * x[1] <= hashes] or fit[:1]
    return min(fit, key=lambda x: 1 - (1 - (threshold / 2) ** x[1]) ** x[0])


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(len(sets), n) minima of n linear permutations over non-empty sets of hashes."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    out = np.empty((len(sets), n), np.uint64)
    s, k = 0, 0
    while s < len(sets):  # some 32,000 hashes at a time stay in cache
        size, k = 0, s
        while k < len(sets) and (k == s or size + len(sets[k]) <= 32_000):
            size += len(sets[k])
            k += 1
        x = np.concatenate(sets[s:k])
        at = np.concatenate([[0], np.cumsum([len(y) for y in sets[s : k - 1]])]).astype(np.int64)
        y = np.empty_like(x)
        for p in range(n):
            np.multiply(x, a[p], out=y)
            np.add(y, b[p], out=y)
            out[s:k, p] = np.minimum.reduceat(y, at)
        s = k
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys; different bands never share one on purpose."""
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), 1))
    for r in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::rows][:, :bands])
    return h.view(np.int64)


def signatures(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """docs(doc_id, tag, text) -> doc_id, tag, node (digest of the words; null: none), shingles, bands, sig (a byte a hash)."""
    small_batches(docs.sparkSession)
    bands, rows = banding(threshold, recall)

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            some = [k for k, w in enumerate(words) if w]
            nodes, sizes = [None] * len(words), [0] * len(words)
            sets = []
            for k in some:
                nodes[k] = digest(words[k])
                sets.append(shingled(word_hashes(words[k])))
                sizes[k] = len(sets[-1])
            minima = min_hashes(sets, bands * rows)
            keys = band_keys(minima, bands, rows)
            sigs: list = [None] * len(words)
            for k, row in zip(some, mixed(minima).astype(np.uint8), strict=True):
                sigs[k] = row.tobytes()
            at = np.zeros(len(words) + 1, np.int32)
            at[np.array(some, np.int64) + 1] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(keys.reshape(-1)))
            cols = [batch.column("doc_id"), batch.column("tag"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tag", "node", "shingles", "bands", "sig"])

    return docs.select("doc_id", "tag", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, node binary, shingles long, bands array<long>, sig binary")


def buckets(classes: DataFrame) -> DataFrame:
    """classes(node, bands) -> cluster (a band key), blocks, h, of buckets of two or more; those with the same members once.

    ``h`` is a short name of a node, only to find the way: who joins it back gets every node of that name.
    """
    rows = classes.select(F.explode("bands").alias("key"), F.xxhash64("node").alias("h")).repartition(parts(classes.sparkSession), "key")  # one exchange for both uses
    met = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b"), F.bit_xor("h").alias("x"), F.sum(F.pmod(F.xxhash64("h"), F.lit(1 << 30))).alias("y")).where("a <> b")
    once = met.groupBy("n", "a", "b", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return rows.join(once, "key").select(F.col("key").alias("cluster"), "blocks", "h")


def agreeing(sigs: list[bytes], first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the pairs between two masks whose signatures agree in a part of ``least`` or more, beyond chance."""
    table = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    need = (1 / 256 + 255 / 256 * least) * table.shape[1]
    left, right = [], []
    for i in range(len(sigs) - 1):
        good = (table[i + 1 :] == table[i]).sum(1) >= need
        good &= (second[i + 1 :] & first[i]) | (first[i + 1 :] & second[i])
        found = np.flatnonzero(good) + i + 1
        left.append(np.full(len(found), i))
        right.append(found)
    return np.concatenate(left), np.concatenate(right)


def clusters(classes: DataFrame, least: float, check=agreeing, sig: str = "sig") -> DataFrame:
    """classes(node, bands, sig) -> node, cluster: classes that a bucket links by ``check``, directly or through others."""
    met = staged(buckets(classes), "buckets").join(classes.select(F.xxhash64("node").alias("h"), "node", F.lit(1).cast("long").alias("copies"), sig), "h")
    links = joined(in_units(met, sig), least, lambda batch: batch.column(sig).to_pylist(), check)
    found = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = found.select("root").distinct().select(F.col("root").alias("node"), F.col("root").alias("cluster"))
    return found.select(F.col("u").alias("node"), F.col("root").alias("cluster")).unionByName(roots)


def with_blocks(found: DataFrame, classes: DataFrame, size: str, bytes_each: int = 8) -> DataFrame:
    """found(node, cluster) and classes(node, rep, copies, size) -> those, with the number of blocks of each cluster (by rows and bytes)."""
    members = found.join(classes.select("node", "rep", "copies", size), "node")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size) * bytes_each / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    return members.join(sizes, "cluster")


def verified(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs, i in ``first`` and j in ``second`` (masks), whose Jaccard is ``threshold`` or more; i < j if both masks are one."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(k), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((k, k), np.float32)
    wide = max(1, 4_000_000 // k)
    for s in range(0, int(often.sum()), wide):
        lo, hi = np.searchsorted(column, [s, s + wide])
        block = np.zeros((k, min(wide, int(often.sum()) - s)), np.float32)
        block[owner[lo:hi], column[lo:hi] - s] = 1.0
        common += block @ block.T
    union = sizes[:, None] + sizes[None, :] - common
    good = common >= threshold * union - 1e-6
    good &= (first[:, None] & second[None, :]) | (second[:, None] & first[None, :])
    return np.nonzero(np.triu(good, 1))


def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    lists = batch.column("set")
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [np.array(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def in_units(members: DataFrame, *columns: str) -> DataFrame:
    """members(cluster, blocks, node, copies, columns) once for each unit (pair of blocks i, j of a cluster) that they are in."""
    blocked = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", *columns)


def joined(rows: DataFrame, threshold: float, values=sets_of, check=None) -> DataFrame:
    """rows of in_units() -> node, root, links: all pairs of each unit by ``check`` (verified()), on what ``values`` reads from a batch."""
    check = check or verified

    def unit(held: list[tuple]):
        nodes, copies, sets, block = {}, [], [], []
        for b, node, n, values in held:
            if node not in nodes:
                nodes[node] = len(sets)
                copies.append(n)
                sets.append(values)
                block.append(b)
        return list(nodes), np.array(copies, np.int64), sets, np.array(block)

    def solve(key: tuple, held: list[tuple]):
        nodes, copies, sets, block = unit(held)
        i, j = check(sets, block == key[1], block == key[2], threshold)
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        root = np.arange(len(nodes))
        while True:  # least label along the links
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = links > 0
        at = np.flatnonzero(some)
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in at], pa.binary()), pa.array([nodes[root[k]] for k in at], pa.binary()), pa.array(links[at].astype(np.int64))], names=["node", "root", "links"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "node", "copies")]
            for c, i, j, block, node, n, value in zip(*cols, values(batch), strict=True):
                if (c, i, j) != key:
                    if len(held) > 1 and (out := solve(key, held)) is not None:
                        yield out
                    key, held = (c, i, j), []
                held.append((block, node, n, value))
        if len(held) > 1 and (out := solve(key, held)) is not None:
            yield out

    width = parts(rows.sparkSession)
    return rows.repartition(width, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lean(run), "node binary, root binary, links long")


def by_node(classes: DataFrame, checked: DataFrame) -> DataFrame:
    """classes(node, rep, copies) and joined()'s rows -> node, root, copy_id, class_id (least rep of all linked), n_links (documents)."""
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    every = classes.select("node", "rep", "copies").join(links, "node", "left")
    n = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    alone = every.where("links is null").select("node", F.col("node").alias("root"), F.col("rep").alias("copy_id"), F.col("rep").alias("class_id"), n)
    linked = every.where("links is not null").join(groups.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A large group's root is a hot key: its members are dealt out by salts.
    least = linked.groupBy("root").agg(F.min("rep").alias("class_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"])
    return dealt.select("node", "root", F.col("rep").alias("copy_id"), "class_id", n).unionByName(alone)


def prepared(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, tag, node; classes: node, rep, copies, ..; the full sets of what is in a cluster: node, cluster, blocks, copies, set)."""
    text = F.col(text_col).cast("string")
    one = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    signed = staged(signatures(one, threshold, recall), "signatures")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    classes = signed.where("node is not null").groupBy("node").agg(F.min(at).alias("at"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = staged(classes.select("node", F.col("at.doc_id").alias("rep"), F.col("at.tag").alias("rep_tag"), "copies", "shingles", "bands", "sig"), "classes")
    n = math.prod(banding(threshold, recall))
    found = staged(clusters(classes, threshold - 5 * math.sqrt(threshold * (1 - threshold) / n)), "clusters")
    members = with_blocks(found, classes, "shingles").join(classes.select("node", "rep_tag"), "node")
    # The small side of each partition is hashed, so whole texts are not sorted.
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tag") == F.col("rep_tag"))
    texts = one.join(members.hint("shuffle_hash"), same).select("text", "node", "cluster", "blocks", "copies")

    def sets(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            nodes = batch.column("node").to_pylist()
            keep = [k for k, w in enumerate(words) if w and digest(w) == nodes[k]]
            values = [np.unique(shingled(word_hashes(words[k]))).view(np.int64) for k in keep]
            at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            kept = batch.take(pa.array(keep, pa.int64())).drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=[*kept.schema.names, "set"])

    return signed.select("doc_id", "tag", "node"), classes, texts.mapInArrow(lean(sets), "node binary, cluster binary, blocks int, copies long, set array<long>")


def solved(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, tag, node; classes: node, root, copy_id, class_id, n_links): all pairs of a cluster, as links are counted."""
    signed, classes, shipped = prepared(docs, threshold, recall, id_col, text_col)
    checked = staged(joined(in_units(shipped, "set"), threshold), "verified")
    return signed, by_node(classes, checked)


#: Rows of nodes or clusters (some 64 bytes each) up to which they are broadcast; more are joined by a shuffle.
FEW = 200_000


def _few(df: DataFrame, name: str) -> DataFrame:
    """df, written and counted: to be broadcast if it is short, so that what it picks from large sets moves no others."""
    kept = staged(df, name)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def _blocked(members: DataFrame) -> DataFrame:
    """members(cluster, node, copies, set) with the number of blocks of what is there of each cluster."""
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("set")) * 8 / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    return members.join(_few(sizes, "blocks"), "cluster")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members(node, cluster) with ``label``, the root of what links reach."""
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "node")
    return staged(members.join(roots, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("label")), "labels")


def spanned(shipped: DataFrame, threshold: float) -> DataFrame:
    """node, label: the components of all links within clusters, from as few verified pairs as settle them.

    Whether two texts are in one component is known without their own pair once others link them. So
    first each block of a cluster is verified in itself (a set is shipped once), then the best linked text of each
    component of a block with those of the others. Only in clusters that are still in parts, all
    pairs between the greatest part and the rest, and within the rest, are verified.
    """
    sets = staged(shipped, "sets")
    members = sets.select("node", "cluster")
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own = sets.select("cluster", at.alias("i"), at.alias("j"), at.alias("block"), "node", "copies", "set")
    first = staged(joined(own, threshold), "own-blocks")
    parts_ = members.join(first, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("part"), F.coalesce("links", F.lit(0)).alias("links"))
    best = parts_.groupBy("cluster", "part").agg(F.max_by("node", F.struct("links", "node")).alias("node"))
    several = best.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    heads = staged(sets.drop("blocks").join(_few(best.join(several, "cluster").select("node"), "heads"), "node"), "heads")
    second = staged(joined(in_units(_blocked(heads), "set"), threshold), "heads-verified")
    labels = _labelled(members, first.unionByName(second))
    sizes = labels.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    split = sizes.groupBy("cluster").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", "label")).alias("most")).where("parts > 1").select("cluster", "most")
    if split.isEmpty():
        return labels.select("node", "label")
    parted = labels.join(split, "cluster").select("node", (F.col("label") == F.col("most")).alias("main"))
    split_sets = staged(sets.drop("blocks").join(_few(parted, "parted"), "node"), "parted-sets")
    rest = _blocked(split_sets.where("not main").drop("main"))
    main = _blocked(split_sets.where("main").drop("main"))
    # Units of a block of the rest (i) and one of the main part (j, counted from -1 down).
    many = main.groupBy("cluster").agg(F.first("blocks").alias("main_blocks"))
    few = rest.groupBy("cluster").agg(F.first("blocks").alias("rest_blocks"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = rest.join(_few(many, "main-blocks"), "cluster").withColumn("i", at).withColumn("j", F.explode(F.transform(numbers("main_blocks"), lambda k: -1 - k))).withColumn("block", F.col("i"))
    right = main.join(_few(few, "rest-blocks"), "cluster").withColumn("j", -1 - at).withColumn("i", F.explode(numbers("rest_blocks"))).withColumn("block", F.col("j"))
    units = [x.select("cluster", "i", "j", "block", "node", "copies", "set") for x in (left, right, in_units(rest, "set"))]
    third = joined(units[0].unionByName(units[1]).unionByName(units[2]), threshold)
    return _labelled(members, reduce(DataFrame.unionByName, [first, second, staged(third, "rest-verified")])).select("node", "label")


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy_id (least id with the same words), class_id (least id of all linked, directly or through others), n_links (other documents at the threshold or above)."""
    signed, info = solved(docs, threshold, recall, id_col, text_col)
    kind = signed.schema["doc_id"].dataType.simpleString()
    linked = signed.where("node is not null").join(info, "node").select("doc_id", "copy_id", "class_id", "n_links")
    own = F.col("doc_id").cast(kind)
    alone = signed.where("node is null").select("doc_id", own.alias("copy_id"), own.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class, with all its columns: that of the least id (null ids last), then the least digest of the text.

    Rows are told apart by id and text, so a repeated or null id loses no text; of
    rows equal in both one stays. Rows without words stay all.
    """
    signed, _, shipped = prepared(docs, threshold, recall, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    rooted = signed.where("node is not null").join(spanned(shipped, threshold), "node", "left").withColumn("root", F.coalesce("label", "node"))
    best = rooted.groupBy("root").agg(F.min(order).alias("at"))
    kept = staged(best.select(F.col("at.doc_id").alias("_id"), F.col("at.tag").alias("_tag")).distinct(), "kept")
    # How often the row that stays is there: only if any repeats are texts grouped.
    same = signed.where("node is not null").groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.count("*").alias("n")).where("n > 1")
    again = not same.join(kept, same["_id"].eqNullSafe(kept["_id"]) & (same["_tag"] == kept["_tag"]), "left_semi").isEmpty()
    words = F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]")
    tagged = docs.withColumn("_tag", F.xxhash64(F.col(text_col).cast("string")))
    some = tagged.where(words).alias("d").join(kept.alias("k").hint("shuffle_hash"), F.col(f"d.{id_col}").eqNullSafe(F.col("k._id")) & (F.col("d._tag") == F.col("k._tag")), "left_semi")
    if again:
        some = some.dropDuplicates([id_col, "_tag"])
    return some.drop("_tag").unionByName(docs.where(~F.coalesce(words, F.lit(False))))
