"""How far the sources of a language differ in their words, exactly, in integers.

A group is a (lang, source) that occurs; its distribution over the language's kept terms
is smoothed and scaled to integers p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Two
distributions are compared by f = floor((p - q)^2 / (p + q)), term by term.

Counting: tasks count the words of their documents by group and hand on one row for
each (group, term) they met; these are summed in a shuffle by (lang, source, term).

Pairs of sources: the kept terms of a language are dealt to chunks, and each group's
counts in a chunk are packed into one row. Groups are cut into blocks. A packed row is
replicated to the tiles (its block by every block), and the task of a tile goes through the
chunks one after the other, holding two blocks of one chunk, and adds up the
tile's submatrix. Long runs of chunks are tiles of their own, summed at the end. Terms of
chunks that no group of a tile has all have the same f: they are multiplied, not listed.

Defined cases: null text, lang and source are ''; repeated rows are documents of their
own, and so are rows of one id; a language none of whose terms is frequent enough has
value 0 for all pairs and no terms; a language with one source has no pairs; ties rank by
the item's UTF-8 bytes; an empty table gives no rows; other columns are ignored.
Words of one text are held in memory at once; texts are never cut.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, staged

#: Terms of a language in one chunk (about), chunks in one tile, groups in one block.
CHUNK, RUN, BLOCK = 4096, 64, 16
#: Distinct (group, term) pairs that a counting task holds before it hands them on.
HELD = 400_000
#: A table of groups up to so many bytes is broadcast; a larger one is joined by a shuffle.
SMALL = 8 << 20
#: Terms are runs of letters A-Z and of everything beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    plain = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    return docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))


def term_counts(plain: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents of the group that have it) of texts()."""
    small_batches(plain.sparkSession)

    def rows(held: dict):
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode() for t in some]), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*[batch.column(c) for c in ("lang", "source", "text")], strict=True):
                # Of UTF-8 bytes, lower() changes A-Z only.
                found = TERM.findall(text.as_py().encode().lower())
                n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
                held.clear()
        yield from rows(held)

    parts = plain.mapInArrow(lean(count), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = 10) -> DataFrame:
    """Counts of terms in at least ``least`` documents of their language, with n_lang (occurrences there) and ``first`` (one row of each term)."""
    w = Window.partitionBy("lang", "term")
    got = counts.select("lang", "source", "term", "n", F.sum("docs").over(w).alias("docs"), F.sum("n").over(w).alias("n_lang"), (F.min("source").over(w) == F.col("source")).alias("first"))
    return got.where(F.col("docs") >= least).drop("docs")


def groups(plain: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, g (number in the language, from 0), size (N of the group), lang_size, terms (V), groups (in the language)."""
    of = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count(F.when(F.col("first"), 1)).alias("terms"))
    every = plain.select("lang", "source").distinct().join(of, ["lang", "source"], "left").join(lang, "lang", "left").fillna(0, ["size", "lang_size", "terms"])
    w = Window.partitionBy("lang")
    return every.withColumns({"g": F.row_number().over(w.orderBy("source")) - 1, "groups": F.count("*").over(w).cast("int")})


def joined(rows: DataFrame, every: DataFrame) -> DataFrame:
    """rows with what is known of their group."""
    size = every.agg(F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 64), F.lit(0))).first()[0]
    return rows.join(F.broadcast(every) if size <= SMALL else every, ["lang", "source"])


def scaled(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (size + 2 terms)), by long division: no product leaves 64 bits below 9 * 10^15 words."""
    div = lambda a, b: F.call_function("div", a, b)
    a, m = count + F.lit(2), size + F.lit(2) * terms
    out, rest = div(a, m), F.pmod(a, m)
    for _ in range(3):
        rest = rest * F.lit(1000)
        out, rest = out * F.lit(1000) + div(rest, m), F.pmod(rest, m)
    return out + F.lit(1)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def scaled_array(count: np.ndarray, size: int, terms: int) -> np.ndarray:
    """scaled() of an array."""
    m = size + 2 * terms
    out, rest = np.divmod(count + 2, m)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, m)
        out = out * 1000 + more
    return out + 1


def packed(kept: DataFrame, every: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """lang, g, groups, chunk, width (terms of the chunk), at, n: a group's counts in a chunk of its language's terms."""
    dealt = joined(kept, every).withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / chunk)).cast("int"))
    w = Window.partitionBy("lang", "chunk")
    placed = dealt.withColumn("at", F.dense_rank().over(w.orderBy("term")) - 1).withColumn("width", F.max("at").over(w) + 1)
    cells = placed.groupBy("lang", "chunk", "g").agg(F.collect_list(F.struct("at", "n")).alias("c"), F.first("width").alias("width"), F.first("groups").alias("groups"))
    return cells.select("lang", "g", "groups", "chunk", "width", F.col("c.at").alias("at"), F.col("c.n").alias("n"))


def to_tiles(rows: DataFrame, block: int) -> DataFrame:
    """Each row to all tiles of its block: (its block, block) from it on and (block, its block) up to it."""
    own, last = F.floor(F.col("g") / block).cast("int"), F.floor((F.col("groups") - 1) / block).cast("int")
    tile = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.least(b, own).alias("bi"), F.greatest(b, own).alias("bj")))
    return rows.withColumn("_t", F.explode(tile)).select("*", "_t.bi", "_t.bj").drop("_t")


class Tile:
    """The submatrix of two blocks of groups."""

    def __init__(self, lang: str, bi: int, bj: int, block: int):
        self.lang, self.bi, self.bj, self.block = lang, bi, bj, block
        self.known: dict[int, tuple[str, int]] = {}  # g -> source, size
        self.terms, self.seen, self.chunk = 0, 0, -1
        self.cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.width = 0
        self.total: np.ndarray | None = None

    def sides(self) -> tuple[list[int], list[int]]:
        return tuple([g for g in sorted(self.known) if g // self.block == b] for b in (self.bi, self.bj))

    def close_chunk(self) -> None:
        """Add the chunk that is at hand."""
        if not self.cells:
            return
        left, right = self.sides()
        p = {}
        for g in self.known:
            count = np.zeros(self.width, np.int64)
            if g in self.cells:
                at, n = self.cells[g]
                count[at] = n
            p[g] = scaled_array(count, self.known[g][1], self.terms)
        if self.total is None:
            self.total = np.zeros((len(left), len(right)), np.int64)
        other = np.stack([p[h] for h in right])
        for k, g in enumerate(left):
            gap = other - p[g]
            self.total[k] += (gap * gap // (other + p[g])).sum(axis=1)
        self.seen += self.width
        self.cells = {}

    def rows(self):
        """(lang, source, item, value, seen, rest, terms) both ways; rest: the f of a term that neither group has."""
        self.close_chunk()
        left, right = self.sides()
        zero = {g: int(scaled_array(np.zeros(1, np.int64), size, self.terms)[0]) if self.terms else 0 for g, (_, size) in self.known.items()}
        for i, g in enumerate(left):
            for j, h in enumerate(right):
                if g == h or (self.bi == self.bj and g > h):
                    continue
                value = 0 if self.total is None else int(self.total[i, j])
                rest = (zero[g] - zero[h]) ** 2 // (zero[g] + zero[h]) if self.terms else 0
                a, b = self.known[g][0], self.known[h][0]
                yield self.lang, a, b, value, self.seen, rest, self.terms
                yield self.lang, b, a, value, self.seen, rest, self.terms


PAIRS = "lang string, source string, item string, value long, seen long, rest long, terms long"


def pair_sums(every: DataFrame, cells: DataFrame, block: int = BLOCK, run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """lang, source, item (another source), value: f summed over all kept terms of the language."""
    about = every.select("lang", "g", "groups", F.lit(-1).alias("chunk"), F.lit(0).alias("width"), F.array().cast("array<int>").alias("at"), F.array().cast("array<bigint>").alias("n"), "source", "size", "terms")
    runs = F.greatest(F.ceil(F.ceil(F.col("terms") / chunk) / run), F.lit(1)).cast("int")
    about = about.withColumn("run", F.explode(F.sequence(F.lit(0), runs - 1)))
    vectors = cells.withColumn("run", F.floor(F.col("chunk") / run).cast("int"))
    sent = to_tiles(about.unionByName(vectors, allowMissingColumns=True), block)
    key = ["lang", "bi", "bj", "run"]
    # The rows of a tile follow one another, groups' descriptions first, then chunk by chunk.
    tiles = sent.repartition(*key).sortWithinPartitions(*key, "chunk", "g")

    def submatrices(batches):
        tile, at_key, out = None, None, []

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.string()] * 3 + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "source", "item", "value", "seen", "rest", "terms"])

        for batch in batches:
            one = {c: batch.column(c).to_pylist() for c in (*key, "chunk", "g", "width", "source", "size", "terms")}
            lists = {c: batch.column(c) for c in ("at", "n")}
            for k in range(batch.num_rows):
                now = tuple(one[c][k] for c in key)
                if now != at_key:
                    if tile:
                        out += tile.rows()
                        yield flush()
                        out = []
                    tile, at_key = Tile(now[0], now[1], now[2], block), now
                g, c = one["g"][k], one["chunk"][k]
                if c < 0:
                    tile.known[g], tile.terms = (one["source"][k], one["size"][k]), one["terms"][k]
                    continue
                if c != tile.chunk:
                    tile.close_chunk()
                    tile.chunk, tile.width = c, one["width"][k]
                tile.cells[g] = tuple(lists[x][k].values.to_numpy(zero_copy_only=False) for x in ("at", "n"))
        if tile:
            out += tile.rows()
            yield flush()

    parts = tiles.select(*key, "chunk", "g", "width", "source", "size", "terms", "at", "n").mapInArrow(lean(submatrices), PAIRS)
    got = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), (F.max("terms") - F.sum("seen")).alias("unseen"), F.max("rest").alias("rest"))
    return got.select("lang", "source", "item", (F.col("value") + F.col("unseen") * F.col("rest")).alias("value"))


def term_values(kept: DataFrame, every: DataFrame) -> DataFrame:
    """lang, source, item (a term more usual in the group than in its language), value."""
    p = scaled(F.col("n"), F.col("size"), F.col("terms"))
    q = scaled(F.col("n_lang"), F.col("lang_size"), F.col("terms"))
    got = joined(kept.where("n > 0"), every).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    return got.where("p > q").select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = 10, top: int = 10, block: int = BLOCK, run: int = RUN, chunk: int = CHUNK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all other sources by distance, and the ``top`` terms that set a source apart."""
    plain = texts(docs, text_col, lang_col, source_col)
    kept = staged(kept_terms(term_counts(plain), least), "terms")
    every = staged(groups(plain, kept), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    cells = staged(packed(kept, every, chunk), "packed")
    pairs = pair_sums(every, cells, block, run, chunk).withColumn("rank", rank)
    terms = term_values(kept, every).withColumn("rank", rank).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
