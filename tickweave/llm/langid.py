"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of the n-grams that are typical of it. The
filters are bit-sliced: position p of the table holds one bit for each language
(in words of 64), so one lookup (the AND over an n-gram's positions) returns all languages
that contain it. A text's bits are counted for each language, the counts are corrected
for the filters' false positives, and the largest decides.

Learning reads at most ``sample`` different labelled texts of each language (those with the
smallest hash of id and text) and keeps their ``grams_each`` most frequent n-grams of each
size; prediction reads every whole text and nothing else.

Defined cases: null text or a text without a letter is ``und`` with score 0; with
nothing learned every text is ``und``; repeated rows are predicted each and learned from
once; rows without an id are learned from as others; more than MOST languages are
an error (labels are then no languages); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches

SIZES = (2, 3, 4)
PROBES = 3
CHUNK = 400_000
#: Labels beyond which the column holds no languages.
MOST = 10_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LETTER: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0][codes]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the n-grams of codes, where 0 is a word boundary: it may be an n-gram's first or last place only."""
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = len(codes) - n + 1
    wide = codes.astype(np.uint64)
    h = np.full(end, np.uint64(n), np.uint64)
    for k in range(n):
        h = (h * M1) ^ (wide[k : k + end] + np.uint64(k + 1))
    full = codes != 0
    ok = full[:end] | full[1 : 1 + end] if n == 2 else np.ones(end, bool)
    for k in range(1, n - 1):
        ok &= full[k : k + end]
    at = np.flatnonzero(ok)
    h = h[at] * M2
    return at, h ^ (h >> np.uint64(29))


def pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, boundary-marked code points) of texts; a long text comes in pieces that share three places."""
    for k, text in enumerate(texts):
        if text:
            c = code_points(text.lower())
            c = np.concatenate([[0], np.where(letters(c), c, 0), [0]]).astype(np.uint32)
            for s in range(0, len(c), CHUNK):
                yield k, c[s : s + CHUNK + max(SIZES) - 1]


def laid_out(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code points, whether an n-gram may start there: not in what the next piece has as well) of pieces in a row."""
    gap = np.zeros(max(SIZES), np.uint32)
    codes = np.concatenate([x for _, c in held for x in (c, gap)])
    sizes = np.array([len(c) + len(gap) for _, c in held])
    owner = np.repeat(np.array([k for k, _ in held]), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return owner, codes, place < CHUNK


@dataclass
class Filters:
    """A learned model: languages, the bit-sliced table (words of languages, positions), each filter's false-positive rate."""

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """(words, n-grams): the languages that contain each n-gram, as bits."""
        top = np.uint64(self.table.shape[1] - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        found = self.table[:, h & top]
        for k in range(1, PROBES):
            found &= self.table[:, (h + np.uint64(k) * step) & top]
        return found

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, n-grams by language) of each text."""
        total, by = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            owner, codes, first = laid_out(held)
            for n in SIZES:
                at, h = grams(codes, n)
                at, h = at[first[at]], h[first[at]]
                who, mask = owner[at], self.lookup(h)
                total[:] += np.bincount(who, minlength=len(texts))
                for k in range(len(self.languages)):
                    by[:, k] += np.bincount(who[(mask[k // 64] >> self.table.dtype.type(k % 64)) & self.table.dtype.type(1) != 0], minlength=len(texts))
            held.clear()

        size = 0
        for k, c in pieces(texts):
            held.append((k, c))
            size += len(c)
            if size > CHUNK:
                flush()
                size = 0
        flush()
        return total, by

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, evidence): score is the winner's part of the two best corrected counts, evidence its part of all n-grams."""
        total, by = self.counts(texts)
        true = np.maximum(0.0, (by - total[:, None] * self.wrong) / (1 - self.wrong)) if self.languages else by
        names, score, evidence = [], np.zeros(len(texts)), np.zeros(len(texts))
        for k in range(len(texts)):
            if total[k] == 0 or not self.languages:
                names.append("und")
                continue
            best = int(np.argmax(true[k]))
            others = np.delete(true[k], best)
            second = others.max() if len(others) else 0.0
            names.append(self.languages[best])
            score[k] = true[k][best] / (true[k][best] + second) if true[k][best] > 0 else 0.0
            evidence[k] = min(1.0, true[k][best] / total[k])
        return names, score, evidence


def learn(docs: DataFrame, sample: int = 1500, min_count: int = 3, share: float = 0.25, grams_each: int = 300_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from labelled texts: at most ``sample`` of each language.

    An n-gram belongs to a language if it occurs ``min_count`` times in its sample
    and its rate there is ``share`` of its highest rate or more.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    # Ids are thinned by a hash first, so that a frequent language is not ranked whole in one task.
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()}
    if not counts:
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    if len(counts) > MOST:
        raise ValueError(f"more than {MOST} languages")
    part = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(2.0 * sample / n))]), F.col("lang"))
    hashed = named.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "text"))
    thin = hashed.select("lang", "h").where(F.pmod("h", F.lit(1_000_003)) < part * F.lit(1_000_003.0)).distinct()
    order = Window.partitionBy("lang").orderBy("h")
    chosen = thin.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("lang", "h")
    taken = hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # sample rows a language at most

    def count(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                held = list(pieces([t for t, x in zip(texts, langs, strict=True) if x == lang]))
                for n in SIZES if held else ():
                    _, codes, first = laid_out(held)
                    at, h = grams(codes, n)
                    h, times = np.unique(h[first[at]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.astype(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(times)], names=["lang", "h", "n", "times"])

    counted = taken.select("lang", "text").mapInArrow(lean(count), "lang string, h long, n int, times long").groupBy("lang", "n", "h").agg(F.sum("times").alias("times"))
    often = counted.where(F.col("times") >= min_count).withColumn("k", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("times"), "h")))
    rows = often.where(F.col("k") <= grams_each).drop("k").toPandas()  # languages * sizes * grams_each rows at most
    if not len(rows):
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    languages = sorted(rows["lang"].unique())
    rows["rate"] = rows["times"] / rows.groupby(["lang", "n"])["times"].transform("sum")
    rows = rows[rows["rate"] >= share * rows.groupby(["n", "h"])["rate"].transform("max")]
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    size = 1 << max(10, int(np.ceil(np.log2(16 * max(1, rows["lang"].value_counts().iloc[0])))))
    table = np.zeros((-(-len(languages) // 64), size), kind)
    for k, lang in enumerate(languages):
        h = rows.loc[rows["lang"] == lang, "h"].to_numpy().astype(np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for probe in range(PROBES):
            table[k // 64, (h + np.uint64(probe) * step) & np.uint64(size - 1)] |= kind(1 << k % 64)
    wrong = np.array([np.mean((table[k // 64] >> kind(k % 64)) & kind(1)) ** PROBES for k in range(len(languages))])
    return Filters([str(x) for x in languages], table, wrong)


def identify(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, evidence of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            names, score, evidence = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(evidence)], names=["doc_id", "lang_pred", "score", "evidence"])

    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return one.mapInArrow(lean(run), f"doc_id {one.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, evidence double")


def keep_identified(docs: DataFrame, model: Filters, least: float = 0.1, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with ``lang_col`` predicted, without those that are ``und`` or of which less than ``least`` of the n-grams are the language's: no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            names, _, evidence = model.predict(batch.column(text_col).to_pylist())
            keep = pa.array([k for k, (n, e) in enumerate(zip(names, evidence, strict=True)) if n != "und" and e >= least], pa.int64())
            cols = [pa.array(names, pa.string()) if c == lang_col else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).take(keep)

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(column: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0
