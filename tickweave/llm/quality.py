"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger stores the
measurements and one bit for each rule (1: failed). Policies are versioned bit
masks over the ledger, so a new policy or an ablation needs no second look at
the texts. Everything is DataFrame expressions.

Defined cases: a null text counts as no text (no words, no lines); rows repeat
as they come, a null id stays null; other input columns are ignored; an empty
table gives an empty ledger. Words are runs of characters outside
``[\\x20\\x09-\\x0D]``, so every whole text is used whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8

#: Bit -> (name, what failing means). The bit numbers never change meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("no_lower_case", "n_words >= 20 and 100 * n_lower < 20 * word_chars"),
]

#: Version -> rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "word_length"],
    "v2": ["few_words", "repeated_words", "symbols", "word_length", "repeated_lines", "no_lower_case"],
}


def mask(policy: str) -> int:
    """The bits of a policy version."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and the measurements that the rules read."""
    one = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    split = one.select(
        "doc_id",
        F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"\P{Ll}+", "")).cast("long").alias("n_lower"),
    )
    n = F.size("_w")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lower",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    # Only texts with a repeated window are sorted: (hash, place), neighbours compared.
    ordered = hashed.withColumn(
        "_p",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("_h")

    def place(x: Column, k: Column) -> Column:
        same = F.coalesce(F.get("_p", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_p", k + 1)["h"] == x["h"], F.lit(False))
        return F.when(same, x["i"])

    places = ordered.withColumn("_q", F.sort_array(F.filter(F.transform("_p", place), lambda x: x.isNotNull()))).drop("_p")
    covered = F.transform("_q", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_q", k + 1) - x, F.lit(WINDOW))))
    return places.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_q")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: measurements and ``failed`` (bit k: rule k failed)."""
    bits = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, id_col, text_col).withColumn("failed", bits)


def judged(found: DataFrame, policy: str) -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(found: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many only it rejects.

    The ledger is first summed by bit pattern (at most 2 ** rules rows).
    """
    m = F.lit(mask(policy)).cast("long")
    patterns = found.groupBy(F.col("failed").bitwiseAND(m).alias("bits")).agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    names = [name for name, _ in RULES]
    rules = F.explode(F.array(*[F.struct(F.lit(1 << names.index(r)).cast("long").alias("bit"), F.lit(r).alias("rule")) for r in POLICIES[policy]])).alias("r")
    return (
        patterns.select("bits", "n", "words", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("words")).otherwise(0)).alias("words_alone"),
        )
    )
