"""Entities of every pair of kinds side by side: both are found whole and nothing of either is left."""

from pyspark.sql import functions as F

from tickweave.llm import pii

ENTITIES = [
    "bob.smith@mail8.example.com", "99bob@x.org", "password=b7db7aa4a5fcc78305", "API_KEY: AbC_dEf-123456", "DE89370400440532013000",
    "GB82 WEST 1234 5698 7654 32", "ES9121000418450200051332", "190.137.223.204", "10.0.0.1", "123-45-6789", "4041894974608795",
    "4041 8949 7460 8795", "4041-8949-7460-8795", "+1 (826) 555-4081", "+44 20 7946 0958", "+49 (30) 1234 5678", "(918) 555-1234",
    "826-555-4081", "Mr Bob Smith", "Frau SMITH", "Госпожа Анна Иванова",
]
ALONE = [
    "+33 1 23 45 67 89", "+33.1.23.45.67.89", "+44 (0)20 7946 0958", "+44 (0131) 496 0000", "+18265554081", "+1-826-555-4081", "+7 495 123-45-67", "+47 12.34.56.78", "+45 12 34 56 78",
    "+49 30 12345678", "+358 40 123 4567", "+86 138 0013 8000", "+1 555-4081", "XX12 3456 7890 1234 5678 9012", "DE12 3456 7890 1234 56", "4041 8949 7460 8795 123", "3782 822463 10005",
]


def test_entities_side_by_side(spark):
    rows = [(a, b, a + between + b) for a in ENTITIES for b in ENTITIES for between in (" ", ", ", "\n")]
    said = spark.createDataFrame(rows, "a string, b string, text string").select("a", "b", "text", pii.mentions(F.col("text")).alias("m")).collect()
    assert not [(r["text"], r["m"]) for r in said if r["m"] != [r["a"], r["b"]]]
    lone = [(t, [t]) for t in ENTITIES + ALONE] + [(f"{p} 2024", [p]) for p in ("+1 (826) 555-4081", "+44 20 7946 0958")] + [("+39 190.137.223.204", ["190.137.223.204"]), ("Prof. Dr. Müller", ["Dr. Müller"])]
    got = {r["text"]: r["m"] for r in spark.createDataFrame([(t,) for t, _ in lone], "text string").select("text", pii.mentions(F.col("text")).alias("m")).collect()}
    assert got == dict(lone)


def test_a_phone_before_an_address_is_the_same_phone(spark):
    rows = [(1, "+1 (826) 555-4081 190.137.223.204 du"), (2, "call +1 (826) 555-4081."), (3, "at 190.137.223.204")]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert got[1] == f"{got[2][5:-1]} {got[3][3:]} du" and ".137.223.204" not in got[1]


def replaced(spark, *texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    return [r["text"] for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit(1)), "key").orderBy("doc_id").collect()]


def test_a_person_is_one_person(spark):
    a, b, c = replaced(spark, "Mr John Smith called. Later John Smith left, said Smith. SMITH! Smithson", "Dr Anna Weber; Mrs Anna Weber; Anna", "Mr Smith and Dr John Weber")
    first, last = a.split()[1:3]
    assert a == f"Mr {first} {last} called. Later {first} {last} left, said {last[:-1] if last.endswith('.') else last}. {last.upper()}! Smithson"
    w = b.replace(";", "").split()
    assert w[1:3] == w[4:6] and w[6] == w[1] and w[1].endswith("a")
    assert c.split()[1] == last and c.split()[-1] == w[2] and c.split()[-2] == first


def test_phones_are_read_by_the_numbering_plan(spark):
    one = lambda t: "".join(x for x in t if x.isdigit())
    a, b, c, d, e, f = map(one, replaced(spark, "+491511234567", "+49 1511234567", "+1 (826) 555-4081", "(826) 555-4081", "+44 (0)20 7946 0958", "+44 20 7946 0958"))
    assert a == b and a.startswith("49") and c == "1" + d and e == "440" + f[2:] and f.startswith("44")


def test_plain_numbers_stay(spark):
    assert replaced(spark, "order 4041894974608796 of 1234567890123") == ["order 4041894974608796 of 1234567890123"]


def test_a_full_format_ends_with_distinct_surrogates(spark):
    found = spark.range(10_000).select(F.lit("ip").alias("kind"), F.concat_ws(".", *[(F.col("id") / 10**k % 10).cast("int") for k in range(4)]).alias("canon"))
    tries = pii.attempts_table(found, "k")
    assert tries.where(f"attempt < {pii.EASY}").isEmpty()
    new = tries.select(pii.surrogate("k", F.col("kind"), F.col("canon"), F.col("attempt")).alias("s"))
    assert new.distinct().count() == 10_000 and new.join(found, new["s"] == found["canon"]).isEmpty()
