"""Secrets of any characters, keys of services, spaced numbers, names that are words, control characters."""

import random

from pyspark.sql import functions as F

from tickweave.llm import pii


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.replace(df, "key").orderBy("doc_id").collect()]


KEY = "AKIA" + "IOSFODNN7EXAMPLE"
GH = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"


LEFT = [
    ("password=p@ssw0rd!", ["p@ssw0rd", "ssw0rd"], "password="),
    ("password: Tr0ub4dor&3xyz! then", ["Tr0ub4dor", "3xyz"], " then"),
    ("the api_key = 'x#1$yz%&99()', ok", ["x#1$yz"], ", ok"),
    (f"use {KEY} now", [KEY, KEY[4:]], "use AKIA"),
    (f"{GH}.", [GH, GH[4:]], "ghp_"),
    ("from 2001:db8:85a3::8a2e:370:7334 to fe80:0:0:0:1:2:3:4b", ["2001:db8", "7334", "fe80"], "from "),
    ("SSN 123 45 6789, SSN: 123-45-6789", ["123 45 6789", "123-45-6789"], "SSN "),
]


def test_nothing_is_left(spark):
    for (text, gone, stays), out in zip(LEFT, replaced(spark, *[x[0] for x in LEFT]), strict=True):
        assert not any(g in out for g in gone) and stays in out and len(out) == len(text), out


def test_mentions_agree(spark):
    a, b, c, d = replaced(spark, f"key {GH}", f"token={GH}, SSN 123 45 6789", "at 2001:DB8::1 and 2001:db8::1", "123-45-6789")
    assert a[4:] == b[6 : 6 + len(GH)] and b[-11:].replace(" ", "-") == d
    assert c[3:14] == c[-11:] and c[7] == ":"


def test_plain_text_stays(spark):
    plain = ["at 12:30:45 and 1:2", "std::vector a::b", "00:1a:2b:3c:4d:5e", "room 123 45 6789", "password: short", "ask-a-long-question-about-words-here", "Token of love: yes"]
    assert replaced(spark, *plain) == plain


def test_words_that_are_names(spark):
    a, b, c = replaced(spark, "Mr Will Page wrote. Will you turn the leaf? Page 3.", "Mr Will Page wrote. Will Page left with Will. WILL!", "Mr Jon Smith wrote. Smith left.")
    first, last = a.split()[1:3]
    assert a == f"Mr {first} {last} wrote. Will you turn the leaf? Page 3."
    assert b == f"Mr {first} {last} wrote. {first} {last} left with {first}. {first.upper()}!"
    assert "Smith" not in c and "Jon" not in c


def test_control_characters_switch_nothing_off(spark):
    text = "Mr John Smith\x00\x01 said \x01\x00John\x00 Smith \x01\x02\x03."
    out = replaced(spark, text)[0]
    assert "John" not in out and "Smith" not in out
    name = out.split("\x00")[0].split()
    assert out == text.replace("John", name[1]).replace("Smith", name[2])


def test_empty_table_and_a_very_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.replace(empty, "key").count() == 0
    rng = random.Random(1)
    parts = [f"word{rng.randint(0, 9)} mail a{k}@x{k % 7}.org or 190.137.{k % 250}.{k % 240}; " for k in range(20_000)]
    df = spark.createDataFrame([(1, "".join(parts))], "doc_id long, text string")
    got = pii.replace(df, "key").first()
    assert got["n_entities"] == 40_000 and len(got["text"]) == len("".join(parts)) and "a77@x0.org" not in got["text"]


def test_distinct_forms_have_distinct_surrogates(spark):
    found = spark.range(3000).select(F.lit("ip6").alias("kind"), F.concat(F.lit("fe80::"), F.lower(F.hex("id"))).alias("canon"))
    tries = pii.attempts_table(found, "k")
    base = found.withColumn("attempt", F.lit(0)) if tries is None else found.join(tries, ["kind", "canon"], "left").fillna(0, ["attempt"])
    assert base.select(pii.surrogate("k", F.col("kind"), F.col("canon"), F.col("attempt")).alias("s")).distinct().count() == 3000
