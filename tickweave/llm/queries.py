"""The registered queries opN_<name>: thin adapters from the driver's tables to the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, fingerprint, jaccard, langid, mixing, pii, quality, suffix_dedup, token_counts, url_reputation, whitening
from .common import staged, table


#: The key of the registered query; a production run passes its own secret.
PII_KEY = "surrogate-key-1"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(table(spark, sf_dir, "documents"))
    base = quality.judged(found, "base")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        (~base).alias("base_failed"), (base & quality.judged(found, "v2")).alias("kept"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's second use: what each rule of policy v2 rejects, and rejects alone."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")), "v2")


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The rules of the url query (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same number: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    out = url_reputation.judge_urls(pages, pages.join(labels, "page_id").select("url", "bad"), URL_RULES)
    return out.withColumn("bad_mean", F.round("bad_mean", 6)).withColumn("bad_lower", F.round("bad_lower", 6))


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = chat.format_chats(rows.unionByName(extra))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_texts(F.col("formatted"), F.col("loss_mask"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def op7_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "evidence")


def topic():
    """A plain topic of a text: its form."""
    text = F.coalesce("text", F.lit(""))
    return F.when(text.contains(" | "), "tables").when(text.contains("icense"), "licensed").when(text.contains("!!"), "shouting").when(F.length(text) < 500, "short").otherwise("prose")


#: Powers that flatten the token shares of the mixing query's dimensions, and the part of all tokens to draw.
MIX, MIX_PART = {"source": 0.7, "lang": 0.5, "topic": 0.7}, 0.5


def op8_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").withColumn("topic", topic()), MIX, MIX_PART)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: copy_id, class_id, n_links of fingerprints alike in 0.8 or more."""
    return fingerprint.near_copies(staged(fingerprint.with_edits(table(spark, sf_dir, "documents")), "edits"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: fit_chars, the code points of the longest prefix within the limit."""
    import public_tokenizers

    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 32)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_quality_ledger": op2_quality_ledger,
    "quality_ablations": quality_ablations,
    "op3_prefix_bpe": op3_prefix_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_host_reputation": op5_host_reputation,
    "op6_chat_round_trip": op6_chat_round_trip,
    "op7_language_bitmask": op7_language_bitmask,
    "op8_mix_to_targets": op8_mix_to_targets,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_edit_fingerprints": op10_edit_fingerprints,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_source_divergence": op13_source_divergence,
}

SPACE = r"[^\x20\x09-\x0D]"

_QUALITY_SQL = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACE}+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACE}')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
n AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS rep FROM n GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '\P{{Ll}}', '', 'g')) AS n_lower FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(quality.RULES))} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, failed & {quality.mask("base")} <> 0 AS base_failed, failed & {quality.mask("base") | quality.mask("v2")} = 0 AS kept FROM f"""

_V2 = ", ".join(f"('{rule}', {1 << k})" for k, (rule, _) in enumerate(quality.RULES) if rule in quality.POLICIES["v2"])
_ABLATION_SQL = f"""SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS failed, count(*) FILTER (WHERE failed & {quality.mask("v2")} = bit) AS rejected_alone,
  CAST(coalesce(sum(n_words) FILTER (WHERE failed & {quality.mask("v2")} = bit), 0) AS BIGINT) AS words_alone FROM ({_QUALITY_SQL}), (VALUES {_V2}) t(rule, bit) GROUP BY 1"""

_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{k}}}" for k, (_, h, p) in sorted(enumerate(URL_RULES), key=lambda r: -len(r[1][1] + r[1][2]))
) + " END"


def _strength_sql(level: str) -> str:
    """The moments of url_reputation.strength over a level's table."""
    return f"""(SELECT CASE WHEN k < 2 OR n <= k OR b <= 0 OR b >= n THEN 1000.0
  WHEN bw + (sz - 1) * wi <= 0 OR sz <= 0 OR (bw - wi) / (bw + (sz - 1) * wi) <= 0 THEN 1000.0
  ELSE least(1000.0, greatest(1.0, (1 - (bw - wi) / (bw + (sz - 1) * wi)) / ((bw - wi) / (bw + (sz - 1) * wi)))) END
  FROM (SELECT *, (b2n - n * (b / n) * (b / n)) / nullif(k - 1, 0) AS bw, (b - b2n) / nullif(n - k, 0) AS wi, (n - n2 / n) / nullif(k - 1, 0) AS sz
  FROM (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(n * n) AS DOUBLE) AS n2, sum(b * b / n) AS b2n FROM {level} WHERE n > 0)))"""


_URL_SQL = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
p AS (SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h0 AS (SELECT host, count(l.bad) AS n, coalesce(sum(l.bad), 0) AS b FROM p LEFT JOIN (SELECT doc_id, CAST(quality = 0 OR toxic = 1 AS INT) AS bad FROM labels) l ON l.doc_id = page_id GROUP BY 1),
h1 AS (SELECT *, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS parts FROM h0),
h2 AS (SELECT *, array_to_string(list_slice(parts, greatest(1, len(parts) - 1), len(parts)), '.') AS two FROM h1),
h AS (SELECT host, n, b, CASE WHEN array_to_string(parts, '.') SIMILAR TO '{url_reputation.ADDRESS[1:-1]}' THEN '(address)' WHEN regexp_matches(two, '{url_reputation.WIDE}') THEN two ELSE parts[len(parts)] END AS suffix,
  CASE WHEN array_to_string(parts, '.') SIMILAR TO '{url_reputation.ADDRESS[1:-1]}' THEN array_to_string(parts, '.') WHEN regexp_matches(two, '{url_reputation.WIDE}') THEN array_to_string(list_slice(parts, greatest(1, len(parts) - 2), len(parts)), '.') ELSE two END AS domain FROM h2),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(b) AS b FROM h GROUP BY 1), s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY 1),
k AS (SELECT {_strength_sql("h")} AS kh, {_strength_sql("d")} AS kd, {_strength_sql("s")} AS ks, (SELECT (sum(b) + 0.5) / (sum(n) + 1.0) FROM h) AS p0),
sm AS (SELECT suffix, (b + ks * p0) / (n + ks) AS ms FROM s, k), dm AS (SELECT domain, (b + kd * ms) / (n + kd) AS md FROM d JOIN sm USING (suffix), k),
ab AS (SELECT host, n, b + kh * md AS al, n - b + kh * (1 - md) AS be FROM h JOIN dm USING (domain), k),
q AS (SELECT host, n AS labelled, al / (al + be) AS m, greatest(0.0, al / (al + be) - 1.645 * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1)))) AS lo FROM ab)
SELECT page_id, host, path, {_RULE_SQL.format(*[f"'{h}{p}'" for _, h, p in URL_RULES])} AS rule, coalesce({_RULE_SQL.format(*[f"'{v}'" for v, _, _ in URL_RULES])}, CASE WHEN lo > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(labelled AS BIGINT) AS labelled, round(m, 6) AS bad_mean, round(lo, 6) AS bad_lower FROM p JOIN q USING (host)"""

_CHAT_SQL = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS er, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS et FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(er) + length(et)) AS BIGINT) AS formatted_chars, true AS round_trip FROM e GROUP BY 1"""

_JACCARD_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
lk AS (SELECT x, y FROM pr JOIN sz s ON s.doc_id = x JOIN sz t ON t.doc_id = y WHERE 5 * c >= 4 * (s.n + t.n - c)),
re AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT re.x, lk.y FROM re JOIN lk ON re.y = lk.x),
cl AS (SELECT x, min(y) AS class_id FROM re GROUP BY 1), nl AS (SELECT x, count(*) AS n FROM lk GROUP BY 1)
SELECT d.doc_id, CASE WHEN len(w) = 0 THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY w) END AS copy_id, class_id, coalesce(n, 0) AS n_links
FROM d JOIN cl ON cl.x = d.doc_id LEFT JOIN nl ON nl.x = d.doc_id"""

_DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS t FROM d), c AS (SELECT lang, source, t, count(*) AS n, count(DISTINCT r) AS docs FROM o GROUP BY ALL),
v AS (SELECT lang, t, CAST(sum(n) AS BIGINT) AS nl FROM c GROUP BY ALL HAVING sum(docs) >= 10), k AS (SELECT lang, source, t, n, nl FROM c JOIN v USING (lang, t)),
l AS (SELECT lang, count(*) AS nv, CAST(sum(nl) AS BIGINT) AS tot FROM v GROUP BY 1),
g AS (SELECT lang, source, coalesce(sz, 0) AS sz, coalesce(nv, 0) AS nv, coalesce(tot, 0) AS tot FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS sz FROM k GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, v.t, coalesce(k.n, 0) AS n, 1 + 1000000000 * (coalesce(k.n, 0) + 2) // (sz + 2 * nv) AS p, 1 + 1000000000 * (v.nl + 2) // (tot + 2 * nv) AS q
  FROM g JOIN v USING (lang) LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.t = v.t),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 10"""

#: DuckDB SQL of the same rows. The others learn, encode, hash or sort in ways that SQL
#: cannot state (or not at this size); tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_quality_ledger": _QUALITY_SQL,
    "quality_ablations": _ABLATION_SQL,
    "op5_host_reputation": _URL_SQL,
    "op6_chat_round_trip": _CHAT_SQL,
    "op9_ngram_jaccard": _JACCARD_SQL,
    "op13_source_divergence": _DIVERGENCE_SQL,
}
