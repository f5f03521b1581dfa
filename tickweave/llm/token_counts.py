"""Exact token counts of every prefix of a text, for byte-level BPE.

For every prefix of a pre-token, dynamic programming finds the one last token of its
encoding (as in ``bpe``), and with it the number of tokens: that of the prefix without
its last token, plus one. A text's table is made of its pre-tokens' tables and the
counts up to their starts; where the pre-tokenizer would cut a prefix otherwise than
the whole text (runs of white space, contractions, special tokens' strings cut short),
the entry is that of the prefix. So "how many tokens has the text up to here" and "how
much of it fits into a budget" are look-ups; nothing is encoded again.

The counts are those of the vocabulary file (tokenizers format) without added special
tokens; special tokens' strings in a text count as one token each.

Defined cases: null text is empty and has 0 tokens; repeated rows are counted each;
other columns are ignored, whatever their names; an empty table gives no rows; a very
long pre-token is counted like any other, but its table is not kept; a vocabulary of
another kind is an error. Counts are of whole code points: a prefix that ends within
one is no text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PrefixBpe, SuffixAutomaton, byte_symbols, read_spec
from .common import CACHES, lean, small_batches

#: Pre-tokens whose tables a Python worker keeps, in each of two generations, and the longest of them.
KEPT_TABLES, KEPT_LENGTH = 250_000, 64
KEPT_PAIRS = 600_000
#: Beginnings of pre-tokens whose tables are kept: their length in bytes, and how many.
HEAD, KEPT_HEADS = 7, 100_000
_MADE: dict[str, TokenCounter] = {}
CACHES["token_counts"] = _MADE.clear

#: The byte-level pre-tokenizer's pattern over classes of letters and numbers, and white space as it knows it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
ASCII = re.compile(PATTERN.format(L="[A-Za-z]", N="[0-9]", l="A-Za-z", n="0-9"), re.ASCII)
UNICODE = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
CUT_SHORT = ("'re", "'ve", "'ll")


@cache
def newer_letters(path: str) -> str:
    """Letters and numbers that the ``regex`` module knows and the tokenizers library, of an older Unicode, does not.

    For the library they are neither. Found by asking its pre-tokenizer whether it joins
    each one to a letter or to a digit; ``regex`` must not be older than the library.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    out = []
    for kind, first in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        known = regex.findall(kind, every)
        for at in range(0, len(known), 10_000):
            some = known[at : at + 10_000]
            whole = {a for _, (a, b) in split.pre_tokenize_str("".join(f"{first}{c}\n" for c in some)) if b - a == 2}
            out += [c for k, c in enumerate(some) if 3 * k not in whole]
    return "".join(out)


class TokenCounter(PrefixBpe):
    """Tables of token counts by prefix, for one vocabulary."""

    def __init__(self, spec: str, newer: str = ""):
        data = json.loads(spec)
        model, split = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] or model.get("ignore_merges") or data["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"]:
            raise ValueError("expected byte-level BPE without word ends and normalizer")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in data["added_tokens"]):
            raise ValueError("special tokens that take their surroundings are not known here")
        special = sorted((x["content"] for x in data["added_tokens"]), key=len, reverse=True)
        self.special = set(special)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.newer, self.may_be_newer = frozenset(newer), re.compile(f"[{min(newer)}-{max(newer)}]") if newer else None
        less = f"--[{''.join(map(regex.escape, newer))}]"
        self.exact = regex.compile(PATTERN.format(L=rf"[\p{{L}}{less}]", N=rf"[\p{{N}}{less}]", l="", n="").replace(r" ?[^\s]+", rf" ?[^\s[\p{{L}}{less}][\p{{N}}{less}]]+"), regex.V1) if newer else UNICODE
        symbol, vocab = byte_symbols(), model["vocab"]
        self.rank, self.pair, self.parts = {}, {}, {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in self.parts:
                raise ValueError(f"two merges make {a + b!r}")
            self.pair[x << 20 | y], self.parts[z], self.rank[z] = z, (x, y), k
        self.auto = SuffixAutomaton([(i, [symbol[c] for c in t]) for t, i in vocab.items() if t not in self.special], 256)
        self.compatible, self.whole = {}, {}
        self.tables: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.heads: dict[bytes, tuple[list[int], list[int], int, int]] = {}

    def by_byte(self, raw: bytes) -> list[int]:
        """Tokens of the first k bytes of a pre-token, k from 0 on."""
        auto, own, near, link, step = self.auto, self.auto.own, self.auto.near, self.auto.link, self.auto.next
        known, n = self.compatible, len(raw)
        last, count = [0] * (n + 1), [0] * (n + 1)
        state, length, first = 0, 0, 0
        if n > HEAD and (head := self.heads.get(raw[:HEAD])) is not None:  # the table of a prefix is the same in every word
            last[: HEAD + 1], count[: HEAD + 1], state, length = head
            first = HEAD
        for i in range(first, n):
            if i == HEAD and not first:
                if len(self.heads) >= KEPT_HEADS:
                    self.heads.clear()
                self.heads[raw[:HEAD]] = (last[: HEAD + 1], count[: HEAD + 1], state, length)
            c = raw[i]
            while state and state * 256 + c not in step:
                state = link[state]
                length = auto.length[state]
            state = step[state * 256 + c]
            length += 1
            v, end = near[state], i + 1
            while not count[end]:
                for m, token in own[v]:
                    if m > length:
                        continue
                    if m == end:
                        good = self._alone(token)
                    else:
                        before = last[end - m]
                        key = before << 20 | token
                        good = known.get(key)
                        if good is None:
                            if len(known) >= KEPT_PAIRS:
                                known.clear()
                            good = known[key] = self._fits(before, token)
                    if good:
                        last[end], count[end] = token, count[end - m] + 1
                        break
                v = near[link[v]]
        return count

    def table(self, word: str) -> tuple[int, ...]:
        """Tokens of the first 1, 2, .. code points of a pre-token; kept for the next time."""
        if len(self.tables) >= KEPT_TABLES:  # those in use move on to the next generation
            self.tables, self.older = {}, self.tables
        if (found := self.older.get(word)) is not None:
            self.tables[word] = found
            return found
        raw = word.encode("utf-8", "surrogatepass")
        count = self.by_byte(raw)
        found = tuple(count[1:]) if len(raw) == len(word) else tuple([count[k] for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80])
        if len(word) <= KEPT_LENGTH:
            self.tables[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii():
            return ASCII.findall(text)
        odd = self.newer and self.may_be_newer.search(text) and not self.newer.isdisjoint(text)
        return (self.exact if odd else UNICODE).findall(text)

    def pieces(self, text: str) -> list[str]:
        """The text cut at special tokens' strings: ordinary text and special tokens in turn."""
        return self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]

    def totals(self, words: list[str]) -> list[int]:
        get = self.tables.get
        return [(get(w) or self.table(w))[-1] for w in words]

    def tokens(self, text: str | None) -> int:
        """Tokens of a whole text."""
        return sum(1 if x in self.special else sum(self.totals(self.words(x))) for x in self.pieces(text or ""))

    def plain_prefixes(self, words: list[str], base: int = 0) -> list[int]:
        """Entries for the prefixes of consecutive pre-tokens, the first of which begins after ``base`` tokens."""
        out, ahead, get = [], 0, self.tables.get
        for k, w in enumerate(words):
            t = get(w) or self.table(w)
            if w in CUT_SHORT:  # without its last letter it is a quote and a letter
                t = (1, 2, *t[2:])
            out += [base + x for x in t[ahead:]]
            ahead = 0
            if w[-1] in SPACE and k + 1 < len(words) and words[k + 1][0] in SPACE:  # a prefix that ends with the run has the run as one
                run = w + words[k + 1][0]
                out.append(base + (get(run) or self.table(run))[-1])
                ahead = 1
            base += t[-1]
        return out

    def prefixes(self, text: str | None) -> array:
        """Tokens of the first k code points, for k from 0 to all."""
        out, base, parts = array("i", [0]), 0, self.pieces(text or "")
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            # Cut within a special token's string, a prefix has only ordinary text there.
            got = self.plain_prefixes(self.words(parts[k] + special[:-1]), base)
            out.extend(got)
            if special:
                base = (got[len(parts[k]) - 1] if parts[k] else base) + 1
                out.append(base)
        return out

    def fitting(self, text: str | None, limit: int) -> tuple[int, int]:
        """(tokens of the text, code points of its longest prefix of at most ``limit`` tokens)."""
        base, place, best = 0, 0, 0
        parts = self.pieces(text or "")
        for k in range(0, len(parts), 2):
            words = self.words(parts[k])
            totals = self.totals(words)
            special = parts[k + 1] if k + 1 < len(parts) else ""
            end = base + sum(totals)
            if end <= limit:
                best = place + len(parts[k])
            if base <= limit and (end > limit or special):
                if end + len(special) > limit:  # the limit is within these words, or within the special string cut short
                    if special:
                        words = self.words(parts[k] + special[:-1])
                        totals = self.totals(words)
                    starts = list(accumulate(totals, initial=base))
                    to = next((i for i, s in enumerate(starts) if s > limit), len(words))
                    at = max(0, to - 3)
                    before = place + sum(map(len, words[:at]))
                    for i, x in enumerate(self.plain_prefixes(words[at : to + 1], starts[at])):
                        if x <= limit:
                            best = max(best, before + i + 1)
                else:
                    best = max(best, place + len(parts[k]) + len(special) - 1)
            base, place = end, place + len(parts[k])
            if special:
                base, place = base + 1, place + len(special)
                if base <= limit:
                    best = place
        return base, best


def counter(spec: str, newer: str) -> TokenCounter:
    """This process's counter of a vocabulary file's content."""
    key = hashlib.sha256(spec.encode()).hexdigest() + newer
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = TokenCounter(spec, newer)
    return _MADE[key]


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, fields: list[tuple[str, pa.DataType, str]], row) -> DataFrame:
    """The id and what row(counter, text) returns, for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast((read_spec(path), newer_letters(path)))  # one vocabulary file
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        count = counter(*spec.value)
        for batch in batches:
            rows = [row(count, x.as_py() or "") for x in batch.column("text")]
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), kind) for c, (_, kind, _) in zip(cols, fields, strict=True))], names=["doc_id", *(f[0] for f in fields)])

    schema = ", ".join([f"doc_id {texts.schema['doc_id'].dataType.simpleString()}", *(f"{name} {kind}" for name, _, kind in fields)])
    return texts.mapInArrow(lean(run, "token_counts"), schema)


def counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), fit_chars: code points of the longest prefix within the limit."""

    def row(count: TokenCounter, text: str):
        n, fit = count.fitting(text, limit)
        return len(text.encode("utf-8", "surrogatepass")), n, n > limit, fit

    fields = [("n_bytes", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("over_limit", pa.bool_(), "boolean"), ("fit_chars", pa.int64(), "long")]
    return _mapped(docs, path, id_col, text_col, fields, row)


def prefix_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, prefix_tokens (array of int): element k is the tokens of the text's first k code points, from 0 to all."""
    return _mapped(docs, path, id_col, text_col, [("prefix_tokens", pa.list_(pa.int32()), "array<int>")], lambda count, text: (memoryview(count.prefixes(text)).tolist(),))


def tokens_within(n_chars: Column | int, table: str = "prefix_tokens") -> Column:
    """Tokens of the first ``n_chars`` code points (of the whole text if it is shorter), from a table of prefix_tokens()."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.get(table, F.least(F.greatest(n, F.lit(0)), F.size(table) - 1).cast("int"))


def longest_prefix(budget: Column | int, table: str = "prefix_tokens") -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; null if even the empty one has more."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(table, lambda x, k: F.when(x <= most, k)))
