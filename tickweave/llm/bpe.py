"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one last token of its BPE encoding.
A suffix automaton over the vocabulary gives the tokens that end at a place; the
one that is compatible with the last token of what stands before it (the pair
encodes to itself, found by undoing merges) is stored. Following these back from
the end of the word emits the exact ids in time linear in the word's length.

The vocabulary file (tokenizers format, byte-level BPE with an end-of-word
suffix, lower-casing) is read once on the driver and sent to the executors.

Defined cases: null text is empty and gives no ids; special tokens' strings in a
text are their ids; repeated rows are encoded each; other columns are ignored;
a vocabulary of another kind is an error.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, lean, small_batches

#: Words kept with their encodings in one Python worker, in each of two generations.
KEPT_WORDS = 150_000
KEPT_PAIRS = 250_000
#: Beginnings of words whose prefix tables are kept: their length, and how many.
HEAD, KEPT_HEADS = 6, 60_000
_MADE: dict[str, PrefixBpe] = {}
CACHES["bpe"] = _MADE.clear


def byte_symbols() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class SuffixAutomaton:
    """All substrings of the vocabulary; each state knows the tokens among its strings."""

    def __init__(self, tokens: list[tuple[int, list[int]]], width: int):
        self.width = width
        self.next: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        follow: list[list[int]] = [[]]  # symbols that leave each state, for copies
        for _, symbols in tokens:
            last = 0
            for c in symbols:
                last = self._grow(last, c, follow)
        own: dict[int, list[tuple[int, int]]] = {}
        for token, symbols in tokens:
            state = 0
            for c in symbols:
                state = self.next[state * width + c]
            own.setdefault(state, []).append((len(symbols), token))
        self.own = {s: sorted(t, reverse=True) for s, t in own.items()}
        #: The nearest state on the way of suffix links, itself included, that has tokens.
        self.near = array("i", [0]) * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[s] = s if s in self.own else self.near[self.link[s]]

    def _new(self, length: int, link: int, follow: list[list[int]]) -> int:
        self.link.append(link)
        self.length.append(length)
        follow.append([])
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int, follow: list[list[int]]) -> int:
        """The part of q whose strings are at most one longer than p's."""
        w, nxt = self.width, self.next
        copy = self._new(self.length[p] + 1, self.link[q], follow)
        for x in follow[q]:
            nxt[copy * w + x] = nxt[q * w + x]
        follow[copy] = list(follow[q])
        self.link[q] = copy
        while p != -1 and nxt.get(p * w + c) == q:
            nxt[p * w + c] = copy
            p = self.link[p]
        return copy

    def _grow(self, last: int, c: int, follow: list[list[int]]) -> int:
        w, nxt = self.width, self.next
        q = nxt.get(last * w + c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q, follow)
        new, p = self._new(self.length[last] + 1, 0, follow), last
        while p != -1 and p * w + c not in nxt:
            nxt[p * w + c] = new
            follow[p].append(c)
            p = self.link[p]
        if p != -1:
            q = nxt[p * w + c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, follow)
        return new


class PrefixBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or data["decoder"] is not None:
            raise ValueError("expected byte-level BPE with word ends and no decoder")
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbol = byte_symbols()

        def symbols(token: str) -> list[int]:
            end = token.endswith("</w>") and len(token) > 4
            out = [symbol[c] for c in (token[:-4] if end else token)]
            return [*out[:-1], out[-1] + 256] if end else out

        vocab = model["vocab"]
        self.rank: dict[int, int] = {}  # token -> place of its merge; single symbols come first
        self.pair: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in self.parts:
                raise ValueError(f"two merges make {a + b!r}")
            self.pair[x << 20 | y], self.parts[z], self.rank[z] = z, (x, y), k
        self.auto = SuffixAutomaton([(i, symbols(t)) for t, i in vocab.items()], 512)
        self.compatible: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.kept: dict[str, tuple[str, int, str]] = {}
        self.heads: dict[bytes, tuple[list[int], list[int], int, int]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _seam(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge with a rank under limit crosses the seam of two tokens.

        Merges are undone from the latest back. If at some stage the symbols at
        the seam have a merge that comes before what was undone, the seam would
        have closed. Of equal merges, the left one happens first.
        """
        rank, pair, parts = self.rank, self.pair, self.parts
        while True:
            joined = pair.get(left << 20 | right)
            if joined is not None and rank[joined] < limit:
                return False
            rl, rr = rank.get(left, -1), rank.get(right, -1)
            if rl < 0 and rr < 0:
                return True
            if rl > rr:
                left, limit = parts[left][1], rl
            else:
                right, limit = parts[right][0], rr + 1

    def _fits(self, a: int, b: int) -> bool:
        """Whether the texts of tokens a and b, joined, encode to [a, b]."""
        return self._seam(a, b, 1 << 30)

    def _alone(self, token: int) -> bool:
        """Whether a token's own text encodes to it: before its merge, to its two parts."""
        found = self.whole.get(token)
        if found is None:
            found = True
            if token in self.parts:
                x, y = self.parts[token]
                found = self._alone(x) and self._alone(y) and self._seam(x, y, self.rank[token])
            self.whole[token] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass")
        n = len(raw)
        auto, own, near, link, step, width = self.auto, self.auto.own, self.auto.near, self.auto.link, self.auto.next, self.auto.width
        known = self.compatible
        last, size = [0] * (n + 1), [0] * (n + 1)
        state, length, first = 0, 0, 0
        if n > HEAD and (head := self.heads.get(raw[:HEAD])) is not None:  # a prefix's table is the same in every word
            last[: HEAD + 1], size[: HEAD + 1], state, length = head
            first = HEAD
        for i in range(first, n):
            if i == HEAD and not first:
                if len(self.heads) >= KEPT_HEADS:
                    self.heads.clear()
                self.heads[raw[:HEAD]] = (last[: HEAD + 1], size[: HEAD + 1], state, length)
            c = raw[i] if i < n - 1 else raw[i] + 256
            while state and state * width + c not in step:
                state = link[state]
                length = auto.length[state]
            state = step[state * width + c]
            length += 1
            v, end = near[state], i + 1
            while not size[end]:
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
                        last[end], size[end] = token, m
                        break
                v = near[link[v]]
        ids, end = [], n
        while end:
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]

    def word(self, word: str) -> tuple[str, int, str]:
        """(ids as text, number, tokens as text) of a pre-token; kept for the next time."""
        if len(self.kept) >= KEPT_WORDS:  # words in use move on to the next generation
            self.kept, self.older = {}, self.kept
        if (found := self.older.get(word)) is not None:
            self.kept[word] = found
            return found
        ids = self.encode_word(word)
        found = (" ".join(map(str, ids)), len(ids), " ".join([self.names[i] for i in ids]))
        if len(word) <= 64:
            self.kept[word] = found
        return found

    def found(self, text: str | None) -> list[tuple[str, int, str]]:
        """The encodings of a text's pre-tokens and special tokens, in order."""
        if not text:
            return []
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                i = self.special[part]
                out.append((str(i), 1, part))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            get = self.kept.get  # of the generation at the start; word() knows the present one
            out += [get(w) or self.word(w) for w in self.words.findall(part.lower())]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for x in self.found(text) for i in x[0].split(" ")]

    def decode(self, ids: list[int] | None) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join([self.names[i] for i in ids or [] if i in self.names])


def encoder(spec: str) -> PrefixBpe:
    """This process's encoder of a vocabulary file's content."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = PrefixBpe(spec)
    return _MADE[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _mapped(df: DataFrame, path: str, column: str, fields: list[tuple[str, pa.DataType, str]], row) -> DataFrame:
    """doc_id and what row(encoder, value) returns, for each row."""
    spark = df.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))  # one vocabulary file

    def run(batches):
        bpe = encoder(spec.value)
        for batch in batches:
            rows = [row(bpe, x) for x in batch.column(column).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), kind) for c, (_, kind, _) in zip(cols, fields, strict=True))], names=["doc_id", *(f[0] for f in fields)])

    schema = ", ".join([f"doc_id {df.schema['doc_id'].dataType.simpleString()}", *(f"{name} {kind}" for name, _, kind in fields)])
    return df.mapInArrow(lean(run, "bpe"), schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    return _mapped(_texts(docs, id_col, text_col), path, "text", [("ids", pa.list_(pa.int32()), "array<int>")], lambda bpe, t: (bpe.encode(t),))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids; unknown ids are left out."""
    one = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return _mapped(one, path, "ids", [("text", pa.string(), "string")], lambda bpe, ids: (bpe.decode(ids),))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encoding and decoding in one pass over the texts."""

    def row(bpe: PrefixBpe, text: str | None):
        found = bpe.found(text)
        ids = " ".join([x[0] for x in found])
        tokens = " ".join([x[2] for x in found])
        out = sum([x[1] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()
        return (*out, np.array(ids.split(" ") if ids else [], np.int32)) if with_ids else out

    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    fields += [("ids", pa.list_(pa.int32()), "array<int>")] if with_ids else []
    return _mapped(_texts(docs, id_col, text_col), path, "text", fields, row)
