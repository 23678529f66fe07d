"""Edit-aware token counts: a segment tree of pre-tokens per document.

Counting cuts a text into pre-tokens and keeps, per leaf of ``LEAF``
pre-tokens, their lengths (code points) and token counts; inner nodes hold the
sums of their subtrees. An edit (replace ``length`` code points at ``start`` by
``text``) finds the first pre-token it may change by descending the tree, cuts
and encodes again from there until a new boundary meets an old one behind the
edit, replaces the leaves in between and updates the sums on their paths.

Why this is exact: a match of the pattern reads at most ``CONTEXT`` code points
behind its own end, so pre-tokens ending earlier than that before the edit
stay; and matching from a boundary does not look back, so once a new boundary
falls on an old one behind the edit, all that follows stays.

Defined cases: null and empty texts have no tokens; an edit's start and length
are clamped to the text, null numbers count as 0, a null replacement as empty;
edits apply in the order of the array, each to the text that the one before
left; a null array is no edit. Columns with the name of a new one are replaced. Repeated rows each get their row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.bpe import CACHE, default_vocabulary, read_ranks
from budgetlens.llm.common import read_table, with_made

LEAF = 32
CONTEXT = 3


class Counter:
    """Pre-tokens and their token counts, by the tiktoken library."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path),
                                     special_tokens={})
        self.pattern = regex.compile(pattern)

        class Cache(dict):
            def __missing__(self, token):
                if len(self) >= cache:
                    self.clear()
                self[token] = n = len(encoding.encode_ordinary(token))
                return n

        self.cache = Cache()
        self.count = self.cache.__getitem__


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class CountTree:
    """The segment tree of one document. ``leaves`` are lists of (length,
    tokens) pairs; node i of the arrays has children 2i and 2i+1."""

    def __init__(self, text: str, c: Counter):
        self.c, self.encoded = c, 0
        self.text = text
        found = c.pattern.findall(text)
        self._build(list(map(len, found)), list(map(c.count, found)))

    def _build(self, lengths: list[int], tokens: list[int]) -> None:
        self.leaves = [(lengths[i:i + LEAF], tokens[i:i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.base = base = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.sums = np.zeros(2 * base, np.int64), np.zeros(2 * base, np.int64)
        for tree, flat in ((self.chars, lengths), (self.sums, tokens)):
            if flat:
                tree[base:base + len(self.leaves)] = np.add.reduceat(np.array(flat, np.int64), np.arange(0, len(flat), LEAF))
            half = base
            while half > 1:
                tree[half // 2:half] = tree[half:2 * half:2] + tree[half + 1:2 * half:2]
                half //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1])

    def _find(self, position: int) -> tuple[int, int]:
        """Leaf that holds code point ``position`` (the last leaf beyond the
        end) and the code points before the leaf."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if position >= before + self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.base, before

    def _set(self, leaf: int, lengths: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (lengths, tokens)
        node = self.base + leaf
        self.chars[node], self.sums[node] = sum(lengths), sum(tokens)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, length: int, replacement: str) -> None:
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(start + max(length, 0), len(old))
        self.text = text = old[:start] + replacement + old[end:]
        shift = len(text) - len(old)
        leaf, at = self._find(max(0, start - CONTEXT))
        leaf = min(leaf, len(self.leaves) - 1)
        first, head_l, head_t = leaf, [], []
        lengths, tokens = self.leaves[leaf]
        i = 0
        while i < len(lengths) and at + lengths[i] <= start - CONTEXT:
            at += lengths[i]
            head_l.append(lengths[i])
            head_t.append(tokens[i])
            i += 1
        new_l, new_t, new_at = [], [], at
        stop = end + shift
        matches = self.c.pattern.finditer(text, at)
        while True:  # at: old boundary, new_at: new boundary
            while at + shift < new_at or at < end:  # bring the old one up
                while leaf < len(self.leaves) and i >= len(self.leaves[leaf][0]):
                    leaf, i = leaf + 1, 0
                if leaf == len(self.leaves):
                    break
                at += self.leaves[leaf][0][i]
                i += 1
            if new_at >= stop and at >= end and at + shift == new_at:
                break
            m = next(matches, None)
            if m is None:
                break
            new_l.append(m.end() - m.start())
            new_t.append(self.c.count(m[0]))
            new_at = m.end()
        self.encoded += sum(new_l)
        last = min(leaf, len(self.leaves) - 1)
        tail_l, tail_t = (self.leaves[leaf][0][i:], self.leaves[leaf][1][i:]) if leaf < len(self.leaves) else ([], [])
        merged_l, merged_t = head_l + new_l + tail_l, head_t + new_t + tail_t
        if len(merged_l) > 4 * LEAF:  # a large insertion: the leaves are cut anew, nothing is encoded
            before, after = self.leaves[:first], self.leaves[last + 1:]
            self._build([x for a, _ in before for x in a] + merged_l + [x for a, _ in after for x in a],
                        [x for _, b in before for x in b] + merged_t + [x for _, b in after for x in b])
            return
        self._set(first, merged_l, merged_t)
        for j in range(first + 1, last + 1):
            self._set(j, [], [])


EDITS = "array<struct<start:long,length:long,text:string>>"
MADE = [T.StructField("n_tokens", T.LongType()), T.StructField("edited_text", T.StringType()),
        T.StructField("edited_n_tokens", T.LongType()), T.StructField("reencoded_chars", T.LongType())]


def count_with_edits(docs: DataFrame, text: str = "text", edits: str = "edits",
                     path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the token count of ``text``, the text after ``edits`` (an
    array of start, length, text), its count, and the code points that the
    edits had encoded again. A narrow map over the documents; an edit log is
    grouped by document with ``edits_of`` and joined first."""
    where, split = (path, pattern) if path and pattern else default_vocabulary()

    def compute(part):
        c = counter(where, split)
        out = ([], [], [], [])
        for t, log in zip(part.column(text).to_pylist(), part.column(edits).to_pylist()):
            tree = CountTree(t or "", c)
            out[0].append(tree.n_tokens)
            for e in log or ():
                tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
            out[1].append(tree.text)
            out[2].append(tree.n_tokens)
            out[3].append(tree.encoded)
        return [pa.array(v, pa.string() if f.name == "edited_text" else pa.int64()) for f, v in zip(MADE, out)]

    return with_made(docs, text, MADE, compute, done=counter.cache_clear)


def edits_of(log: DataFrame) -> DataFrame:
    """(doc_id, edits) from an edit log (doc_id, seq, start, length, text): one
    document's edits must be applied one after another, so they meet."""
    return (log.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "text"))).alias("e"))
            .select("doc_id", F.transform("e", lambda x: F.struct(x["start"], x["length"], x["text"])).cast(EDITS).alias("edits")))


def op10_edit_counts(spark, sf_dir):
    """Every document with three edits from its own length: a word put in at a
    third of the text, ten code points deleted at two thirds, and the last five
    replaced. Token counts before and after, and how much was encoded again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")

    def edit(start, length, text):
        return F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"),
                        F.lit(text).alias("text"))

    edited = docs.withColumn("edits", F.array(edit(F.floor(n / 3), 0, " inserted words"),
                                              edit(F.floor(2 * n / 3), 10, ""),
                                              edit(n, 5, "'ll end\n\n")).cast(EDITS))
    return (count_with_edits(edited)
            .select("doc_id", n.alias("n_chars"), "n_tokens", F.sha2("edited_text", 256).alias("edited_sha256"),
                    "edited_n_tokens", "reencoded_chars"))
