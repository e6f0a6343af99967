"""Edit-aware token counts: a tree of pre-token segments per document.

A leaf holds some words of the text with the white space behind them; inner
nodes hold the characters and tokens below. No pre-token crosses white space,
so that an edit changes the counts of the leaves it touches alone, and of the
next one where the edit removes the space between them: these are encoded
anew, and the sums on the path to the root are updated. Trees are kept in a
table as the counts of their leaves and are updated from there; leaves that
grow long are cut again.

A long run without white space is cut at the ends of its pre-tokens, and a long
pre-token where one of its tokens ends. A part of a sequence of BPE tokens is
the encoding of its own text, and a sequence is one if each pair of neighbours
is: so an edit in such a run takes in a leaf on either side as context, and
more of them until the outermost token on that side is the one it was.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, staged
from .word_bpe import WordBpe, opened, vocabulary_path

#: Characters that a leaf has at least, but for the last, and one in a run without
#: white space.
LEAF, INNER = 256, 128
SPACES = " \t\n\x0b\x0c\r"
_CUT = re.compile(rf"(?s).{{{LEAF - 1}}}[^{SPACES}]*[{SPACES}]+|.+")


def _kind(c: str) -> str:
    """L, N or another class, as the pre-tokenizer sees a character."""
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "O"


def apart(left: str, right: str) -> bool:
    """Whether a pre-token surely ends between two neighbouring characters."""
    if left in SPACES or right in SPACES:
        return True
    if ord(right) > 0x2FF and unicodedata.category(right)[0] == "M" or left == "'":
        return False  # it may be composed with what stands before; 's and the like
    a, b = _kind(left), _kind(right)
    return a != b or a == "N"


class SegmentTree:
    """Sums over leaves in a heap: node i has the children 2i and 2i + 1."""

    def __init__(self, text: str, bpe: WordBpe, counts: list[tuple[int, int]] | None = None):
        """counts: characters and tokens of each leaf of a tree that was kept;
        without them the text is cut and encoded."""
        self.bpe = bpe
        self.recounted = 0
        if counts is None:
            leaves = self._cut(text) or [""]
            tokens = self._count_each(leaves, False)
        else:
            ends = list(accumulate(n for n, _ in counts))
            leaves = [text[e - n : e] for e, (n, _) in zip(ends, counts, strict=True)]
            tokens = [t for _, t in counts]
        self._build(leaves, tokens)
        self.recounted = 0

    def _cut(self, text: str) -> list[str]:
        out = []
        for x in _CUT.findall(text):
            out += self._cut_run(x) if len(x) > 2 * LEAF else [x]
        return out

    def _cut_run(self, chunk: str) -> list[str]:
        """The leaves of a chunk whose last word is long."""
        head = max(map(chunk.rstrip(SPACES).rfind, SPACES)) + 1
        run = chunk[head:].rstrip(SPACES)
        normal = self.bpe.tokenizer.normalizer.normalize_str(run)
        whole = self.bpe.pretokens(run)
        if len(normal) != len(run) or "".join(whole) != normal or any(x in run for x in self.bpe.special):
            return [chunk]  # places in the run can't be told from those of its tokens
        bounds, at = [], 0
        for p in whole:
            if len(p) > INNER:
                done, seen = b"", at
                for i in self.bpe.encode_long(p)[:-1]:
                    done += self.bpe.bytes_of(i)
                    try:
                        seen, done = seen + len(done.decode()), b""
                    except UnicodeDecodeError:
                        continue  # a token ends within a character
                    if normal[seen] != "'":  # 's and the like would begin there
                        bounds.append(seen)
            at += len(p)
            if at < len(run) and apart(run[at - 1], run[at]):
                bounds.append(at)
        cuts, last = [], 0
        for b in bounds:
            normalised = self.bpe.tokenizer.normalizer.normalize_str
            if b - last >= INNER and b < len(run) and normalised(run[last:b]) == normal[last:b] and normalised(run[b:]) == normal[b:]:
                cuts.append(b)
                last = b
        places = [0, *(head + c for c in cuts), len(chunk)]
        return [chunk[i:j] for i, j in zip(places, places[1:])]

    def _ids(self, text: str, goes_on: bool) -> list[int]:
        """Ids of a text whose last pre-token ends with it, or goes on behind it."""
        self.recounted += len(text)
        if not goes_on or not text:
            return list(self.bpe.encode(text))
        head = max(map(text.rfind, SPACES)) + 1
        for x in self.bpe.special:
            head = max(head, (text.rfind(x) + len(x)) if x in text else 0)
        pre = self.bpe.pretokens(text[head:])
        if not pre:
            return list(self.bpe.encode(text))
        before = [i for x in (text[:head], *pre[:-1]) for i in self.bpe.encode(x)]
        return before + list(self.bpe.inner.encode(pre[-1], add_special_tokens=False).ids)

    def _count_each(self, leaves: list[str], goes_on: bool) -> list[int]:
        """Tokens of neighbouring leaves; goes_on: of the last one behind it."""
        return [len(self._ids(x, not apart(x[-1], y[0]) if x and y else goes_on and not y)) for x, y in zip(leaves, [*leaves[1:], ""], strict=True)]

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.size = 1 << (len(leaves) - 1).bit_length()
        more = self.size - len(leaves)
        self.leaves = leaves + [""] * more
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        self.tokens = [0] * self.size + tokens + [0] * more
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def counts(self) -> list[tuple[int, int]]:
        """Characters and tokens of the leaves that aren't empty."""
        return [(n, t) for n, t in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if n] or [(0, 0)]

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with character `at` (the last one beyond the end), and
        where in it."""
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def _beside(self, i: int, step: int) -> int:
        """The next leaf from i that isn't empty; -1 or the number of leaves if none."""
        i += step
        while 0 <= i < len(self.leaves) and not self.leaves[i]:
            i += step
        return i

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace the characters start..stop by text."""
        total = self.chars[1]
        start, stop = min(start, total), min(max(start, stop), total)
        first, a = self._find(start)
        last, b = self._find(stop)
        joined = self.leaves[first][:a] + text + self.leaves[last][b:]
        left = right = False  # whether a leaf was taken in on that side
        while True:
            p, n = self._beside(first, -1), self._beside(last, 1)
            inner = [p >= 0 and (not joined or not apart(self.leaves[p][-1], joined[0])), n < len(self.leaves) and (not joined or not apart(joined[-1], self.leaves[n][0]))]
            own = self._ids(joined, inner[1]) if left and inner[0] or right and inner[1] else []
            more_left = inner[0] and not (left and own[:1] == self._ids(self.leaves[first], True)[:1] != [])
            more_right = inner[1] and not (right and own[-1:] == self._ids(self.leaves[last], True)[-1:] != [])
            if more_left:
                first, joined, left = p, self.leaves[p] + joined, True
            if more_right:
                last, joined, right = n, joined + self.leaves[n], True
            if not more_left and not more_right:
                break
        # What has grown long is cut again, so that leaves stay short.
        pieces = self._cut(joined) if len(joined) > 2 * LEAF else [joined]
        tokens = self._count_each(pieces, inner[1])
        room = last + 1 - first
        if len(pieces) > room:  # no leaf is free here: new sums, no new encoding
            old = self.tokens[self.size :]
            self._build([*self.leaves[:first], *pieces, *self.leaves[last + 1 :]], [*old[:first], *tokens, *old[last + 1 :]])
            return
        touched = set()
        for k, i in enumerate(range(first, last + 1)):
            self.leaves[i] = pieces[k] if k < len(pieces) else ""
            self.chars[self.size + i] = len(self.leaves[i])
            self.tokens[self.size + i] = tokens[k] if k < len(pieces) else 0
            touched.add((self.size + i) // 2)
        while touched:
            for i in touched:
                if i:
                    self._sum(i)
            touched = {i // 2 for i in touched if i > 1}

    @property
    def text(self) -> str:
        return "".join(self.leaves)


TREE = "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def _row(tree: SegmentTree) -> tuple:
    counts = tree.counts()
    return tree.text, tree.tokens[1], [n for n, _ in counts], [t for _, t in counts]


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """TREE of each row of docs: the tree as the counts of its leaves, to be kept
    beside the text. Null text is empty. No shuffle."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = opened(path)
        for b in batches:
            rows = [_row(SegmentTree(t or "", bpe)) for t in b.column(1).to_pylist()]
            yield _tree_batch(b.column(0), rows)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, TREE)


def _tree_batch(ids, rows: list[tuple], *more: pa.Array, names: tuple = ()) -> pa.RecordBatch:
    text, n, chars, tokens = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
    arrays = [ids, pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([*arrays, *more], names=[*(x.split()[0] for x in TREE.split(", ")), *names])


def update_trees(trees: DataFrame, edits: str, path: str | None = None) -> DataFrame:
    """trees after their edits: TREE, and tokens_before and recounted_chars, the
    characters that were encoded anew. Nothing else is encoded.

    edits names a column array<struct<start int, stop int, text string>> of
    replacements by code points, made in order, each on the text as it then
    is. Null edits are none; an end before its start is taken as the start,
    places beyond the end as the end. Repeated rows are edited each.
    """
    path = path or vocabulary_path()

    def run(batches):
        bpe = opened(path)
        for b in batches:
            rows, before, recounted = [], b.column(2), []
            for text, chars, tokens, changes in zip(*(b.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True):
                tree = SegmentTree(text or "", bpe, list(zip(chars, tokens, strict=True)))
                for e in changes or ():
                    tree.edit(e["start"], e["stop"], e["text"] or "")
                rows.append(_row(tree))
                recounted.append(tree.recounted)
            yield _tree_batch(b.column(0), rows, before, pa.array(recounted, pa.int64()), names=("tokens_before", "recounted_chars"))

    return map_arrow(trees.select("doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", edits), run, f"{TREE}, tokens_before long, recounted_chars long")


def sample_edits(text: Column) -> Column:
    """Two edits that depend on the text alone: in its middle, a quarter of its
    length but at most 40 characters give way to the 20 first ones; then the
    third character is removed."""
    n, mid = F.length(text), F.floor(F.length(text) / 2).cast("int")
    cut = F.least(F.floor(n / 4).cast("int"), F.lit(40))
    return F.array(
        F.struct(mid.alias("start"), (mid + cut).alias("stop"), F.left(text, F.lit(20)).alias("text")),
        F.struct(F.lit(2).alias("start"), F.lit(3).alias("stop"), F.lit("").alias("text")),
    )


def counted(updated: DataFrame) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, edited_chars, recounted_chars of updated trees."""
    return updated.select("doc_id", F.col("tokens_before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), F.length("text").cast("long").alias("edited_chars"), "recounted_chars")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all documents, kept in a table, then edited from there."""
    trees = staged(build_trees(read_table(spark, sf_dir, "documents")), "token-trees")
    return counted(update_trees(trees.withColumn("edits", sample_edits(F.col("text"))), "edits"))
