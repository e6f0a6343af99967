"""Chat formatting: turns assembled from tokens of separately encoded segments."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read_table
from .sequences import digests
from .word_bpe import vocabulary_path

#: Control strings. Their ids follow those of the vocabulary, in this order.
HEADS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
OTHER, ROLE_END, TURN_END = "### Role:", "</role>", "</turn>"
CONTROLS = (*HEADS.values(), OTHER, ROLE_END, TURN_END)
#: The role whose texts are learned.
LEARNED = "assistant"
#: A byte-level vocabulary, as ranks of byte strings: what it encodes, it decodes exactly.
VOCABULARY = "byte_bpe_50k.tiktoken"
_MARKED = "|".join(re.escape(x) for x in ("\\", *CONTROLS))


def escaped(text: Column) -> Column:
    """A text with a backslash before each backslash and each control string. In
    what comes out, a control string is never without one."""
    return F.regexp_replace(text, f"({_MARKED})", r"\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def rendered(role: Column, text: Column) -> Column:
    """A turn as text: the head of its role, the escaped text, the end of the turn."""
    head = F.concat(F.lit(OTHER), escaped(role), F.lit(ROLE_END))
    for name, mark in HEADS.items():
        head = F.when(role == name, F.lit(mark)).otherwise(head)
    return F.concat(head, escaped(text), F.lit(TURN_END))


_OPEN: dict[str, tuple] = {}


def opened(path: str) -> tuple:
    """The tokenizer of this worker and the id of the first control string. It knows
    no special tokens: their strings are text."""
    if path not in _OPEN:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _OPEN[path] = (tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1)
    return _OPEN[path]


def turns(tokenizer, first: int, roles: list[str], texts: list[str], spelt: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of turns laid end to end, and where each starts (and the end).

    texts and spelt (the roles) are escaped. A turn is five segments: head, role
    if it has no head of its own, end of that role, text, end of the turn. Texts
    are encoded alone, control ids spliced between; places are prefix sums of the
    segments' lengths, and so is the mask, from +1 where a learned text starts
    and -1 where it ends.
    """
    heads = list(HEADS)
    own = np.array([heads.index(r) if r in HEADS else -1 for r in roles], "int64")
    other = own < 0
    said = [tokenizer.encode_ordinary(x) for x in texts]
    names = [tokenizer.encode_ordinary(x) if o else [] for x, o in zip(spelt, other)]
    n = len(roles)
    lengths = np.ones((n, 5), "int64")
    lengths[:, 1], lengths[:, 2], lengths[:, 3] = [len(x) for x in names], other, [len(x) for x in said]
    ends = lengths.cumsum().reshape(n, 5)
    at = ends - lengths
    total = int(ends[-1, 4]) if n else 0
    ids, inner = np.zeros(total, "int32"), np.ones(total, bool)
    for column, mark in ((0, np.where(other, len(heads), own)), (2, np.full(n, CONTROLS.index(ROLE_END))), (4, np.full(n, CONTROLS.index(TURN_END)))):
        there = lengths[:, column] == 1
        ids[at[there, column]] = first + mark[there]
        inner[at[there, column]] = False
    ids[inner] = np.fromiter((i for a, b in zip(names, said) for x in (a, b) for i in x), "int32")
    steps = np.zeros(total + 1, "int8")
    learned = np.array([r == LEARNED for r in roles], bool) & (lengths[:, 3] > 0)
    steps[at[learned, 3]] += 1
    steps[ends[learned, 3]] -= 1
    return ids, steps.cumsum()[:-1].astype("int8"), np.append(at[:, 0], total)


def format_turns(rows: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, ids, loss_mask (0 or 1 per id), start and
    formatted of each turn.

    A conversation's sequence is the ids of its turns by turn (nulls first), then
    role, then text; start is a turn's place in it, the running sum of lengths.
    formatted is the same as text. Null roles and texts count as empty; a null
    conv_id is a conversation; repeated rows are turns of their own; other columns
    are dropped; an empty table gives no rows. Turns are encoded where they are
    read. The running sum shuffles them by conversation and streams; without a
    use of start there is no shuffle.
    """
    path = path or vocabulary_path(VOCABULARY)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).select("*", escaped(F.col("text")).alias("e"), F.when(~F.col("role").isin(*HEADS), escaped(F.col("role"))).alias("s"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def run(batches):
        tokenizer, first = opened(path)
        for b in batches:
            ids, mask, at = turns(tokenizer, first, *(b.column(i).to_pylist() for i in (2, 4, 5)))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (ids, mask)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *lists], names=["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    made = map_arrow(own, run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, loss_mask array<tinyint>")
    n = F.size("ids")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return made.withColumn("start", F.sum(n).over(w) - n).withColumn("formatted", rendered(F.col("role"), F.col("text")))


READ = "role string, text string, learned string, formatted string"


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, learned (null without loss) and formatted of each
    turn; the last four are read from ids and loss_mask alone. Rows stay where they are."""
    path = path or vocabulary_path(VOCABULARY)
    kinds = [formatted.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def run(batches):
        tokenizer, first = opened(path)
        decode = lambda ids: tokenizer.decode_bytes(ids.tolist()).decode()
        heads = list(HEADS)
        for b in batches:
            out = []
            for ids, mask in zip(*(rows_of(b.column(i)) for i in (2, 3))):
                marks = np.flatnonzero(ids >= first)
                parts = [ids[i + 1 : j] for i, j in zip(marks[:-1], marks[1:])]
                said = decode(parts[-1])
                spelt = decode(parts[0]) if len(parts) > 1 else None
                role = unescaped(spelt) if spelt is not None else heads[ids[0] - first]
                written = (HEADS[role] if spelt is None else OTHER + spelt + ROLE_END) + said + TURN_END
                out.append((role, unescaped(said), unescaped(decode(ids[mask == 1])) if mask.any() else None, written))
            columns = [pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["conv_id", "turn", "role", "text", "learned", "formatted"])

    return map_arrow(formatted.select("conv_id", "turn", "ids", "loss_mask"), run, f"conv_id {kinds[0]}, turn {kinds[1]}, {READ}")


def rows_of(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [flat[i - at[0] : j - at[0]] for i, j in zip(at[:-1], at[1:])]


def summary(rows: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of
    each conversation, read back from its formatted turns."""
    back = read_back(format_turns(rows, path), path)
    each = back.select("conv_id", "turn", "role", "text", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turns"), F.col("learned").alias("loss"), F.coalesce(F.length("learned"), F.lit(0)).alias("loss_chars"), F.length("formatted").alias("formatted_chars"))
    return digests(each, "conv_id", ["turn", "role", "text"], ["turns", "loss"], ["loss_chars", "formatted_chars"]).withColumnRenamed("n", "n_turns")


PROBE = r"\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, i, r, PROBE) for i, r in enumerate(("user", "assistant"))], rows.schema)
    return summary(rows.union(probe))


_PATTERN = r"(\\|### System:|### User:|### Assistant:|### Role:|</role>|</turn>)"
OP13_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
f AS (SELECT *, CASE role WHEN 'system' THEN '### System:' WHEN 'user' THEN '### User:' WHEN 'assistant' THEN '### Assistant:' ELSE '### Role:' || regexp_replace(role, '{_PATTERN}', '\\\1', 'g') || '</role>' END
  || regexp_replace(text, '{_PATTERN}', '\\\1', 'g') || '</turn>' AS formatted FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(formatted))::BIGINT AS formatted_chars FROM f GROUP BY conv_id
"""
