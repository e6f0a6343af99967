"""Repair of conversations: the cheapest edits by dynamic programming over a trie
of role and fault signatures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, staged
from .sequences import digests

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits; Keep is free. A truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Symbols of a signature by fault, for the role initials s, u, a and others.
CLASSES = "suax"
CLEAN, TRUNCATED_, BLANK, DUPLICATE = "suax", "SUAX", "0123", "4567"
#: Rows of a conversation are gathered in runs of at most this many.
RUN = 256

# What may follow: from nothing (0) a system, user turn; from system (1) a user's;
# from a user's (2) an assistant's; from an assistant's (3) a user's.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_INSERTED = {0: "ua", 1: "ua", 2: "au", 3: "ua"}
_FINAL = (0, 3)


def _after(state: int, initials: str) -> int:
    for r in initials:
        state = _NEXT[state][r]
    return state


def _moves() -> list[tuple]:
    """(from, inserted initials, edit, initial it leaves, to) of each way to pass a row."""
    out = []
    for state in _NEXT:
        for n in range(3):
            new = _INSERTED[state][:n]
            at = _after(state, new)
            out += [(state, new, e, r, to) for r, to in _NEXT[at].items() for e in "KR" if (e, r) != ("R", "s")]
            out.append((state, new, "D", "", at))
    return out


MOVES = _moves()
#: Ways to end, after the moves in one numbering.
TAILS = [(q, _INSERTED[q][:n]) for q in _NEXT for n in range(3) if _after(q, _INSERTED[q][:n]) in _FINAL]
#: A move or tail as one character of a plan.
_CODE = [chr(33 + i) for i in range(len(MOVES) + len(TAILS))]


def _ways(symbol: str) -> dict[int, list[tuple]]:
    """Per state to: (from, cost, edits, move) of the cheapest, least edits."""
    kind = next(i for x in (CLEAN, TRUNCATED_, BLANK, DUPLICATE) for i, c in enumerate(x) if c == symbol)
    best: dict[tuple, tuple] = {}
    for i, (q, new, e, r, to) in enumerate(MOVES):
        if e == "K" and r != CLASSES[kind] or e != "D" and symbol in BLANK + DUPLICATE:
            continue
        cost = INSERT * len(new) + {"K": 0, "R": REROLE, "D": DELETE}[e] + TRUNCATED * (e != "D" and symbol in TRUNCATED_)
        best[q, to] = min(best.get((q, to), (99, "", 0)), (cost, "I" * len(new) + e, i))
    return {to: [(q, *w) for (q, t), w in sorted(best.items()) if t == to] for to in _NEXT}


class Trie:
    """Walks signatures in sorted order as a prefix trie. The layers of the path to
    the last signature are kept, so that each layer is computed once for all
    signatures that share its prefix.

    A layer has, per state, the least cost (less that of the cheapest state) and the
    rank of its edits among those of the other states. All edits of one layer end
    with the edit of one row, so none is the start of another and ranks decide
    all later comparisons. Layers that are equal are one object; a path therefore
    takes a few words per row.
    """

    def __init__(self):
        root = ((0, None, None, None), (0, 0, 0, 0))
        self.path = [(root, None, 0)]
        self.last = ""
        self.known: dict[tuple, tuple] = {}
        self.ways: dict[str, dict] = {}
        self.made = 0

    def solve(self, signature: str) -> tuple[int, str, str]:
        """Cost, edits' initials and plan (a move per row, then a tail)."""
        same = shared(self.last, signature)
        del self.path[same + 1 :]
        layer, _, base = self.path[-1]
        for symbol in signature[same:]:
            layer, back, more = self.step(layer, symbol)
            base += more
            self.path.append((layer, back, base))
            self.made += 1
        self.last = signature
        costs, ranks = layer
        cost, _, _, state, tail = min((costs[q] + INSERT * len(new), ranks[q], len(new), q, i) for i, (q, new) in enumerate(TAILS) if costs[q] is not None)
        plan = [_CODE[len(MOVES) + tail]]
        edits = ["I" * len(TAILS[tail][1])]
        for _, back, _ in self.path[:0:-1]:
            state, word, move = back[state]
            plan.append(_CODE[move])
            edits.append(word)
        return cost + base, "".join(reversed(edits)), "".join(reversed(plan))

    def step(self, layer: tuple, symbol: str) -> tuple:
        """The next layer, the way back from each of its states, the cost it adds."""
        found = self.known.get((layer, symbol))
        if found is None:
            costs, ranks = layer
            ways = self.ways.setdefault(symbol, _ways(symbol))
            best = {to: min(((costs[q] + c, ranks[q], word, q, move) for q, c, word, move in w if costs[q] is not None), default=None) for to, w in ways.items()}
            less = min(b[0] for b in best.values() if b)
            order = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values() if b}))}
            following = (tuple(b and b[0] - less for b in best.values()), tuple(order[b[1:3]] if b else 0 for b in best.values()))
            found = self.known[layer, symbol] = (following, tuple(b and (b[3], b[2], b[4]) for b in best.values()), less)
        return found


def shared(a: str, b: str) -> int:
    """Length of the longest common start."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def counted(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and pairs of neighbours out of order."""
    of = lambda symbols: sum(map(signature.count, symbols))
    roles = signature.translate(str.maketrans(TRUNCATED_ + BLANK + DUPLICATE, CLASSES * 3))
    return of(BLANK), of(DUPLICATE), of(TRUNCATED_), max(0, len(roles) - 1) - sum(map(roles.count, ("su", "ua", "au")))


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `at`: numbers that follow each conversation by
    turn (nulls first), then role, then text, without gaps within a partition.
    Null roles and texts become one space. Rows are dealt by ranges, so that a
    long conversation is split; they are staged."""
    own = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    dealt = own.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return staged(dealt.withColumn("at", F.monotonically_increasing_id()), "repair-rows")


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, at and symbol of ordered rows. Repeats are found by hashes of role
    and text, pre-aggregated, so that neither a conversation nor a text that has
    most rows meets in one task."""
    role, text = F.col("role"), F.col("text")
    end = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    own = rows.select("conv_id", "at", F.left(role, F.lit(1)).alias("initial"), end.alias("end"), F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("same"))
    repeats = own.where("end <> ''").groupBy("conv_id", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = repeats.select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    joined = own.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    kind = F.when(F.col("end") == "", F.lit(BLANK)).when(F.col("at") > F.col("first"), F.lit(DUPLICATE)).when(~F.col("end").isin(*ENDS), F.lit(TRUNCATED_)).otherwise(F.lit(CLEAN))
    place = F.when(F.col("initial").isin(*"sua"), F.instr(F.lit(CLASSES), F.col("initial"))).otherwise(F.lit(4))
    return joined.select("conv_id", "at", F.substring(kind, place, F.lit(1)).alias("symbol"))


def signatures(marked: DataFrame) -> DataFrame:
    """conv_id, signature and runs (start, length) of each conversation; the
    symbols are first gathered in runs of at most RUN rows."""
    run = F.shiftright("at", RUN.bit_length() - 1).alias("run")
    runs = marked.groupBy("conv_id", run).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("x"))
    runs = runs.select("conv_id", F.struct(F.col("x")[0]["at"].alias("start"), F.array_join(F.col("x.symbol"), "").alias("piece")).alias("run"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return whole.select("conv_id", F.array_join(F.col("runs.piece"), "").alias("signature"), F.transform("runs", lambda r: F.struct(r.start.alias("start"), F.length(r.piece).alias("length"))).alias("runs"))


ANSWER = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, plan string"


def answers(signed: DataFrame) -> DataFrame:
    """The columns of ANSWER for each distinct signature. These are sorted by
    ranges, so that those of one task share prefixes, and walked as a trie."""
    distinct = signed.select("signature").distinct()
    dealt = distinct.repartitionByRange(F.left("signature", F.lit(64))).sortWithinPartitions("signature")

    def run(batches):
        trie = Trie()
        for b in batches:
            own = b.column(0).to_pylist()
            rows = [(s, *counted(s), *trie.solve(s)) for s in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[x.split()[0] for x in ANSWER.split(", ")])

    return map_arrow(dealt, run, ANSWER)


def solved(rows: DataFrame) -> DataFrame:
    """conv_id, runs and the columns of ANSWER for each conversation of ordered rows."""
    signed = staged(signatures(symbols(rows)), "repair-signatures")
    return signed.join(answers(signed), "signature")


def repaired(rows: DataFrame, solved_: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, at, place, edit, role and
    text, in the order of at and place. Inserted rows have the edit I and empty text.

    rows are ordered ones. The plan of a conversation is cut into its runs, and
    rows are joined with their run, so that a long conversation is spread.
    """
    ends = F.col("runs")[F.size("runs") - 1]["start"]
    starts = F.transform("runs", lambda r, i: F.struct(r.start.alias("start"), r.length.alias("length"), F.aggregate(F.slice("runs", 1, i), F.lit(0), lambda s, x: s + x.length).alias("before")))
    cut = solved_.select(F.col("conv_id").alias("c"), "plan", ends.alias("ends"), F.explode(starts).alias("r"))
    cut = cut.select("c", F.shiftright("r.start", RUN.bit_length() - 1).alias("run"), F.col("r.start").alias("start"), F.substring("plan", F.col("r.before") + 1, F.col("r.length")).alias("moves"), F.when(F.col("r.start") == F.col("ends"), F.right("plan", F.lit(1))).alias("tail"), F.col("r.length").alias("length"))
    joined = rows.join(cut, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("at", RUN.bit_length() - 1) == F.col("run")))
    move = F.ascii(F.substring("moves", (F.col("at") - F.col("start") + 1).cast("int"), F.lit(1))) - 33
    tail = F.when(F.col("at") == F.col("start") + F.col("length") - 1, F.ascii("tail") - 33 - len(MOVES))
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at)
    with_ = joined.select("conv_id", "at", "role", "text", pick([m[1] for m in MOVES], move).alias("new"), pick([m[2] for m in MOVES], move).alias("edit"), pick([m[3] for m in MOVES], move).alias("to"), F.coalesce(pick([t[1] for t in TAILS], tail), F.lit("")).alias("more"))
    named = lambda c: F.when(c == "s", ROLES["s"]).when(c == "u", ROLES["u"]).otherwise(ROLES["a"])
    added = lambda c, first: F.transform(F.filter(F.split(c, ""), lambda r: r != ""), lambda r, i: row(F.lit(first) + i, F.lit("I"), named(r), F.lit("")))
    kept = F.filter(F.array(row(F.lit(2), F.col("edit"), F.when(F.col("edit") == "R", named(F.col("to"))).otherwise(F.col("role")), F.col("text"))), lambda r: r["edit"] != "D")
    return with_.select("conv_id", "at", F.explode(F.concat(added(F.col("new"), 0), kept, added(F.col("more"), 3))).alias("r")).select("conv_id", "at", "r.*")


def row(place: Column, edit: Column, role: Column, text: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), edit.alias("edit"), role.alias("role"), text.alias("text"))


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id and gaps: turns missing between the first and the last; null turns
    don't count."""
    return rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """COUNTS, audit and repaired_sha256 of each conversation in ids.

    rows have conv_id, turn, role and text; other columns are dropped. A null
    conv_id is a conversation. Rows of a conversation go by turn, nulls first,
    equal turns by role, then text; null roles and texts count as one space.
    Repeated rows are duplicates. A role that starts with another letter than s,
    u or a, or is empty, can't be kept. A conversation without rows has zeros, an
    empty audit and the hash of an empty string; an empty table gives no rows.
    A conversation's signature and audit, one character a row, and the hash over
    its text are made in one task each; the text streams.
    """
    own = ordered(rows)
    each = staged(solved(own), "repair-answers")
    texts = repaired(own, each).select("conv_id", "at", "place", F.concat("role", F.lit(":"), "text").alias("repaired"))
    parts = [ids.select("conv_id").distinct(), gaps(own), each.drop("runs", "plan", "signature"), digests(texts, "conv_id", ["at", "place"], ["repaired"], between="\n").drop("n")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    done = whole.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*COUNTS, "audit", "repaired_sha256")])
    return done.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults put in: crc32 of `conv_id:turn` modulo 20 picks a
    row's. Nulls become one space, in the key too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k")).where("k <> 0")
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)


OP12_SQL = r"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
  lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS k FROM b),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
  count(*) FILTER (open AND NOT seen AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
step(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, i, q2, new) AS (VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
  (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])),
move AS (SELECT ins.q, i, new, e, r, CASE e WHEN 'D' THEN ins.q2 ELSE step.q2 END AS q2 FROM ins JOIN step ON step.q = ins.q2, (VALUES ('K'), ('R'), ('D')) t(e) WHERE e <> 'R' OR r <> 's'),
dp AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS rep FROM s
  UNION ALL SELECT f.conv_id, f.pos, m.q2, dp.cost + 3 * i + CASE e WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN e <> 'D' AND open THEN 3 ELSE 0 END, dp.audit || repeat('I', i) || e,
    dp.rep || new || CASE e WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE m.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] ELSE [] END
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1 JOIN move m ON m.q = dp.q AND (e = 'D' OR NOT blank AND NOT seen) AND (e <> 'K' OR m.r = f.r)
  QUALIFY row_number() OVER (PARTITION BY f.conv_id, m.q2 ORDER BY dp.cost + 3 * i + CASE e WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN e <> 'D' AND open THEN 3 ELSE 0 END, dp.audit || repeat('I', i) || e) = 1),
best AS (SELECT dp.conv_id, cost + 3 * i AS cost, audit || repeat('I', i) AS audit, rep || new AS rep FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND pos = n JOIN ins ON ins.q = dp.q AND q2 IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost + 3 * i, audit || repeat('I', i)) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(rep, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""
