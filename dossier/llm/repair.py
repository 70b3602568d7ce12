"""Repair of conversations by dynamic programming over a grammar.

Every row of a conversation is one symbol: its role's initial and its fault. A grammar of
pairs (Re-Pair, learned from the pair counts of all conversations) shortens the sequences of
symbols. For each symbol there is one min-plus matrix: the cheapest cost and its audit from
each state of the allowed order of roles to each other; a rule's matrix is the product of its
two parts, so it is computed once and serves every conversation. Audits are ropes: a product
only joins two of them, letters are spelled out where a tie has to be settled or at the end.

Equal costs are settled by the audits' letters. Two audits for the same rows, with inserts
counted to the row behind them, never are beginnings of each other, so comparing pieces one
after the other compares the whole. That makes the products associative, and lets a
conversation of any length be cut: a piece of at most ``PIECE`` rows is summed up by the costs
and the order of its sixteen paths, the pieces of a conversation are chained over these few
numbers, and each piece then spells its own part of the result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, column_named

# Costs of the edits, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# Rows of one piece of a conversation. Longer conversations have several; results do not depend on it.
PIECE = 256

# Distinct sequences a task keeps at a time.
KNOWN = 50_000

# Rounds of the grammar and rules that each adds. They bound work, not results.
ROUNDS, RULES = 4, 24

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# States of the allowed order (s?(ua)+)?: nothing yet, after a leading s, after u, after a.
START, LED, USER, ANSWER = range(4)
NEXT = {(START, "s"): LED, (START, "u"): USER, (LED, "u"): USER, (USER, "a"): ANSWER, (ANSWER, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
#: The one initial of user and assistant that may come next.
TURN = {START: "u", LED: "u", USER: "a", ANSWER: "u"}

# Symbols: a row that has to go, then initial times truncated.
GONE = 0
INITIALS = "sua?"


def symbol(role: str, fault: str) -> int:
    """The symbol of a row of a role with ``blank``, ``duplicate``, ``truncated`` or no fault."""
    if fault in ("blank", "duplicate"):
        return GONE
    first = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return 1 + 2 * INITIALS.index(first) + (fault == "truncated")


# A path is its cost and its rope: a letter string, or a pair of ropes. A matrix has paths by
# (state before, state behind).
Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def spell(rope: Rope) -> str:
    """The letters of a rope."""
    out: list[str] = []
    todo = [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += [part[1], part[0]]
    return "".join(out)


def cheaper(x: tuple[int, Rope], y: tuple[int, Rope] | None) -> bool:
    """Whether ``x`` costs less than ``y``, or as much with an audit that sorts before."""
    if y is None or x[0] != y[0]:
        return y is None or x[0] < y[0]
    return spell(x[1]) < spell(y[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    """The cheapest paths through both."""
    out: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for j in range(4):
            if (k, j) in b:
                more, tail = b[k, j]
                path = cost + more, (rope, tail)
                if cheaper(path, out.get((i, j))):
                    out[i, j] = path
    return out


def _inserts() -> Matrix:
    """None, one or two inserted rows."""
    out: Matrix = {(i, i): (0, "") for i in range(4)}
    for i in range(4):
        one = NEXT[i, TURN[i]]
        two = NEXT[one, TURN[one]]
        for j, path in ((one, (INSERT, "I")), (two, (2 * INSERT, "II"))):
            if cheaper(path, out.get((i, j))):
                out[i, j] = path
    return out


def _row_matrix(code: int) -> Matrix:
    """What may become of one row, without inserts."""
    out: Matrix = {(i, i): (DELETE, "D") for i in range(4)}
    if code == GONE:
        return out
    initial, extra = INITIALS[(code - 1) // 2], TRUNCATED * ((code - 1) % 2)
    for i in range(4):
        moves = [(NEXT[i, TURN[i]], (REROLE + extra, "R"))]
        if (i, initial) in NEXT:
            moves.append((NEXT[i, initial], (KEEP + extra, "K")))
        for j, path in moves:
            if cheaper(path, out.get((i, j))):
                out[i, j] = path
    return out


BEFORE = _inserts()


@dataclass
class Grammar:
    """Rules ``pair of symbols -> symbol`` in order, and the matrix of every symbol."""

    rules: list[tuple[bytes, bytes]] = field(default_factory=list)
    matrices: list[Matrix] = field(default_factory=lambda: [product(BEFORE, _row_matrix(c)) for c in range(9)])

    def add(self, pair: bytes) -> None:
        self.rules.append((pair, bytes([len(self.matrices)])))
        self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))

    def encode(self, symbols: bytes) -> bytes:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def matrix(self, symbols: bytes) -> Matrix:
        """The matrix of a sequence; of none, the one that changes nothing."""
        out: Matrix | None = None
        for code in self.encode(symbols):
            out = self.matrices[code] if out is None else product(out, self.matrices[code])
        return {(i, i): (0, "") for i in range(4)} if out is None else out


def learn_grammar(pieces: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """Re-Pair over the column ``symbols``: the most frequent pairs of each round become rules.

    Pairs are counted over all pieces. The driver gets the best ``rules`` pairs of a round.
    """
    grammar = Grammar()
    for _ in range(rounds):
        told = list(grammar.rules)

        def counted(batches: Iterator[pa.RecordBatch], told: list = told) -> Iterator[pa.RecordBatch]:
            known: Counter[bytes] = Counter()
            pairs: Counter[int] = Counter()

            def count() -> None:
                for symbols, n in known.items():
                    for pair, name in told:
                        symbols = symbols.replace(pair, name)
                    for a, b in zip(symbols, symbols[1:], strict=False):
                        pairs[256 * a + b] += n
                known.clear()

            for batch in batches:
                known.update(x.as_py() for x in batch.column(0))
                if len(known) > KNOWN:
                    count()
            count()
            yield pa.record_batch([pa.array(list(x), pa.int64()) for x in (pairs.keys(), pairs.values())], ["pair", "n"])

        counts = pieces.select("symbols").mapInArrow(counted, "pair long, n long")
        best = counts.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair")
        found = [r.pair for r in best.limit(rules).collect()]
        if not found:
            break
        for pair in found:
            grammar.add(bytes([pair // 256, pair % 256]))
    return grammar


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: every row after the damage its key asks for.

    The key is the CRC-32 of ``conv_id:turn``; null values count as one space. A dropped row
    stays as a mark (``gone``) without text, so that its conversation is still known.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = (
        F.when(kind.isin(0, 1), F.lit(""))
        .when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", ""))
        .otherwise(blank("text"))
    )
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return column_named(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _initials(role: str) -> str:
    return role[:1]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    bare = text.strip(SPACE)
    return "blank" if not bare else "duplicate" if seen else "" if bare[-1] in ENDS else "truncated"


@dataclass
class Piece:
    """Consecutive rows of one conversation."""

    conv: object
    at: int
    whole: bool
    turns: list[int | None]
    roles: list[str]
    texts: list[str]
    faults: list[str] = field(default_factory=list)

    def judge(self, seen_before: set[int] = frozenset()) -> None:
        seen: set[tuple[str, str]] = set()
        self.faults = []
        for k, key in enumerate(zip(self.roles, self.texts, strict=True)):
            self.faults.append(fault_of(key[1], key in seen or k in seen_before))
            seen.add(key)

    def symbols(self) -> bytes:
        return bytes(symbol(r, f) for r, f in zip(self.roles, self.faults, strict=True))

    def facts(self) -> dict[str, object]:
        """Counts, and what the neighbours of a piece have to know of it."""
        known = sorted({t for t in self.turns if t is not None})
        pairs = zip(self.roles, self.roles[1:], strict=False)
        return {
            "n": len(self.roles),
            "low": known[0] if known else None,
            "high": known[-1] if known else None,
            "turns": len(known),
            "blank": self.faults.count("blank"),
            "duplicate": self.faults.count("duplicate"),
            "truncated": self.faults.count("truncated"),
            "illegal": sum(not _legal(_initials(a), _initials(b)) for a, b in pairs),
            "first": _initials(self.roles[0]) if self.roles else None,
            "last": _initials(self.roles[-1]) if self.roles else None,
        }

    def repaired(self, audit: str, state: int) -> list[str]:
        """The lines an audit leaves, from a state on."""
        lines, k = [], 0
        for letter in audit:
            if letter == "I":
                lines.append(NAMES[TURN[state]] + ":")
                state = NEXT[state, TURN[state]]
                continue
            role, text = self.roles[k], self.texts[k]
            k += 1
            if letter == "D":
                continue
            initial = TURN[state] if letter == "R" else role[0]
            lines.append((NAMES[initial] if letter == "R" else role) + ":" + text)
            state = NEXT[state, initial]
        return lines


def best_end(paths: Matrix, start: int = START) -> tuple[int, Rope, int]:
    """The cheapest way from a state to an allowed end: cost, audit, inserts at the end counted in."""
    best = None
    for j in (START, ANSWER):
        for k in range(4):
            if (start, k) in paths and (k, j) in BEFORE:
                (cost, rope), (more, tail) = paths[start, k], BEFORE[k, j]
                path = cost + more, (rope, tail)
                if cheaper(path, best[:2] if best else None):
                    best = (*path, j)
    return best


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


_FACTS = "n int, low long, high long, turns int, blank int, duplicate int, truncated int, illegal int, first string, last string"
_PIECE = "at long, whole boolean, turn_list array<long>, roles array<string>, texts array<string>, symbols binary"


def _to_pieces(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``conv_id, turn, role, text, gone`` as pieces, numbered across the table.

    A piece is whole if its conversation surely has no rows elsewhere: it neither touches the
    first or last row of the task's rows nor was it cut.
    """
    at = TaskContext.get().partitionId() << 40
    edge, cut = True, False
    now: Piece | None = None
    ready: list[Piece] = []
    weight = 0

    def packed() -> pa.RecordBatch:
        for p in ready:
            p.judge()
        cols = [[p.conv for p in ready], [p.at for p in ready], [p.whole for p in ready], [p.turns for p in ready]]
        cols += [[p.roles for p in ready], [p.texts for p in ready], [p.symbols() for p in ready]]
        types = [conv_type, pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.list_(pa.string())] * 2, pa.binary()]
        names = ["conv_id", "at", "whole", "turn_list", "roles", "texts", "symbols"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for batch in batches:
        for conv, turn, role, text, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            at += 1
            if now is None or conv != now.conv or len(now.roles) == PIECE:
                if now is not None:
                    cut = conv == now.conv
                    now.whole = now.whole and not cut
                    ready.append(now)
                    weight += sum(map(len, now.texts)) + 50
                    edge = False
                now = Piece(conv, at, not edge and not cut, [], [], [])
                if weight > 2_000_000:
                    yield packed()
                    ready, weight = [], 0
            if not gone:
                now.turns.append(turn)
                now.roles.append(role)
                now.texts.append(text)
    if now is not None:
        now.whole = False
        ready.append(now)
    if ready:
        yield packed()


def _each_piece(batch: pa.RecordBatch) -> Iterator[Piece]:
    names = ("conv_id", "at", "whole", "turn_list", "roles", "texts")
    for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
        yield Piece(*row)


_ANSWER = [
    ("gaps", "long"),
    ("blank", "long"),
    ("duplicate", "long"),
    ("truncated", "long"),
    ("illegal", "long"),
    ("cost", "long"),
    ("audit", "string"),
    ("repaired_sha256", "string"),
]


def _finish_whole(batches: Iterator[pa.RecordBatch], grammar: Grammar, conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Answers of conversations that are one piece. Equal sequences share their audit."""
    known: dict[bytes, tuple[int, str]] = {}
    for batch in batches:
        out: list[tuple] = []
        for piece in _each_piece(batch):
            piece.judge()
            facts, symbols = piece.facts(), piece.symbols()
            if symbols not in known:
                if len(known) > KNOWN:
                    known.clear()
                cost, rope, _ = best_end(grammar.matrix(symbols))
                known[symbols] = cost, spell(rope)
            cost, audit = known[symbols]
            lines = piece.repaired(audit, START)
            out.append(
                (
                    piece.conv,
                    _gaps(facts["low"], facts["high"], facts["turns"]),
                    *[facts[k] for k in ("blank", "duplicate", "truncated", "illegal")],
                    cost,
                    audit,
                    hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest(),
                )
            )
        yield _answer_batch(out, conv_type)


def _answer_batch(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64() if t == "long" else pa.string() for _, t in _ANSWER]]
    cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
    return pa.record_batch(
        [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["conv_id", *[n for n, _ in _ANSWER]]
    )


def _ranked(paths: Matrix) -> tuple[list[int | None], list[int | None]]:
    """Costs of the sixteen paths, and the order of their audits."""
    words = {key: spell(rope) for key, (_, rope) in paths.items()}
    order = {word: k for k, word in enumerate(sorted(set(words.values())))}
    keys = [(i, j) for i in range(4) for j in range(4)]
    return [paths[k][0] if k in paths else None for k in keys], [order[words[k]] if k in words else None for k in keys]


class Chain:
    """The cheapest way through the pieces of one conversation, from their costs and orders alone.

    Fed piece by piece; keeps a few numbers of each, and tells the states at both ends.
    """

    def __init__(self) -> None:
        # state -> (cost, rank among the four ways); ways back as (state before) per piece and state.
        self.ways: dict[int, tuple[int, int]] = {START: (0, 0)}
        self.back: list[dict[int, int]] = []

    def feed(self, costs: list[int | None], ranks: list[int | None]) -> None:
        best: dict[int, tuple[int, int, int, int]] = {}
        for i, (cost, rank) in self.ways.items():
            for j in range(4):
                if (more := costs[4 * i + j]) is not None:
                    way = cost + more, rank, ranks[4 * i + j], i
                    if j not in best or way < best[j]:
                        best[j] = way
        self.back.append({j: w[3] for j, w in best.items()})
        order = {w: k for k, w in enumerate(sorted({(w[1], w[2]) for w in best.values()}))}
        self.ways = {j: (w[0], order[w[1], w[2]]) for j, w in best.items()}

    def end(self) -> tuple[int, str, list[tuple[int, int]]]:
        """Cost, letters behind the last row, and the states before and behind every piece."""
        ends = []
        for k, (cost, rank) in self.ways.items():
            for j in (START, ANSWER):
                if (k, j) in BEFORE:
                    more, tail = BEFORE[k, j]
                    ends.append((cost + more, rank, tail, k))
        cost, _, tail, state = min(ends)
        states = []
        for step in reversed(self.back):
            states.append((step[state], state))
            state = step[state]
        return cost, tail, states[::-1]


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    One row per conversation of ``conv_id, turn, role, text`` (and ``gone``, as ``damaged``
    gives it). Rows stand in the order of turn (nulls first), role, text. Null roles and texts
    count as one space; rows without a conversation's id are one conversation. Faults, edits and
    costs are those at the top of the module; among cheapest audits the first in ASCII order is
    taken. Repeated rows are duplicates of the first. ``gaps`` leaves out null turns and is 0
    where all are. A conversation without rows has zeros, an empty audit and the hash of the
    empty string. An empty table gives no rows. Other columns are not read.

    Rows are sorted into ranges of conversation and turn, so a conversation of any length is
    dealt over tasks in pieces. Only conversations of several pieces need more: their rows'
    hashes meet once to find duplicates, sixteen costs per piece are chained, and each piece
    then spells its part. SHA-256 has to see a repaired conversation in order, so the parts of
    one stream through one task, without being held.
    """
    spark = conversations.sparkSession
    store = Stored(spark, "repair")
    if "gone" not in conversations.columns:
        conversations = column_named(conversations, "conv_id", "turn", "role", "text").withColumn("gone", F.lit(False))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        "gone",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = ranged.sortWithinPartitions("conv_id", "turn", "role", "text")
    id_type = conversations.schema["conv_id"].dataType
    conv_sql, conv_pa = id_type.simpleString(), pa.string() if isinstance(id_type, T.StringType) else pa.int64()
    if not isinstance(id_type, (T.StringType, T.LongType)):
        ordered, conv_sql, conv_pa = ordered.withColumn("conv_id", F.col("conv_id").cast("string")), "string", pa.string()
    pieces = store.write(ordered.mapInArrow(lambda it: _to_pieces(it, conv_pa), f"conv_id {conv_sql}, {_PIECE}"))
    grammar = learn_grammar(pieces)
    told = spark.sparkContext.broadcast(grammar)
    answer = f"conv_id {conv_sql}, " + ", ".join(f"{c} {t}" for c, t in _ANSWER)
    whole = pieces.filter("whole").mapInArrow(lambda it: _finish_whole(it, told.value, conv_pa), answer)
    cut = _finish_cut(store, pieces.filter("not whole"), told, conv_sql, conv_pa)
    out = whole.unionByName(cut)
    return out.withColumn("conv_id", F.col("conv_id").cast(id_type))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _finish_cut(store: Stored, pieces: DataFrame, told, conv_sql: str, conv_pa: pa.DataType) -> DataFrame:
    """Answers of conversations whose rows lie in several pieces, or may do so."""
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # Where a role and text stood in an earlier piece of the conversation.
    each = pieces.select("conv_id", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("k", "r"))
    each = each.select("conv_id", "at", "k", F.sha2(F.to_json("r"), 256).alias("h"))
    met = each.groupBy("conv_id", "h").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last")
    later = each.alias("e").join(met.alias("m"), _same(F.col("e.conv_id"), F.col("m.conv_id")) & (F.col("e.h") == F.col("m.h")))
    seen = later.filter("at > first").groupBy("at").agg(F.collect_list("k").alias("seen"))
    judged = store.write(pieces.join(seen, "at", "left"))

    def pieces_of(batch: pa.RecordBatch) -> Iterator[Piece]:
        for piece, seen in zip(_each_piece(batch), batch.column("seen").to_pylist(), strict=True):
            piece.judge(set(seen or ()))
            yield piece

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece in pieces_of(batch):
                costs, ranks = _ranked(told.value.matrix(piece.symbols()))
                out.append({"conv_id": piece.conv, "at": piece.at, "costs": costs, "ranks": ranks, **piece.facts()})
            yield pa.RecordBatch.from_pylist(out, schema=_sum_schema(conv_pa))

    sums = judged.mapInArrow(summed, f"conv_id {conv_sql}, at long, costs array<int>, ranks array<int>, {_FACTS}")
    lined = sums.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at")
    chained = store.write(
        lined.mapInArrow(
            lambda it: _chained(it, conv_pa),
            f"conv_id {conv_sql}, at long, before int, behind int, tail string, "
            "gaps long, blank long, duplicate long, truncated long, illegal long, cost long",
        )
    )

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ways = zip(*[batch.column(c).to_pylist() for c in ("before", "behind", "tail")], strict=True)
            for piece, (before, behind, tail) in zip(pieces_of(batch), ways, strict=True):
                audit = spell(told.value.matrix(piece.symbols())[before, behind][1])
                lines = piece.repaired(audit, before)
                state = behind
                for _ in tail or "":
                    lines.append(NAMES[TURN[state]] + ":")
                    state = NEXT[state, TURN[state]]
                out.append(
                    {
                        "conv_id": piece.conv,
                        "at": piece.at,
                        "letters": audit + (tail or ""),
                        "lines": "\n".join(lines) if lines else None,
                    }
                )
            yield pa.RecordBatch.from_pylist(
                out,
                schema=pa.schema(
                    [("conv_id", conv_pa), ("at", pa.int64()), ("letters", pa.string()), ("lines", pa.string())]
                ),
            )

    ways = chained.select("at", "before", "behind", "tail")
    parts = judged.join(ways, "at").mapInArrow(spelled, f"conv_id {conv_sql}, at long, letters string, lines string")
    streamed = parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at")
    ends = streamed.mapInArrow(
        lambda it: _hashed(it, conv_pa), f"conv_id {conv_sql}, audit string, repaired_sha256 string"
    )
    facts = chained.filter("cost is not null").drop("at", "before", "behind", "tail")
    joined = facts.alias("f").join(ends.alias("e"), _same(F.col("f.conv_id"), F.col("e.conv_id")))
    return joined.select("f.*", "e.audit", "e.repaired_sha256").select("conv_id", *[c for c, _ in _ANSWER])


def _sum_schema(conv_pa: pa.DataType) -> pa.Schema:
    small = [("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("n", pa.int32())]
    ends = [("low", pa.int64()), ("high", pa.int64())]
    counts = [(c, pa.int32()) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("conv_id", conv_pa), ("at", pa.int64()), *small, *ends, *counts, ("first", pa.string()), ("last", pa.string())])


def _by_conversation(batches: Iterator[pa.RecordBatch], take: Callable[[dict], None], close: Callable[[], Iterator]) -> Iterator:
    """Feeds sorted rows to ``take`` and yields what ``close`` gives at the end of a conversation."""
    conv, begun = None, False
    for batch in batches:
        for row in batch.to_pylist():
            if begun and row["conv_id"] != conv:
                yield from close()
            conv, begun = row["conv_id"], True
            take(row)
    if begun:
        yield from close()


def _chained(batches: Iterator[pa.RecordBatch], conv_pa: pa.DataType) -> Iterator[pa.RecordBatch]:
    """States at the ends of every piece; the first piece of a conversation carries its sums."""
    chain, rows = Chain(), []

    def take(row: dict) -> None:
        chain.feed(row.pop("costs"), row.pop("ranks"))
        rows.append(row)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal chain
        cost, tail, states = chain.end()
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        low = high = last = None
        for row in rows:
            for k in total:
                total[k] += row[k]
            if row["low"] is not None:
                total["turns"] -= high == row["low"]
                low, high = row["low"] if low is None else low, row["high"]
            if row["n"]:
                total["illegal"] += last is not None and not _legal(last, row["first"])
                last = row["last"]
        facts = {"gaps": _gaps(low, high, total.pop("turns")), **total, "cost": cost}
        out = []
        for k, (row, (before, behind)) in enumerate(zip(rows, states, strict=True)):
            one = {"conv_id": row["conv_id"], "at": row["at"], "before": before, "behind": behind}
            one["tail"] = tail if k == len(rows) - 1 else None
            out.append(one | (facts if k == 0 else dict.fromkeys(facts)))
        rows.clear()
        chain = Chain()
        names = [("before", pa.int32()), ("behind", pa.int32()), ("tail", pa.string()), *[(c, pa.int64()) for c in facts]]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", conv_pa), ("at", pa.int64()), *names]))

    yield from _by_conversation(batches, take, close)


def _hashed(batches: Iterator[pa.RecordBatch], conv_pa: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation, from its parts in order."""
    digest, letters, conv, some = hashlib.sha256(), [], None, False

    def take(row: dict) -> None:
        nonlocal conv, some
        conv = row["conv_id"]
        letters.append(row["letters"])
        if row["lines"] is not None:
            digest.update((("\n" if some else "") + row["lines"]).encode("utf-8", "surrogatepass"))
            some = True

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal digest, some
        out = [[conv], ["".join(letters)], [digest.hexdigest()]]
        letters.clear()
        digest, some = hashlib.sha256(), False
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(out, (conv_pa, pa.string(), pa.string()), strict=True)],
            ["conv_id", "audit", "repaired_sha256"],
        )

    yield from _by_conversation(batches, take, close)
