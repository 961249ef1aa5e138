"""Conversation repair by grammar-compressed dynamic programming.

A conversation is the sequence of its rows' symbols: what a row's role begins with, or the fault for which it must go, in
lower case if the row is whole and in upper case if it is truncated. The cheapest edits that make the roles
`(s?(ua)+)?` are a path through four states (start, after s, after u, after a). A stretch of rows is a min-plus transfer
matrix: for each pair of states the least cost and, among the edits of that cost, the least audit. Two audits of one
stretch and pair of states are never one the beginning of the other (more inserts cost more), so the least of a whole is
made of the least of its parts.

* Re-Pair. Pairs of symbols that are frequent in all conversations become rules, round by round; the grammar is shared, and
  so are its matrices: one for each rule, made bottom-up from the two it stands for. Audits are ropes: a rule's audit is
  two pointers, compared by hash and length down to the first difference. The grammar never decides a result; it has at
  most `MOST_RULES` rules, and what they don't cover is multiplied symbol by symbol.
* Stretches. Rows are sorted by conversation and turn over all tasks, so a long conversation is spread. A stretch is at
  most `STRETCH` rows of one conversation in one task; equal stretches are evaluated once. Conversations of several
  stretches are put together in a tree.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import bounded, materialize

STRETCH = 4096
MOST_RULES = 2048
#: Stretches that one step of the tree puts together.
FAN = 16
_FIRST = 256  # the number of the first rule; symbols of rows are below
_PLAIN = "[^\x20\x09-\x0d]"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


# --- audits as ropes -------------------------------------------------------------------------------------------------

_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A text of edit initials: a leaf, or two ropes."""

    __slots__ = ("left", "right", "size", "hash", "power")

    def __init__(self, left, right=None):
        self.left, self.right = left, right
        if right is None:
            self.size, self.hash, self.power = len(left), 0, pow(_BASE, len(left), _MOD)
            for c in left:
                self.hash = (self.hash * _BASE + ord(c)) % _MOD
        else:
            self.size, self.power = left.size + right.size, left.power * right.power % _MOD
            self.hash = (left.hash * right.power + right.hash) % _MOD

    def __add__(self, other: Rope) -> Rope:
        return self if not other.size else other if not self.size else Rope(self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.right is None:
                out.append(r.left)
            else:
                todo += (r.right, r.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        xs, ys = [self], [other]
        while xs and ys:
            x, y = xs.pop(), ys.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.right is None and y.right is None:
                n = min(x.size, y.size)
                if x.left[:n] != y.left[:n]:
                    return x.left < y.left
                (xs if x.size > n else ys).append(Rope((x if x.size > n else y).left[n:]))
            elif y.right is None or x.size >= y.size and x.right is not None:
                xs += (x.right, x.left)
                ys.append(y)
            else:
                ys += (y.right, y.left)
                xs.append(x)
        return bool(ys)


# --- transfer matrices -----------------------------------------------------------------------------------------------

Matrix = dict[tuple[int, int], tuple[int, Rope]]


def times(x: Matrix, y: Matrix) -> Matrix:
    """The matrix of two neighbouring stretches."""
    out: Matrix = {}
    for (i, j), (c, a) in x.items():
        for k in range(4):
            if (e := y.get((j, k))) is None:
                continue
            cost, now = c + e[0], out.get((i, k))
            if now is None or cost < now[0] or cost == now[0] and a + e[1] < now[1]:
                out[i, k] = cost, a + e[1]
    return out


def _next(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, if the pattern allows it."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return None if state == AFTER_U else AFTER_U
    return AFTER_A if initial == "a" and state == AFTER_U else None


@lru_cache(maxsize=1)
def inserts() -> Matrix:
    """Inserting turns, as few as lead from one state to another, or none."""
    step = {(i, j): (INSERT, Rope("I")) for i in range(4) for r in "ua" if (j := _next(i, r)) is not None}
    out: Matrix = {(i, i): (0, Rope("")) for i in range(4)}
    for _ in range(2):
        longer = times(out, step)
        out = {k: min(out.get(k, longer.get(k)), longer.get(k, out.get(k)), key=lambda e: e[0]) for k in out.keys() | longer.keys()}
    return out


@lru_cache(maxsize=64)
def of_symbol(symbol: int) -> Matrix:
    """Inserts before a row, then what is done with it."""
    letter = chr(symbol)
    extra = TRUNCATED if letter.isupper() else 0
    row: Matrix = {(i, i): (DELETE, Rope("D")) for i in range(4)}
    if letter not in "xy":
        for i in range(4):
            for r in "sua":
                if (j := _next(i, r)) is not None:
                    edit = (extra, Rope("K")) if r == letter.lower() else (extra + REROLE, Rope("R")) if r != "s" else None
                    if edit and ((i, j) not in row or edit[0] < row[i, j][0]):
                        row[i, j] = edit
    return times(inserts(), row)


class Grammar:
    """Rules by number from `_FIRST`, each a pair of symbols or earlier rules, with the matrices met so far."""

    def __init__(self, rounds: list[list[tuple[int, int]]]):
        self.rounds, self.rules, self.made = [], {}, {}
        for pairs in rounds:
            numbered = {p: _FIRST + len(self.rules) + i for i, p in enumerate(pairs)}
            self.rules |= {n: p for p, n in numbered.items()}
            self.rounds.append(numbered)

    def compress(self, symbols: list[int]) -> list[int]:
        for pairs in self.rounds:
            out, i = [], 0
            while i < len(symbols):
                rule = pairs.get((symbols[i], symbols[i + 1])) if i + 1 < len(symbols) else None
                out.append(symbols[i] if rule is None else rule)
                i += 1 if rule is None else 2
            symbols = out
        return symbols

    def matrix(self, symbol: int) -> Matrix:
        """Of a symbol or rule; rules are evaluated once, after those that they stand for."""
        if symbol < _FIRST:
            return of_symbol(symbol)
        if symbol not in self.made:
            x, y = self.rules[symbol]
            self.made[symbol] = times(self.matrix(x), self.matrix(y))
        return self.made[symbol]

    def of(self, symbols: str) -> Matrix:
        """Of a stretch of rows."""
        parts = [self.matrix(s) for s in self.compress([ord(c) for c in symbols])]
        while len(parts) > 1:  # as a tree, so that ropes are shallow
            parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else {(i, i): (0, Rope("")) for i in range(4)}


def cheapest(rows: Matrix) -> tuple[int, str]:
    """Cost and audit of the rows of a whole conversation: from the start to an end that the pattern allows."""
    ends = times(rows, inserts())
    cost, audit = min((ends[START, j] for j in (START, AFTER_A) if (START, j) in ends), key=lambda e: (e[0], e[1]))
    return cost, str(audit)


def pair_rules(stretches: DataFrame, least: int = 2) -> list[list[tuple[int, int]]]:
    """Rounds of Re-Pair rules over (symbols, n), n counting how often a stretch is there. A round takes frequent pairs of
    which none can overlap another: no symbol ends one and begins another. At most `MOST_RULES` pairs reach the driver."""
    rounds: list[list[tuple[int, int]]] = []
    total = 0
    while total < MOST_RULES:

        def count(batches: Iterator[pa.RecordBatch], rounds=tuple(map(tuple, rounds))) -> Iterator[pa.RecordBatch]:
            grammar, seen = Grammar(rounds), Counter()
            for batch in batches:
                for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s, last = grammar.compress([ord(c) for c in text]), None
                    for at, pair in enumerate(zip(s, s[1:])):
                        if pair[0] == pair[1] and last == (at - 1, pair):
                            last = None  # a run of one symbol: each row once
                            continue
                        last = at, pair
                        seen[pair] += n
            a, b = ([p[i] for p in seen] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])

        found = stretches.select("symbols", "n").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        first, last, taken = set(), set(), []
        for r in found.where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(256).collect():
            if r.a not in last and r.b not in first and (r.a != r.b or not (r.a in first or r.b in last)):
                taken.append((r.a, r.b))
                first.add(r.a)
                last.add(r.b)
        taken = taken[: MOST_RULES - total]
        if not taken:
            break
        rounds.append(taken)
        total += len(taken)
    return rounds


# --- Spark -----------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the crc32 of `conv_id:turn` says; nulls count as one space."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *as_text).cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    made = rows.select(
        "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return made.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` with two hashes of role and text, which stand for them."""
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("repair"), "text", "role")})


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, symbol) without the text: x for a blank row, y for one whose role and text were there
    before, else the role's initial (o for any other), in upper case if the last character isn't one of .!?"""
    solid = F.col("text").rlike(_PLAIN)
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0d]*\z")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    thin = _keyed(rows).select("conv_id", "turn", "role", "h1", "h2", F.when(~solid, "x").when(whole, initial).otherwise(F.upper(initial)).alias("symbol"))
    # which of the rows of one role and text comes first; equal rows of one turn are alike, so any of them may
    nth = F.row_number().over(Window.partitionBy("conv_id", "h1", "h2").orderBy(F.col("turn").asc_nulls_first()))
    return thin.withColumn("nth", nth).withColumn("symbol", F.when((F.col("symbol") != "x") & (F.col("nth") > 1), "y").otherwise(F.col("symbol"))).drop("nth")


_ORDER = ["role", "h1", "h2"]  # of rows of one turn


def stretches(thin: DataFrame, most: int = STRETCH) -> DataFrame:
    """(conv_id, k, symbols): the rows of each conversation in order, cut into stretches, k in order."""
    ids = thin.schema["conv_id"].dataType.simpleString()
    n = int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *_ORDER]
    dealt = thin.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "symbol", F.monotonically_increasing_id().alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, letters = None, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held, pa.array([at], pa.int64()), pa.array(["".join(letters)])], names=["conv_id", "k", "symbols"])

        for batch in batches:
            ids_, letter, k = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            values = ids_.to_pylist()
            now = held[0].as_py() if held is not None else None
            for i, value in enumerate(values):
                if held is None or value != now or len(letters) >= most:
                    if held is not None:
                        yield out()
                    held, now, at, letters = ids_.slice(i, 1), value, k[i], []
                letters.append(letter[i])
        if held is not None:
            yield out()

    return dealt.mapInArrow(run, f"conv_id {ids}, k long, symbols string")


_MATRIX = "array<struct<i: int, j: int, cost: bigint, audit: string>>"
_MATRIX_TYPE = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _written(m: Matrix) -> list[dict]:
    return [{"i": i, "j": j, "cost": c, "audit": str(a)} for (i, j), (c, a) in m.items()]


def _matrix(cells: list[dict]) -> Matrix:
    return {(c["i"], c["j"]): (c["cost"], Rope(c["audit"])) for c in cells}


def audits(parts: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, blank, duplicate, truncated) of conversations cut into stretches (conv_id, k, symbols)."""
    ids = parts.schema["conv_id"].dataType.simpleString()
    distinct = materialize(parts.groupBy("symbols").agg(F.count("*").alias("n")), "repair-distinct")
    rounds = pair_rules(distinct)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rounds)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                m = grammar.of(text)
                cost, audit = cheapest(m)
                yield pa.RecordBatch.from_arrays([pa.array([text]), pa.array([_written(m)], _MATRIX_TYPE), pa.array([cost], pa.int64()), pa.array([audit])], names=["symbols", "matrix", "cost", "audit"])

    made = materialize(distinct.mapInArrow(evaluate, f"symbols string, matrix {_MATRIX}, cost long, audit string"), "repair-matrices")
    truncated = F.length(F.regexp_replace("symbols", "[^SUAO]", ""))
    counted = parts.withColumns({
        "blank": F.length(F.regexp_replace("symbols", "[^x]", "")).cast("long"),
        "duplicate": F.length(F.regexp_replace("symbols", "[^y]", "")).cast("long"),
        "truncated": truncated.cast("long"),
    })
    whole = counted.groupBy("conv_id").agg(F.count("*").alias("parts"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.first("symbols").alias("symbols"))
    whole = materialize(whole, "repair-counts")
    one = whole.where("parts = 1").join(made.select("symbols", "cost", "audit"), "symbols").select("conv_id", "cost", "audit", "blank", "duplicate", "truncated")
    several = whole.where("parts > 1").drop("symbols", "parts")
    if several.isEmpty():
        return one
    of = several.select("conv_id").alias("s")
    now = parts.alias("p").join(of, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.*")
    numbered = _numbered(now).join(made.select("symbols", "matrix"), "symbols").select("conv_id", "k", "parts", "matrix")
    now = materialize(numbered, "repair-parts")
    most = now.agg(F.max("parts")).first()[0]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out() -> pa.RecordBatch:
            m = reduce(times, held[2])
            return pa.RecordBatch.from_arrays([held[1], pa.array([held[0][1]], pa.int64()), pa.array([held[0][2]], pa.int64()), pa.array([_written(m)], _MATRIX_TYPE)], names=["conv_id", "k", "parts", "matrix"])

        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                key = r["conv_id"], r["k"] // FAN, -(-r["parts"] // FAN)
                if held and held[0] == key:
                    held[2].append(_matrix(r["matrix"]))
                    continue
                if held:
                    yield out()
                held = key, batch.column(0).slice(i, 1), [_matrix(r["matrix"])]
        if held:
            yield out()

    while most > 1:
        dealt = now.withColumn("g", F.floor(F.col("k") / FAN)).repartition("conv_id", "g").sortWithinPartitions("conv_id", "k").drop("g")
        now = materialize(dealt.mapInArrow(put_together, f"conv_id {ids}, k long, parts long, matrix {_MATRIX}"), "repair-parts")
        most = -(-most // FAN)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cheapest(_matrix(m)) for m in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["conv_id", "cost", "audit"])

    ended = now.mapInArrow(end, f"conv_id {ids}, cost long, audit string").alias("e")
    joined = ended.join(several.alias("c"), F.col("e.conv_id").eqNullSafe(F.col("c.conv_id")))
    return one.unionAll(joined.select("e.*", "c.blank", "c.duplicate", "c.truncated"))


def _numbered(parts: DataFrame) -> DataFrame:
    """Stretches of long conversations with their number from 0 in column k, and how many there are."""
    w = Window.partitionBy("conv_id")
    return parts.withColumn("parts", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("k")).cast("long") - 1)


def _applied(rows: DataFrame, found: DataFrame, ids_of: DataFrame, texts: bool) -> DataFrame:
    """By conversation its gaps, illegal neighbours, repaired_sha256 and, with `texts`, the repaired rows: rows in order,
    behind their audit. One pass, which holds the audit of one conversation and one batch of rows."""
    ids = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    none = [F.lit(None).cast(t) for t in (turn, "string", "string", "bigint", "bigint")]
    names = ["conv_id", "kind", "turn", "role", "text", "h1", "h2", "cost", "audit", "blank", "duplicate", "truncated"]
    zero = [F.lit(0).cast("long") if c not in ("audit",) else F.lit("") for c in names[7:]]
    all_rows = (
        ids_of.select("conv_id", F.lit(0), *none, *zero)
        .unionAll(found.select("conv_id", F.lit(1), *none, *names[7:]))
        .unionAll(_keyed(rows).select("conv_id", F.lit(2), *names[2:7], *zero))
        .toDF(*names)
    )
    dealt = all_rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), *_ORDER)
    out_names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out() -> pa.RecordBatch:
            now.inserts()
            return pa.RecordBatch.from_arrays(
                [now.id, *(pa.array([v], pa.int64()) for v in (now.gaps(), now.blank, now.duplicate, now.truncated, now.illegal, now.cost)), pa.array([now.audit]), pa.array([now.digest.hexdigest()]), pa.array([now.lines], pa.list_(pa.string()))],
                names=out_names,
            )

        for batch in batches:
            ids_ = batch.column(0)
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for i, (value, kind) in enumerate(zip(columns[0], columns[1], strict=True)):
                if kind == 0:
                    if now is not None:
                        yield out()
                    now = Repair(ids_.slice(i, 1), texts)
                elif kind == 1:
                    now.cost, now.audit, now.blank, now.duplicate, now.truncated = (columns[c][i] for c in range(7, 12))
                else:
                    now.row(columns[2][i], columns[3][i], columns[4][i])
        if now is not None:
            yield out()

    return dealt.mapInArrow(run, f"conv_id {ids}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<string>")


class Repair:
    """A conversation whose rows come in order, with the audit that says what is done with each."""

    def __init__(self, id_: pa.Array, keep: bool):
        self.id, self.lines = id_, [] if keep else None
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit, self.at, self.state = "", 0, START
        self.digest, self.empty = hashlib.sha256(), True
        self.least = self.last = self.before = None
        self.turns = 0

    def line(self, role: str, text: str, initial: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty, self.state = False, _next(self.state, initial)
        if self.lines is not None:
            self.lines.append(f"{role}:{text}")

    def wanted(self) -> str:
        return "assistant" if self.state == AFTER_U else "user"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role = self.wanted()
            self.line(role, "", role[0])

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text, initial)
        elif edit == "R":
            role = self.wanted()
            self.line(role, text, role[0])

    def gaps(self) -> int:
        return 0 if self.last is None else self.last - self.least + 1 - self.turns


def repair(rows: DataFrame, all_ids: DataFrame | None = None, texts: bool = True, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text), and per conv_id of `all_ids`: conv_id, gaps (turns
    missing between the least and the greatest), blank, duplicate, truncated (rows by first fault), illegal (neighbours
    whose roles' initials aren't su, ua or au), cost, audit (the cheapest edits' initials, the least of equal ones),
    repaired_sha256 and, with `texts`, repaired, the lines `role:text` that are left.

    Defined cases: a null role or text is one space, so such a text is blank; null turns come first and make no gap; rows
    of one turn are ordered by role and by hashes of role and text, so repeated rows are neighbours and all but the first
    are duplicates; a null conv_id is a conversation of its own; one without rows has zeros, an empty audit and the digest
    of nothing; an empty table gives an empty table; other columns are ignored, whatever their names. Whole texts count. A
    conversation's digest is made by one task, row by row, as its rows must be hashed in order.
    """
    rows = bounded(rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]))
    ids_of = (rows if all_ids is None else all_ids).select("conv_id").distinct()
    parts = materialize(stretches(symbols(rows), stretch), "repair-stretches")
    out = _applied(rows, audits(parts), ids_of, texts)
    return out if texts else out.drop("repaired")
