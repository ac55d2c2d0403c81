"""Repairs the turn structure of conversations by the cheapest edits.

The roles of a repaired conversation read (s?(ua)+)?: an optional system turn, then user and assistant in turn. Edits
of a row: Keep costs 0, Rerole (to user or assistant) 2, Delete 3; blank and duplicate rows must be deleted, a
truncated row that isn't deleted costs 1 more. Insert (an empty user or assistant turn, anywhere) costs 2. The edits
form a lattice of nodes (row, state of the roles so far). A bidirectional Dijkstra search runs over it: a forward heap
from the start and a reverse heap from the goals, until the sum of their least costs exceeds the best crossing, so that
all equal-cost crossings are finished; of these the least concatenated audit is taken. Two audits of equal cost between
the same nodes are never each other's beginning (the rest would be inserts, which cost), so that the least whole audit
is made of least parts.

Scale: rows are range-partitioned and sorted by conversation, turn, role and text digest, so that a conversation with a
third of all rows is spread over many tasks. Each task streams its rows and searches blocks of at most BLOCK rows or
BLOCK_BYTES bytes. A conversation that is one block inside a task is finished there. Of others (longer ones, and the
first and last of a task) each block gets the cheapest audits between all pairs of states, one task per conversation
chains these over narrow rows, and the blocks, still spread, apply their share. First occurrences are found by a
pre-aggregated minimum of turns per role and text, which is sorted in with the rows as markers.

Cases: null roles and texts are one space (such rows are deleted, as blank texts are); a null conv_id is a conversation
of its own; null turns come first and count in no gap. Rows of one turn are ordered by role and text digest; repeated
rows are duplicates but for one. Very long texts are carried through and never compared. Roles are known by their first
letter (s, u, a). A conversation with no rows left has zeros, an empty audit and no turns. Columns other than conv_id,
turn, role and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import SPACES, materialize

BLOCK = 256
BLOCK_BYTES = 4_000_000
STATES = range(4)  # nothing yet, after system, after user, after assistant
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLE = {"u": "user", "a": "assistant"}
_COUNTS = ("blank", "duplicate", "truncated")
_TURNS = "array<struct<role:string,text:string>>"


def damage(turns: DataFrame) -> DataFrame:
    """turns with five faults by crc32(conv_id:turn) % 20, and `absent`, true for rows that are dropped but still name their conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("absent"), times.alias("_")).drop("_")


def moves(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, next state) of a row at a state; code is the role's first letter and the first fault: . none, b blank, d duplicate, t truncated."""
    yield 3, "D", state
    if code[1] in ".t":
        late = int(code[1] == "t")
        if (state, code[0]) in _STEP:
            yield late, "K", _STEP[state, code[0]]
        for role in "ua":
            if (state, role) in _STEP:
                yield 2 + late, "R", _STEP[state, role]


def inserts(state: int) -> Iterator[int]:
    return (_STEP[state, role] for role in "ua" if (state, role) in _STEP)


class _Side:
    """One of the two searches: labels (cost, audit) of nodes, settled in the order of cost, then of rows passed, as edges that cost nothing always pass a row."""

    def __init__(self, roots: Iterable[tuple[int, int]], edges, reverse: bool):
        self.edges, self.reverse = edges, reverse
        self.label = {node: (0, "") for node in roots}
        self.heap = [(0, self.passed(node), node) for node in self.label]
        heapq.heapify(self.heap)
        self.settled: set[tuple[int, int]] = set()

    def passed(self, node: tuple[int, int]) -> int:
        return -node[0] if self.reverse else node[0]

    def least(self) -> float:
        while self.heap and self.heap[0][2] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        node = heapq.heappop(self.heap)[2]
        self.settled.add(node)
        cost, audit = self.label[node]
        for more, edit, other in self.edges(node):
            found = (cost + more, edit + audit if self.reverse else audit + edit)
            if other not in self.settled and (other not in self.label or found < self.label[other]):
                if other not in self.label or found[0] < self.label[other][0]:
                    heapq.heappush(self.heap, (found[0], self.passed(other), other))
                self.label[other] = found
        return node


@lru_cache(maxsize=20_000)
def cheapest(codes: str, start: int = 0, goals: tuple[int, ...] = (0, 3)) -> tuple[int, str] | None:
    """The least (cost, audit) from state `start` before the rows, of two letters each, to one of `goals` after them."""
    n = len(codes) // 2

    def ahead(node):
        row, state = node
        if row < n:
            for cost, edit, to in moves(codes[2 * row : 2 * row + 2], state):
                yield cost, edit, (row + 1, to)
        for to in inserts(state):
            yield 2, "I", (row, to)

    def back(node):
        row, state = node
        if row:
            for origin in STATES:
                for cost, edit, to in moves(codes[2 * row - 2 : 2 * row], origin):
                    if to == state:
                        yield cost, edit, (row - 1, origin)
        for origin in STATES:
            if state in inserts(origin):
                yield 2, "I", (row, origin)

    forward, reverse = _Side([(0, start)], ahead, False), _Side([(n, g) for g in goals], back, True)
    best = float("inf")
    while forward.least() + reverse.least() <= best and (forward.heap and reverse.heap):
        side, other = (forward, reverse) if forward.least() <= reverse.least() else (reverse, forward)
        node = side.settle()
        if node in other.settled:
            best = min(best, side.label[node][0] + other.label[node][0])
        for cost, _, to in side.edges(node):
            if to in other.settled:
                best = min(best, side.label[node][0] + cost + other.label[to][0])
    if best == float("inf"):
        return None
    met = [forward.label[x][1] + reverse.label[x][1] for x in forward.settled & reverse.settled if forward.label[x][0] + reverse.label[x][0] == best]
    for x in forward.settled:
        cost, audit = forward.label[x]
        met += [audit + edit + reverse.label[to][1] for more, edit, to in ahead(x) if to in reverse.settled and cost + more + reverse.label[to][0] == best]
    return int(best), min(met)


def apply(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[dict], int]:
    """The turns that an audit makes of rows (role, text) from a state, and the state after them."""
    left, made = iter(rows), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = _ROLE["a" if state == 2 else "u"]
        made.append({"role": role, "text": text})
        state = _STEP[state, role[:1]]
    return made, state


class _Block:
    """Rows of one conversation that follow one another, and what they count."""

    def __init__(self, conv, head: bool, part: int):
        self.conv, self.head, self.part = conv, head, part
        self.rows: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.bytes = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        letter = role[:1]
        if self.codes and self.rows[-1][0][:1] + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows.append((role, text))
        self.codes.append((letter if letter in ("s", "u", "a") else "-") + fault)
        self.bytes += len(text)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self, single: bool) -> dict:
        codes = "".join(self.codes)
        faults = codes[1::2]
        made = {
            "conv_id": self.conv, "part": self.part, "single": single, "first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.turns,
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": self.illegal,
            "first": self.rows[0][0][:1] if codes else None, "last": self.rows[-1][0][:1] if codes else None,
        }
        if single:
            cost, audit = cheapest(codes)
            return made | {"cost": cost, "audit": audit, "turns": apply(audit, self.rows, 0)[0], "paths": None}
        found = [cheapest(codes, a, (b,)) for a in STATES for b in STATES]
        paths = [None if x is None else {"cost": x[0], "audit": x[1]} for x in found]
        return made | {"cost": None, "audit": None, "turns": [{"role": r, "text": t} for r, t in self.rows], "paths": paths}


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 2000, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(t["text"]) for t in row.get("turns") or ())
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True)


def _blocks(rows: Iterator[tuple], task: int, size: int) -> Iterator[dict]:
    """Blocks of a task's sorted rows (conv_id, turn, role, digest, mark, text, blank, ended, absent)."""
    block, marked, heads, parts = None, None, 0, task << 32
    for conv, turn, role, digest, mark, text, blank, ended, absent in rows:
        if block is None or conv != block.conv:
            if block is not None:
                yield block.row(block.head and heads > 1)
                parts += 1
            heads += 1
            block, marked = _Block(conv, True, parts), None
        if absent:
            continue
        key = (turn, role, digest)
        if mark == 0:
            marked = key
            continue
        fault = "b" if blank else "d" if marked != key else "." if ended else "t"
        marked = None if marked == key else marked  # the next row with this key is a copy
        if len(block.codes) >= size or block.bytes >= BLOCK_BYTES:
            yield block.row(False)
            parts += 1
            block = _Block(conv, False, parts)
        block.add(turn, role, text, fault)
    if block is not None:
        yield block.row(False)  # the next task may go on with it


def _chain(rows: Iterator[tuple]) -> Iterator[dict]:
    """For open blocks of conversations in order: where each begins and its share of the audit; the last of a conversation has its counts."""

    def ended(paths: list, parts: list[int], sums: dict) -> Iterator[dict]:
        done = [x for x in (paths[0], paths[3]) if x is not None]
        best = done[0] if len(done) == 1 or less(done[0], done[1]) else done[1]
        cost, rope = best
        for k in range(len(parts) - 1, -1, -1):
            rope, piece, state = rope
            yield {"part": parts[k], "state": state, "piece": piece, **(sums | {"cost": cost} if k == len(parts) - 1 else dict.fromkeys((*sums, "cost")))}

    def less(x: tuple, y: tuple) -> bool:
        if x[0] != y[0]:
            return x[0] < y[0]
        a, b, p, q = x[1], y[1], [], []
        while a is not b:  # both have as many parts
            p.append(a[1])
            q.append(b[1])
            a, b = a[0], b[0]
        return "".join(reversed(p)) < "".join(reversed(q))

    conv, parts, paths, sums = None, [], [], {}
    low = high = turns = last = None
    for c, part, first_turn, last_turn, n_turns, blank, duplicate, truncated, illegal, first, final, table in rows:
        if not parts or c != conv:
            if parts:
                yield from ended(paths, parts, sums)
            conv, parts, paths, sums = c, [], [(0, ()), None, None, None], dict.fromkeys(("gaps", *_COUNTS, "illegal"), 0)
            low = high = last = None
            turns = 0
        parts.append(part)
        grown: list = [None] * len(STATES)
        for a, path in enumerate(paths):
            for b in STATES:
                step = table[a * len(STATES) + b]
                if path is not None and step is not None:
                    found = (path[0] + step["cost"], (path[1], step["audit"], a))
                    if grown[b] is None or less(found, grown[b]):
                        grown[b] = found
        paths = grown
        for name, n in zip(("blank", "duplicate", "truncated", "illegal"), (blank, duplicate, truncated, illegal), strict=True):
            sums[name] += n
        if first is not None:
            sums["illegal"] += int(last is not None and last + first not in ("su", "ua", "au"))
            last = final
        if first_turn is not None:
            turns += n_turns - int(high is not None and high == first_turn)
            low, high = first_turn if low is None else low, last_turn
            sums["gaps"] = high - low + 1 - turns
    if parts:
        yield from ended(paths, parts, sums)


def repair(turns: DataFrame, absent: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Parts of repaired conversations: conv_id, part (rising), single (no other part), audit and turns of the part; gaps, blank, duplicate,
    truncated, illegal and cost of the conversation, null but for its last part. Rows where `absent` holds only name their conversation."""
    digest = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), (F.lit(False) if absent is None else absent).alias("absent"))
    end = F.rtrim("text", F.lit(SPACES))
    rows = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.lit(1).alias("mark"), "text", (F.length(end) == 0).alias("blank"), F.substring(end, -1, 1).isin(".", "!", "?").alias("ended"), "absent")
    # min skips nulls, which come first
    turn = F.when(F.count_if(F.col("turn").isNull()) > 0, F.lit(None).cast("long")).otherwise(F.min("turn"))
    firsts = rows.where("not absent").groupBy("conv_id", "role", "digest").agg(turn.alias("turn"))
    empty = {"text": F.lit(None).cast("string"), "blank": F.lit(None).cast("boolean"), "ended": F.lit(None).cast("boolean"), "absent": F.lit(False)}
    marks = firsts.withColumns({"mark": F.lit(0), **empty}).select(*rows.columns)
    keys = ["conv_id", "turn", "role", "digest"]
    laid = rows.unionAll(marks).repartitionByRange(*keys).sortWithinPartitions(*keys, "mark")

    conv = turns.schema["conv_id"].dataType.simpleString()
    counts = "first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long"
    spec = f"conv_id {conv}, part long, single boolean, {counts}, first string, last string, cost long, audit string, turns {_TURNS}, paths array<struct<cost:long,audit:string>>"
    arrow = _arrow(turns, spec)
    staged = materialize(laid.mapInArrow(lambda b: _batches(_blocks(_rows(b), TaskContext.get().partitionId(), block), arrow), spec), "repaired-conversations")

    out = ["conv_id", "part", "single", "gaps", *_COUNTS, "illegal", "cost", "audit", "turns"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    done = staged.where("single").withColumn("gaps", gaps).select(*out)
    pieces_spec = "part long, state int, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    pieces_arrow = _arrow(turns, pieces_spec)
    narrow = staged.where("not single").select("conv_id", "part", "first_turn", "last_turn", "n_turns", *_COUNTS, "illegal", "first", "last", "paths")
    pieces = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lambda b: _batches(_chain(_rows(b)), pieces_arrow), pieces_spec)
    held = staged.where("not single").select("conv_id", "part", "turns").join(pieces, "part")
    held = held.select("conv_id", "part", F.lit(False).alias("single"), "gaps", *_COUNTS, "illegal", "cost", F.col("piece").alias("audit"), "turns", "state")
    held_spec = f"conv_id {conv}, part long, single boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns {_TURNS}"
    held_arrow = _arrow(turns, held_spec)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: tuple) -> dict:
            made = dict(zip(out, row, strict=False))
            return made | {"turns": apply(made["audit"], [(t["role"], t["text"]) for t in made["turns"]], row[-1])[0]}

        return _batches(map(one, _rows(batches)), held_arrow)

    return done.unionByName(held.mapInArrow(changed, held_spec))


def conversations(parts: DataFrame) -> DataFrame:
    """One row per conversation from the parts that `repair` gives: its counts and cost, the whole audit, and the SHA-256 of role:text joined by newlines."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = ["conv_id", "gaps", *_COUNTS, "illegal", "cost", "audit", "repaired_sha256"]
    single = parts.where("single").withColumn("repaired_sha256", F.sha2(lines, 256)).select(*out)
    rest = parts.where("not single").select("conv_id", "part", "gaps", *_COUNTS, "illegal", "cost", "audit", "turns")
    spec = single.schema.simpleString()[len("struct<") : -1]
    arrow = _arrow(parts, spec)

    def joined(rows: Iterator[tuple]) -> Iterator[dict]:
        digest, audit, begun = hashlib.sha256(), [], False
        for conv, _, gaps, blank, duplicate, truncated, illegal, cost, piece, turns in rows:
            audit.append(piece)
            for t in turns:
                digest.update(f"{chr(10) if begun else ''}{t['role']}:{t['text']}".encode())
                begun = True
            if cost is not None:  # the last part
                yield dict(zip(out, (conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()), strict=True))
                digest, audit, begun = hashlib.sha256(), [], False

    laid = rest.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return single.unionByName(laid.mapInArrow(lambda b: _batches(joined(_rows(b)), arrow), spec))


def _arrow(df: DataFrame, spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], spec).schema)
