"""Cheapest repair of the turn structure of conversations, by divide and conquer.

Rows are kept (cost 0), given the role that fits (Rerole, 3) or deleted (4; required for blank and
duplicate rows), and empty user or assistant turns are inserted (3); a truncated row that is not
deleted costs 3 more. What is left must read ``(s?(ua)+)?`` in role initials. That language has four
states (nothing yet, after a system row, after a user row, after an assistant row), so a stretch of
rows is a table of four by four costs.

Hirschberg's scheme finds the edits: cost vectors of the four states run forward over the first half
and backward over the second, meet in the middle, the cheapest crossing is fixed, and both halves are
solved alike, in space linear in the rows. Among equal costs the audit that is least in ASCII order
wins: forward vectors carry the rank of each state's least audit. Ranks suffice, because an audit of i
rows ends with the letter of row i, so that none is the beginning of another.

The same scheme runs over Spark rows: a conversation, however long, is cut into blocks of 4096 rows, a
block's four-by-four table is made in one task, tables are merged 256 at a time up to the whole
conversation, and the crossings chosen at the top go down again to the blocks. Only the digest of a
conversation, which no function can put together from parts, reads its rows in one stream.

Defined results: nulls count as one space; rows are ordered by turn (nulls first), role and text, so
repeated rows are neighbours; a null id is a conversation like any other; the first character of a role
is its initial, an empty role has none that fits; a conversation without rows left has an empty audit;
gaps beyond a long are null; an empty table gives nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import arrow_rows, cut

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn that is inserted or renamed in a state.
NEXT = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: States that keeping a row leads to, by its initial: s, u, a, any other.
KEEP = ({EMPTY: SYSTEM}, {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
NAME = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RENAME_COST = INSERT_COST = TRUNCATED_COST = 3
DELETE_COST = 4
#: Rows of a block, and children of a node, as powers of two.
BLOCK_BITS, NODE_BITS = 12, 8
SPACES = " \t\n\x0b\f\r"

#: A step leads from a state to a state: its cost and its audit (letters of a row, or a rank for a stretch of rows), None where it cannot.
Step = list


def row_step(code: int) -> Step:
    """Step of one row, from its initial (0 to 3) and four times its fault: inserts come before the row's own letter."""
    kind, fault = code % 4, code // 4
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    out = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, letters, cost = start, "", 0
        for _ in range(3):
            ways = [(state, cost + DELETE_COST, letters + "D")]
            if fault not in (BLANK, DUPLICATE):
                ways.append((NEXT[state], cost + RENAME_COST + extra, letters + "R"))
                if state in KEEP[kind]:
                    ways.append((KEEP[kind][state], cost + extra, letters + "K"))
            for to, price, audit in ways:
                if out[start][to] is None or (price, audit) < out[start][to]:
                    out[start][to] = (price, audit)
            state, letters, cost = NEXT[state], letters + "I", cost + INSERT_COST
    return out


ROW = [row_step(code) for code in range(16)]
#: Inserts after the last row; the end is written as the assistant state.
END: Step = [[None, None, None, arc] for arc in ((0, ""), (2 * INSERT_COST, "II"), (INSERT_COST, "I"), (0, ""))]


def advance(vector: list, step: Step) -> list:
    """Cost and audit rank of each state after one more step; None where a state cannot be reached."""
    found = [None] * 4
    for at, arcs in zip(vector, step):
        if at is not None:
            for to, arc in enumerate(arcs):
                if arc is not None:
                    key = (at[0] + arc[0], at[1], arc[1])
                    if found[to] is None or key < found[to]:
                        found[to] = key
    out = [None] * 4
    for rank, (_, to) in enumerate(sorted((key[1:], to) for to, key in enumerate(found) if key is not None)):
        out[to] = (found[to][0], rank)
    return out


def retreat(vector: list, step: Step) -> list:
    """Cost from each state to the end, one step earlier."""
    return [min((arc[0] + vector[to] for to, arc in enumerate(arcs) if arc is not None and vector[to] is not None), default=None) for arcs in step]


def start_at(state: int) -> list:
    return [(0, 0) if s == state else None for s in range(4)]


def table_of(steps: list[Step]) -> Step:
    """One step for a stretch of steps: costs, and ranks of the audits that leave from the same state."""
    out = []
    for state in range(4):
        vector = start_at(state)
        for step in steps:
            vector = advance(vector, step)
        out.append(vector)
    return out


def crossings(steps: list[Step], enter: int, leave: int) -> list[int]:
    """States before the first step, between steps and after the last, on the cheapest way with the least audit."""
    states = [enter] + [EMPTY] * (len(steps) - 1) + [leave]
    todo = [(0, len(steps))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        middle = (a + b) // 2
        ahead = start_at(states[a])
        for i in range(a, middle):
            ahead = advance(ahead, steps[i])
        back = [0 if s == states[b] else None for s in range(4)]
        for i in range(b - 1, middle - 1, -1):
            back = retreat(back, steps[i])
        states[middle] = min((f[0] + g, f[1], s) for s, (f, g) in enumerate(zip(ahead, back)) if f is not None and g is not None)[2]
        todo += [(a, middle), (middle, b)]
    return states


def edits_of(codes: list[int], enter: int = EMPTY, leave: int | None = None) -> tuple[list[str], list[int], str]:
    """Letters and state before each row, and the letters after the last row (none if ``leave`` is given: more rows follow)."""
    steps = [ROW[c] for c in codes]
    if leave is None:
        states = crossings([*steps, END], enter, ASSISTANT)
        tail = END[states[-2]][ASSISTANT][1]
    else:
        states, tail = crossings(steps, enter, leave), ""
    return [steps[i][states[i]][states[i + 1]][1] for i in range(len(steps))], states[:len(steps)], tail


def outcome(letters: str, state: int, kind: int, role: str, text: str) -> list[tuple[str, str, str]]:
    """Rows (letter, role, text) that an edit leaves, in order."""
    out = []
    for letter in letters:
        if letter == "I" or letter == "R":
            state = NEXT[state]
            out.append((letter, NAME[state], text if letter == "R" else ""))
        elif letter == "K":
            state = KEEP[kind][state]
            out.append((letter, role, text))
    return out


# --- tables

def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with one planted fault for some values of the hash of ``conv_id:turn``; dropped rows stay, marked as gone."""
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(said("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("draw", draw)
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") == 0).alias("gone"), copies.alias("copy")).drop("copy"))


def place(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, rising with (conv_id, turn, role, text), the digest of role and text, and the row's own faults.

    Ranges are cut inside conversations as well, so a long one is spread over tasks.
    """
    begin = F.when(F.length("role") <= 64, F.substring("text", 1, 64)).otherwise("")         # bounds of ranges are short; whole texts order inside a range
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    ordered = rows.repartitionByRange(*keys, F.substring("role", 1, 64), begin).sortWithinPartitions(*keys, "role", "text")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    own = F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return cut(ordered.select("conv_id", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("pos"), kind.alias("kind"), own.alias("own"),
                              F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same")))


def code_rows(placed: DataFrame) -> DataFrame:
    """conv_id, pos and code of each row that is there; all but the first of equal rows are duplicates."""
    there = placed.where("not gone and own <> 1").groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = there.select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "first")
    rows = placed.where("not gone").select("conv_id", "pos", "kind", "own", "same")
    marked = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"]) & (rows["same"] == first["_same"]), "left")
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).otherwise(F.col("own"))
    return marked.select("conv_id", "pos", (F.col("kind") + 4 * fault).alias("code"))


_STEP = "cost array<long>, rank array<int>"


def _flat(step: Step) -> tuple[list, list]:
    arcs = [arc for arcs in step for arc in arcs]
    return [None if a is None else a[0] for a in arcs], [None if a is None else a[1] for a in arcs]


def _step(cost: list, rank: list) -> Step:
    arcs = [None if c is None else (c, r) for c, r in zip(cost, rank)]
    return [arcs[i:i + 4] for i in range(0, 16, 4)]


def block_tables(coded: DataFrame) -> DataFrame:
    """A row per conversation and block: its rows and its table."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            codes = columns["code"].to_pylist()
            tables = [_flat(table_of([ROW[c] for c in own])) for own in codes]
            yield {"conv_id": columns["conv_id"], "node": columns["node"], "pos": columns["pos"], "code": columns["code"], "cost": [t[0] for t in tables], "rank": [t[1] for t in tables]}

    rows = F.sort_array(F.collect_list(F.struct("pos", "code")))                            # at most 2^BLOCK_BITS
    grouped = coded.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("node")).agg(rows.alias("rows"))
    return cut(arrow_rows(grouped.select("conv_id", "node", F.col("rows.pos").alias("pos"), F.col("rows.code").alias("code")), run,
                          f"conv_id long, node long, pos array<long>, code array<int>, {_STEP}"))


def _merged(nodes: DataFrame) -> DataFrame:
    """Parents of nodes: their children in order, and one table for all."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            tables = []
            for costs, ranks in zip(columns["costs"].to_pylist(), columns["ranks"].to_pylist()):
                tables.append(_flat(table_of([_step(c, r) for c, r in zip(costs, ranks)])))
            yield {n: columns[n] for n in ("conv_id", "node", "children", "costs", "ranks")} | {"cost": [t[0] for t in tables], "rank": [t[1] for t in tables]}

    children = F.sort_array(F.collect_list(F.struct("node", "cost", "rank")))                # at most 2^NODE_BITS
    grouped = nodes.groupBy("conv_id", F.shiftright("node", NODE_BITS).alias("parent")).agg(children.alias("all"))
    return cut(arrow_rows(grouped.select("conv_id", F.col("parent").alias("node"), F.col("all.node").alias("children"), F.col("all.cost").alias("costs"), F.col("all.rank").alias("ranks")),
                          run, f"conv_id long, node long, children array<long>, costs array<array<long>>, ranks array<array<int>>, {_STEP}"))


DOOR = "conv_id long, node long, enter int, leave int"


def _opened(parents: DataFrame) -> DataFrame:
    """States at which the chosen way enters and leaves each child; no leaving state at the end of the conversation."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            out = {"conv_id": [], "node": [], "enter": [], "leave": []}
            for ident, children, costs, ranks, enter, leave in zip(*(columns[n].to_pylist() for n in ("conv_id", "children", "costs", "ranks", "enter", "leave"))):
                steps = [_step(c, r) for c, r in zip(costs, ranks)]
                states = crossings(steps, enter, leave) if leave is not None else crossings([*steps, END], enter, ASSISTANT)
                out["conv_id"] += [ident] * len(children)
                out["node"] += children
                out["enter"] += states[:len(children)]
                out["leave"] += states[1:len(children)] + [leave if leave is None else states[-1]]
            yield out

    return cut(arrow_rows(parents, run, DOOR))


def _with_doors(nodes: DataFrame, doors: DataFrame, how: str) -> DataFrame:
    doors = doors.select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), "enter", "leave")
    return nodes.join(doors, nodes["conv_id"].eqNullSafe(doors["_conv"]) & (nodes["node"] == doors["_node"]), how).drop("_conv", "_node")


def doors_of(nodes: DataFrame) -> DataFrame | None:
    """Entering and leaving states of all blocks of conversations with more than one block; None if there are none."""
    def spread(frame: DataFrame) -> DataFrame:
        return frame.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"))

    many = cut(spread(nodes))
    if many.isEmpty():
        return None
    level = nodes.select("conv_id", "node", "cost", "rank")
    level = level.join(many, level["conv_id"].eqNullSafe(many["_conv"]), "left_semi")
    levels = []
    while True:                                    # positions have 63 bits: a few levels at most
        levels.append(_merged(level))
        if spread(levels[-1]).isEmpty():
            break
        level = levels[-1].select("conv_id", "node", "cost", "rank")
    top = levels.pop()
    doors = _opened(top.select("conv_id", "children", "costs", "ranks", F.lit(EMPTY).alias("enter"), F.lit(None).cast("int").alias("leave")))
    while levels:
        doors = _opened(_with_doors(levels.pop(), doors, "inner").select("conv_id", "children", "costs", "ranks", "enter", "leave"))
    return doors


def edit_rows(placed: DataFrame) -> DataFrame:
    """conv_id, pos, code, letters, state before the row, and letters after the conversation's last row, for each row that is there."""
    nodes = block_tables(code_rows(placed))
    doors = doors_of(nodes)
    opened = (nodes.withColumns({"enter": F.lit(EMPTY), "leave": F.lit(None).cast("int")}) if doors is None
              else _with_doors(nodes, doors, "left").withColumn("enter", F.coalesce("enter", F.lit(EMPTY))))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            out = {"conv_id": [], "pos": [], "code": [], "letters": [], "state": [], "tail": []}
            for ident, pos, codes, enter, leave in zip(*(columns[n].to_pylist() for n in ("conv_id", "pos", "code", "enter", "leave"))):
                letters, states, tail = edits_of(codes, enter, leave)
                out["conv_id"] += [ident] * len(pos)
                out["pos"] += pos
                out["code"] += codes
                out["letters"] += letters
                out["state"] += states
                out["tail"] += [""] * (len(pos) - 1) + [tail]
            yield out

    return arrow_rows(opened.select("conv_id", "pos", "code", "enter", "leave"), run, "conv_id long, pos long, code int, letters string, state int, tail string")


def edited(conversations: DataFrame) -> DataFrame:
    """All rows of ``conversations`` (conv_id, turn, role, text, gone) with pos and their edits, sorted within partitions of whole conversations."""
    placed = place(conversations)
    dealt = F.xxhash64("conv_id").alias("dealt")                       # one exchange serves the join and the streams of conversations
    edits = edit_rows(placed).select(dealt, "pos", "code", "letters", "state", "tail").repartition("dealt")
    rows = placed.select(dealt, "conv_id", "turn", "role", "text", "gone", "pos").repartition("dealt")
    return rows.join(edits, ["dealt", "pos"], "left").sortWithinPartitions("dealt", "conv_id", "pos")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, part, op, role, text of the rows that repaired conversations consist of."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            out = {"conv_id": [], "pos": [], "part": [], "op": [], "role": [], "text": []}
            for ident, pos, role, text, code, letters, state, tail in zip(*(columns[n].to_pylist() for n in ("conv_id", "pos", "role", "text", "code", "letters", "state", "tail"))):
                for part, (op, new_role, new_text) in enumerate(outcome(letters + tail, state, code % 4, role, text)):
                    for name, value in zip(out, (ident, pos, part, op, new_role, new_text)):
                        out[name].append(value)
            yield out

    return arrow_rows(edited(conversations).where("code is not null"), run, "conv_id long, pos long, part int, op string, role string, text string")


class _Totals:
    """What the digest row of one conversation needs, gathered row by row."""

    LEGAL = {(0, 1), (1, 2), (2, 1)}

    def __init__(self, ident):
        self.ident, self.faults, self.illegal, self.cost = ident, [0, 0, 0, 0], 0, 0
        self.low = self.high = self.kind = None
        self.turns = self.rows = 0
        self.audit, self.sha = [], hashlib.sha256()

    def add(self, turn, role, text, code, letters, state, tail) -> None:
        kind, fault = code % 4, code // 4
        self.faults[fault] += 1
        if self.kind is not None and (self.kind, kind) not in self.LEGAL:
            self.illegal += 1
        self.kind = kind
        if turn is not None:                        # rows come by turn
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        letters += tail
        self.audit.append(letters)
        self.cost += sum({"D": DELETE_COST, "I": INSERT_COST, "R": RENAME_COST, "K": 0}[x] for x in letters) + (TRUNCATED_COST if fault == TRUNCATED and "D" not in letters else 0)
        for _, new_role, new_text in outcome(letters, state, kind, role, text):
            self.sha.update(f"{chr(10) if self.rows else ''}{new_role}:{new_text}".encode("utf-8", "surrogatepass"))
            self.rows += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.ident, gaps if gaps < 1 << 63 else None, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, and the digest of what is left."""
    names = [part.split()[0] for part in DIGEST.split(", ")]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now = None
        for columns in batches:
            done = []
            for ident, gone, *rest in zip(*(columns[n].to_pylist() for n in ("conv_id", "gone", "turn", "role", "text", "code", "letters", "state", "tail"))):
                if now is None or now.ident != ident:
                    if now is not None:
                        done.append(now.row())
                    now = _Totals(ident)
                if not gone:
                    now.add(*rest)
            if done:
                yield dict(zip(names, (list(c) for c in zip(*done))))
        if now is not None:
            yield dict(zip(names, ([v] for v in now.row())))

    return arrow_rows(edited(conversations), run, DIGEST)
