"""Repair of the structure of conversations, by the cheapest edits.

Rows are dealt by conversation and sorted by turn, and ``mapInPandas`` streams them:
for each of four states of the reply under repair (nothing, a system turn, last a
user's, last an assistant's) it carries the least cost and the rank of the state's
audit among the four, and stores for each row how each state was reached, five bits
a state. Ties are decided exactly without keeping audits: two states' audits are
never prefixes of one another, so the order of longer ones follows from the ranks
and the few letters added. At the end of a conversation the stored steps are walked
back and the edits are read off.

A conversation of more than ``held_rows`` rows or ``held_bytes`` bytes of text is not
kept: its steps go to a file in the shared folder in blocks, are walked back there
block by block, and a second stream over the rows of such conversations alone applies
the edits. Memory is bounded at any length of a conversation, but for the audit itself.

Faults of a row, the first that holds: blank (nothing but white space), duplicate (role
and text seen earlier in the conversation), truncated (last visible character not one
of ``.!?``). Edits: Keep (K) costs 0, Rerole (R) to user or assistant 1, Delete (D) 2
and is required for blank and duplicate rows, Insert (I) of an empty user or assistant
turn 5; each truncated row that stays adds 5. The repaired roles' initials match
``(s?(ua)+)?``. Of the cheapest edits those with the least audit in ASCII order count.

Defined results: a null role or text is one space; rows without a conversation id form
one conversation; rows of equal turns go by role and text, rows without a turn come
first; an empty role has no initial and can only be reroled or deleted; a row with
``dropped`` set only makes its conversation known; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import AtomicFile, light, open_filesystem, shared_dir, written

#: Rows and bytes of text of a conversation that are held; of longer ones steps are spilled.
HELD_ROWS, HELD_BYTES = 20_000, 8_000_000
#: Rows in a block of spilled steps or edits.
BLOCK = 65_536
#: Rows of output in hand.
OUT_ROWS = 4_096

START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Ways to take a row, in ASCII order of the letters they add to the audit.
STEPS = ("D", "IK", "IR", "K", "R")
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _moves(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, place in STEPS) of all ways to take a row."""
    moves = [(s, s, 2, STEPS.index("D")) for s in range(4)]
    if fault in ("blank", "duplicate"):
        return moves
    extra = 5 if fault == "truncated" else 0
    for before in range(4):
        for inserted in (False, True):
            after = (ASSISTANT if before == USER else USER) if not inserted else (USER if before == USER else ASSISTANT)
            cost = extra + 5 * inserted
            moves.append((before, after, cost + 1, STEPS.index("IR" if inserted else "R")))
            if initial == "ua"[after - USER]:
                moves.append((before, after, cost, STEPS.index("IK" if inserted else "K")))
    if initial == "s":
        moves.append((START, SYSTEM, extra, STEPS.index("K")))
    return moves


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}
#: State at the end -> turns to insert there.
ENDS = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}


class Path:
    """Least costs by state, with the ranks of their audits."""

    def __init__(self) -> None:
        self.cost, self.rank = [0, NEVER, NEVER, NEVER], [0, 0, 0, 0]

    def take(self, initial: str, fault: str) -> int:
        """Takes a row; returns how each state was reached, five bits a state."""
        best: list[tuple[int, int, int, int] | None] = [None] * 4
        for before, after, cost, step in MOVES[initial, fault]:
            if self.cost[before] < NEVER:
                way = (self.cost[before] + cost, self.rank[before], step, before)
                if best[after] is None or way < best[after]:
                    best[after] = way
        self.cost = [w[0] if w else NEVER for w in best]
        self.rank = [0] * 4
        for place, after in enumerate(sorted((s for s in range(4) if best[s]), key=lambda s: best[s][1:3])):
            self.rank[after] = place
        return sum((w[2] << 2 | w[3]) << 5 * s for s, w in enumerate(best) if w)

    def end(self) -> tuple[int, int]:
        """(least cost, state at the end)."""
        cost, _, state = min((self.cost[s] + 5 * n, self.rank[s], s) for s, n in ENDS.items())
        return cost, state


def _back(steps: list[int] | array, state: int) -> tuple[bytearray, int]:
    """(way and state after of each row, packed; state before the first) of stored steps, from the state at their end."""
    edits = bytearray(len(steps))
    for i in range(len(steps) - 1, -1, -1):
        way = steps[i] >> 5 * state & 31
        edits[i] = way >> 2 << 2 | state
        state = way & 3
    return edits, state


class Script:
    """Applies edits to rows in order: lines, audit and digest."""

    def __init__(self, lines: list | None, key: str | None) -> None:
        self.audit, self.sha, self.n, self.lines, self.key = [], hashlib.sha256(), 0, lines, key

    def line(self, edit: str, role: str, text: str) -> None:
        self.sha.update((("\n" if self.n else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        if self.lines is not None:
            self.lines.append((self.key, self.n, edit, role, text))
        self.n += 1

    def insert(self, after: int) -> None:
        self.audit.append("I")
        self.line("I", ROLES[after], "")

    def row(self, edit: int, role: str, text: str) -> None:
        step, after = STEPS[edit >> 2], edit & 3
        if step != "D":
            if step[0] == "I":
                self.insert(ASSISTANT if after == USER else USER)
            self.line(step[-1], role if step[-1] == "K" else ROLES[after], text)
        self.audit.append(step[-1])

    def end(self, state: int) -> tuple[str, str]:
        for after in (USER, ASSISTANT)[2 - ENDS[state] :]:
            self.insert(after)
        return "".join(self.audit), self.sha.hexdigest()


class Steps:
    """Stored steps of one conversation: in memory, and past ``most`` rows in a file of the shared folder."""

    def __init__(self, folder: str, name: str) -> None:
        self.folder, self.name, self.blocks, self.file, self.out = folder, name, array("I"), None, None

    def spill(self) -> None:
        if self.file is None:
            self.file = AtomicFile(self.folder, self.name + ".steps")
            self.out = self.file.__enter__()

    def add(self, steps: int) -> None:
        self.blocks.append(steps)
        if self.file is not None and len(self.blocks) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        self.out.write(self.blocks.tobytes())
        self.blocks = array("I")

    def walk(self, n: int, state: int) -> str:
        """Writes the edits of spilled steps, the last block first; returns the file's name."""
        self.flush()
        self.file.__exit__(None, None, None)
        with self.file.fs.open_input_file(self.file.path) as steps, AtomicFile(self.folder, self.name + ".edits") as edits:
            for lo in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
                block = array("I")
                block.frombytes(steps.read_at(4 * (min(n, lo + BLOCK) - lo), 4 * lo))
                made, state = _back(block, state)
                edits.write(bytes(made))
        return self.name + ".edits"


def _read_edits(folder: str, name: str, n: int) -> Iterator[int]:
    fs, inner = open_filesystem(folder)
    with fs.open_input_file(f"{inner}/{name}") as file:
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            yield from file.read_at(hi - lo, n - hi)


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LINES = ["place", "edit", "role", "text"]
SCHEMA = "key string, place long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in TOTALS) + ", audit string, sha256 string, file string, n long, state int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: A row's own columns in the stream.
STREAM = ["key", "turn", "role", "text", "late", "dropped"]
WHITE = " \t\n\x0b\x0c\r"


class Conversation:
    """What is carried of one conversation from batch to batch."""

    def __init__(self, key: str | None, folder: str, held: tuple[int, int]) -> None:
        self.key, self.most, self.path, self.size, self.n = key, held, Path(), 0, 0
        self.rows: list[tuple[str, str]] | None = []
        self.steps = Steps(folder, hashlib.sha256(repr(key).encode("utf-8", "surrogatepass")).hexdigest()[:40])
        self.counts, self.before = dict.fromkeys(TOTALS, 0), None
        self.turns, self.least, self.greatest = 0, None, None

    def take(self, turn: str | None, role: str, text: str, late: bool) -> None:
        visible = text.strip(WHITE)
        same = self.before == (turn, role, text)
        fault = "blank" if not visible else "duplicate" if late or same else "" if visible[-1] in ".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None and (self.before is None or self.before[0] != turn):
            self.turns += 1
            self.least, self.greatest = int(turn) if self.least is None else self.least, int(turn)
        self.before = (turn, role, text)
        self.steps.add(self.path.take(role[:1] if role[:1] in ("s", "u", "a") else "", fault))
        self.n += 1
        if self.rows is not None:
            self.rows.append((role, text))
            self.size += len(text)
            if self.n > self.most[0] or self.size > self.most[1]:
                self.rows = None
                self.steps.spill()

    def end(self, lines: list | None) -> tuple:
        cost, state = self.path.end()
        gaps = self.greatest - self.least + 1 - self.turns if self.turns else 0
        totals = [gaps, *(self.counts[c] for c in TOTALS[1:-1]), cost]
        if self.rows is None:
            return (self.key, *[None] * len(LINES), *totals, None, None, self.steps.walk(self.n, state), self.n, state)
        script = Script(lines, self.key)
        for edit, (role, text) in zip(_back(self.steps.blocks, state)[0], self.rows, strict=True):
            script.row(edit, role, text)
        return (self.key, *[None] * len(LINES), *totals, *script.end(state), None, self.n, state)


def _frames(made: Iterator[list[tuple]]) -> Iterator[pd.DataFrame]:
    for rows in made:
        frame = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
        yield frame.astype({c: "Int64" for c in ("place", *TOTALS, "n")} | {"state": "Int32"})


def _padded(lines: list[tuple]) -> list[tuple]:
    return [(*line, *[None] * (len(COLUMNS) - len(line))) for line in lines]


def _streamed(rows: DataFrame, folder: str, lines: bool, held: tuple[int, int]) -> DataFrame:
    """The first stream: totals of every conversation, its edits where it is held, else the name of their file."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> Iterator[list[tuple]]:
            now, out = None, []

            def close() -> None:
                drawn = [] if lines else None
                total = now.end(drawn)
                out.extend([*_padded(drawn or []), total])

            for frame in frames:
                for key, turn, role, text, late, dropped in zip(*(frame[c].tolist() for c in STREAM), strict=True):
                    if now is None or now.key != key:
                        if now is not None:
                            close()
                        now = Conversation(key, folder, held)
                    if not dropped:
                        now.take(turn, role, text, late)
                    if len(out) >= OUT_ROWS:
                        yield list(out)
                        out.clear()
            if now is not None:
                close()
                yield out

        yield from _frames(made())

    return rows.mapInPandas(stream, SCHEMA)


def _applied(rows: DataFrame, folder: str, lines: bool) -> DataFrame:
    """The second stream, over rows of long conversations with their file, n and state: edits read back and applied."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> Iterator[list[tuple]]:
            key, script, edits, state, out = None, None, iter(()), START, []
            nulls = [None] * len(LINES)

            def close() -> None:
                total = (key, *nulls, *[None] * len(TOTALS), *script.end(state), None, None, None)
                out.extend([*_padded(script.lines or []), total])

            for frame in frames:
                for own, role, text, file, n, last in zip(*(frame[c].tolist() for c in ("key", "role", "text", "file", "n", "state")), strict=True):
                    if script is None or own != key:
                        if script is not None:
                            close()
                        key, state, script, edits = own, last, Script([] if lines else None, own), _read_edits(folder, file, n)
                    script.row(next(edits), role, text)
                    if lines and len(script.lines) >= OUT_ROWS:
                        out.extend(_padded(script.lines))
                        script.lines.clear()
                    if len(out) >= OUT_ROWS:
                        yield list(out)
                        out.clear()
                if script is not None and lines:
                    out.extend(_padded(script.lines))
                    script.lines.clear()
            if script is not None:
                close()
                yield out

        yield from _frames(made())

    return rows.mapInPandas(stream, SCHEMA)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None, lines: bool = True, held: tuple[int, int] = (HELD_ROWS, HELD_BYTES)) -> DataFrame:
    """Totals of every conversation and, with ``lines``, the turns of the repaired ones.

    A row with a null ``place`` has a conversation's totals, audit and digest (sha256 of its
    repaired ``role:text``, a line each); the others are repaired turns by their places, with
    the edit that made them. ``key`` is the conversation's id as a string.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), (F.col(dropped) if dropped else F.lit(False)).alias("dropped"))
    digest, null_safe = F.unhex(F.sha2("text", 256)), lambda a, b: F.col(a).eqNullSafe(F.col(b))
    said_again = rows.filter(~F.col("dropped")).groupBy("conv", "role", digest.alias("digest")).agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
    again = light(written(said_again.filter("first <> last").select(F.col("conv").alias("c"), F.col("role").alias("r"), "digest", "first"), "again"))
    met = rows.join(again, null_safe("conv", "c") & null_safe("role", "r") & (digest == F.col("digest")), "left")
    late = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]

    def sorted_by_turn(some: DataFrame, *more: str) -> DataFrame:
        dealt = some.repartition("conv").sortWithinPartitions(*order)
        return dealt.select(F.col("conv").cast("string").alias("key"), F.col("turn").cast("string").alias("turn"), "role", "text", *more)

    folder = shared_dir(rows.sparkSession, "steps")
    made = written(_streamed(sorted_by_turn(met.select("conv", "turn", "role", "text", late.alias("late"), "dropped"), "late", "dropped"), folder, lines, held), "repaired")
    long_ones = made.filter("file IS NOT NULL").select("key", "file", "n", "state", *TOTALS)
    if long_ones.isEmpty():
        return made.drop("file", "n", "state")
    chosen = rows.filter(~F.col("dropped")).withColumn("key", F.col("conv").cast("string")).join(F.broadcast(long_ones.select(F.col("key").alias("k"), "file", "n", "state")), null_safe("key", "k")).drop("key", "k")
    applied = written(_applied(sorted_by_turn(chosen, "file", "n", "state"), folder, lines), "applied")
    ends = applied.filter("place IS NULL").select(F.col("key").alias("k"), "audit", "sha256")
    totals = long_ones.join(ends, null_safe("key", "k")).select("key", *(F.lit(None).cast(t).alias(c) for c, t in zip(LINES, ("long", "string", "string", "string"), strict=True)), *TOTALS, "audit", "sha256")
    rest = made.filter("file IS NULL").drop("file", "n", "state")
    return rest.unionByName(applied.filter("place IS NOT NULL").drop("file", "n", "state")).unionByName(totals)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults made by crc32 of ``conv_id:turn``, and the rows that it drops marked."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    coded = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    made = coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("dropped"), "code")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))).drop("copy", "code")
