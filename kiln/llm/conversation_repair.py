"""Repair of conversations: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

A role counts by its first letter: s, u or a.  Edits, row by row in the
order of turns: K keeps a row (0), R gives it the role user or assistant
(2), D deletes it (3; rows without text and repeats must go), I inserts an
empty message of user or assistant (2); a truncated row that stays adds 1.
Of the cheapest edits those whose letters are least in ASCII order count.

Rows are shuffled once, by conversation, and sorted by turn inside the
partitions; ``mapInPandas`` streams them and carries the state of a dynamic
program across Arrow batches.  The program follows the four states of the
wanted pattern (nothing yet, after s, after u, after a).  For each state
that can still win it carries the cost, the order of the edit strings
among the states, and the running SHA-256 of the repaired messages, so no
text is kept.  Rows leave one number each as backpointer; every
``SPILL_ROWS`` rows of a conversation these become one edit string per
state, sent on as a row of the output.  A conversation of any length thus
takes bounded memory in its task; its few pieces are joined afterwards.

One conversation is one stream: its digest runs over the repaired text
from first to last, so a conversation is not cut over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a conversation between two spills of its backpointers.
SPILL_ROWS = 1 << 15
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_NOTHING, _S, _U, _A = range(4)
_SPACE = " \t\n\x0b\x0c\r"

# ------------------------------------------------------------- the pattern's automaton


def _insert(state: int) -> int:
    return _A if state == _U else _U


def _take(state: int, initial: str) -> int | None:
    """The state after a kept row of that initial, or None."""
    if initial == "s":
        return _S if state == _NOTHING else None
    if initial == "u":
        return None if state == _U else _U
    return _A if initial == "a" and state == _U else None


def _inserts(state: int) -> list[tuple[int, int]]:
    """(inserted messages, state then): more than these come back to a state that is there already, at a higher cost."""
    out = [(0, state)]
    while len(out) < 3 and (to := _insert(out[-1][1])) not in [s for _, s in out]:
        out.append((len(out), to))
    return out


def _lead(better: int, worse: int) -> int:
    """What a path at ``better`` pays at most to go on as any path at ``worse`` does; a larger difference of costs decides.

    After a every going on from s is open too, and every one from the start but for keeping a row of s, which can be deleted.
    """
    if better == _NOTHING and worse == _S:
        return 0
    to = {s: INSERT * k for k, s in _inserts(better)}
    return to[_U] if worse == _U else to[_A] + (DELETE if worse == _NOTHING else 0)


def _written(state: int, edits: str) -> list[tuple[str, bool]]:
    """What the edits of one row write, from ``state`` on: (role to write or '' for the row's own, with the row's text?)."""
    out = []
    for e in edits:
        if e == "D":
            continue
        role = "assistant" if state == _U else "user"
        if e == "K":
            out.append(("", True))
        else:
            out.append((role, e == "R"))
            state = _insert(state)
    return out


class Program:
    """Transitions of the dynamic program, found once per distinct situation.

    A situation is the tuple of (state, cost above the least) of the states that can win, in the order of their edit strings.
    No edit string is a prefix of another (each ends with the edit of the last row), so the order decides all later ties.
    """

    def __init__(self):
        self.numbers: dict = {}
        self.steps: list = []

    def step(self, situation: tuple, code: str) -> int:
        """The number of the transition of a row of ``code``: its initial, then '-' (sound), 't' (truncated) or 'd' (must go)."""
        known = self.numbers.get((situation, code))
        if known is None:
            known = self.numbers[situation, code] = len(self.steps)
            self.steps.append(self._step(situation, code))
        return known

    def _step(self, situation: tuple, code: str) -> tuple:
        initial, fault = code[0], code[1]
        extra = TRUNCATED if fault == "t" else 0
        best: dict[int, tuple] = {}
        for rank, (state, cost) in enumerate(situation):
            for k, at in _inserts(state):
                base = cost + INSERT * k
                options = [(at, base + DELETE, "D")]
                if fault != "d":
                    options.append((_insert(at), base + REROLE + extra, "R"))
                    if (to := _take(at, initial)) is not None:
                        options.append((to, base + KEEP + extra, "K"))
                for to, c, e in options:
                    offer = (c, rank, "I" * k + e)
                    if to not in best or offer < best[to]:
                        best[to] = offer
        live = {s: o for s, o in best.items() if not any(o[0] > p[0] + _lead(t, s) for t, p in best.items() if t != s)}
        order = sorted(live, key=lambda s: live[s][1:])
        least = min(o[0] for o in live.values())
        then = tuple((s, live[s][0] - least) for s in order)
        moves = [(live[s][1], live[s][2], _written(situation[live[s][1]][0], live[s][2]), situation[live[s][1]][0] == _NOTHING) for s in order]
        return then, least, moves

    @staticmethod
    def end(situation: tuple) -> tuple[int, int, int]:
        """(place of the best state, inserted messages, cost) after the last row."""
        cost, rank, k = min((c + INSERT * k, rank, k) for rank, (s, c) in enumerate(situation)
                            for k, at in _inserts(s) if at in (_NOTHING, _A))
        return rank, k, cost


class _Conversation:
    """The stream of one conversation."""

    def __init__(self, program: Program, spill_rows: int):
        self.program, self.spill_rows = program, spill_rows
        self.situation: tuple = ((_NOTHING, 0),)
        self.cost = 0
        self.hashes = [hashlib.sha256()]
        self.back: list[int] = []
        self.chunk = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.low, self.high, self.last_initial = 0, None, None, None

    def see(self, turn, initial: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            self.counts[fault] += 1
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last_initial = initial

    def row(self, code: str, role: str, text: str) -> list | None:
        number = self.program.step(self.situation, code)
        then, least, moves = self.program.steps[number]
        own = None
        hashes, left = [], [m[0] for m in moves]
        for parent, _, written, first in moves:
            left.remove(parent)
            h = self.hashes[parent].copy() if parent in left else self.hashes[parent]
            for r, with_text in written:
                if with_text and r == "":
                    own = own or f"{role}:{text}".encode("utf-8", "surrogatepass")
                    line = own
                else:
                    line = f"{r}:{text if with_text else ''}".encode("utf-8", "surrogatepass")
                h.update(line if first else b"\n" + line)
                first = False
            hashes.append(h)
        self.situation, self.cost, self.hashes = then, self.cost + least, hashes
        self.back.append(number)
        return self.spill() if len(self.back) >= self.spill_rows else None

    def pieces(self, ends: list[int]) -> list[dict]:
        """For each place in ``ends``: the edits since the last spill and the place there."""
        out = []
        for end in ends:
            at, edits = end, []
            for number in reversed(self.back):
                parent, letters = self.program.steps[number][2][at][:2]
                edits.append(letters)
                at = parent
            out.append({"end": end, "start": at, "edits": "".join(reversed(edits))})
        return out

    def spill(self) -> list:
        out = [self.chunk, False, self.pieces(list(range(len(self.situation)))), *[0] * 6, ""]
        self.back, self.chunk = [], self.chunk + 1
        return out

    def finish(self) -> list:
        rank, k, cost = Program.end(self.situation)
        state, h = self.situation[rank][0], self.hashes[rank]
        for role, _ in _written(state, "I" * k):
            h.update((b"" if state == _NOTHING else b"\n") + f"{role}:".encode())
            state = _A
        piece = self.pieces([rank])
        piece[0]["edits"] += "I" * k
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        c = self.counts
        return [self.chunk, True, piece, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost + cost, h.hexdigest()]


# ------------------------------------------------------------- rows

_OUT = ("_c string, _chunk long, _last boolean, _pieces array<struct<end:int,start:int,edits:string>>, gaps long, blank long, duplicate long, "
        "truncated long, illegal long, cost long, repaired_sha256 string")


def _key(conversation: str) -> Column:
    """A conversation's id as text; the null id is one of its own."""
    return F.when(F.col(f"`{conversation}`").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(f"`{conversation}`").cast("string")))


def _plain(conversations: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(_c, _t, _role, _text, _gone): the columns that count; null roles and texts are one space."""
    gone = F.col("_dropped") if "_dropped" in conversations.columns else F.lit(False)
    return conversations.select(_key(conversation).alias("_c"), F.col(f"`{turn}`").cast("long").alias("_t"),
                                F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("_role"),
                                F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("_text"), gone.alias("_gone"))


def damage(conversations: DataFrame) -> DataFrame:
    """The stated damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (``_dropped``, so that its conversation stays
    known), 1 empties the text, 2 removes its ``[.!?]``, 3 repeats the row with the same turn, 4 sets role user.  Nulls count as
    one space, but for the ids and turns that are passed on."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *as_text)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("_dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``_fault`` (blank, duplicate, truncated or empty) and deals rows out: one shuffle, by conversation, for both sorts."""
    end = F.substring(F.rtrim(F.col("_text"), F.lit(_SPACE)), -1, 1)
    seen = F.row_number().over(Window.partitionBy("_c", "_gone", "_role", "_text").orderBy(F.col("_t").asc_nulls_first())) > 1
    dealt = rows.repartition("_c").withColumn("_seen", seen)
    fault = F.when(end == "", "blank").when(F.col("_seen"), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return dealt.withColumn("_fault", fault)


def repair_report(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: its id, gaps (missing turns between the least and the largest; null turns do not count), blank,
    duplicate, truncated (rows by their first fault), illegal (neighbours other than su, ua, au), cost, audit (the edits'
    letters) and repaired_sha256 (``role:text`` of the repaired rows, one per line).

    Rows are taken by turn, null turns first, rows of one turn by role and text.  Null roles and texts are one space, the null
    id is a conversation.  Rows marked in a boolean column ``_dropped`` do not count, but their conversation is reported: without
    rows it has zeros, an empty audit and the digest of nothing.  An empty table gives no rows; other columns are not read.
    """
    kind = conversations.schema[conversation].dataType
    rows = _faults(_plain(conversations, conversation, turn, role, text))
    streamed = rows.select("_c", "_gone", F.col("_t").isNull().alias("_no_turn"), F.coalesce("_t", F.lit(0)).alias("_t"), "_role",
                           F.when(F.col("_gone"), "").otherwise(F.col("_text")).alias("_text"), "_fault", "_seen") \
        .sortWithinPartitions("_c", F.col("_no_turn").desc(), "_t", "_role", "_text", "_seen")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, current, talk = Program(), None, None
        for pdf in batches:
            out = []
            for c, gone, no_turn, t, r, x, fault in zip(*(pdf[n].tolist() for n in ("_c", "_gone", "_no_turn", "_t", "_role", "_text", "_fault"))):
                if c != current:
                    if talk is not None:
                        out.append([current, *talk.finish()])
                    current, talk = c, _Conversation(program, spill_rows)
                if gone:
                    continue
                talk.see(None if no_turn else t, r[:1], fault)
                initial = r[:1] if r[:1] in ("s", "u", "a") else "x"
                spilt = talk.row(initial + ("t" if fault == "truncated" else "d" if fault else "-"), r, x)
                if spilt:
                    out.append([c, *spilt])
            if out:
                yield pd.DataFrame(out, columns=_NAMES)
        if talk is not None:
            yield pd.DataFrame([[current, *talk.finish()]], columns=_NAMES)

    pieces = streamed.mapInPandas(stream, _OUT)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = pieces.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_chunk", "_pieces")), asc=False).alias("_parts"),
                                     *[F.sum(n).alias(n) for n in numbers], F.max("repaired_sha256").alias("repaired_sha256"))

    def back(found, part):
        piece = F.filter(part["_pieces"], lambda p: found["at"].isNull() | (p["end"] == found["at"]))[0]
        return F.struct(piece["start"].alias("at"), F.concat(F.array(piece["edits"]), found["edits"]).alias("edits"))

    start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<string>").alias("edits"))
    audit = F.array_join(F.aggregate("_parts", start, back, lambda f: f["edits"]), "")
    number = F.when(F.col("_c") != "n", F.expr("substring(_c, 2)").cast(kind)).alias(conversation)
    return whole.select(number, *numbers[:-1], "cost", audit.alias("audit"), "repaired_sha256")


_NAMES = [f.split()[0] for f in _OUT.replace("array<struct<end:int,start:int,edits:string>>", "x").split(", ")]


def repaired(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired messages: conversation id, position (from 0), turn (null for inserted ones), role, text, edit (K, R or I).

    The audit of each conversation is dealt out and sorted in front of its rows, which stream past it once more.
    """
    kind = conversations.schema[conversation].dataType
    audits = repair_report(conversations, conversation, turn, role, text).select(_key(conversation).alias("_c"), "audit")
    rows = _plain(conversations, conversation, turn, role, text).where("NOT _gone").drop("_gone")
    both = rows.withColumn("_audit", F.lit(None).cast("string")).unionByName(
        audits.select("_c", F.lit(None).cast("long").alias("_t"), F.lit("").alias("_role"), F.lit("").alias("_text"), F.col("audit").alias("_audit")))
    dealt = both.select("*", F.col("_t").isNull().alias("_no_turn"), F.col("_audit").isNull().alias("_row")).withColumn("_t", F.coalesce("_t", F.lit(0))) \
        .repartition("_c").sortWithinPartitions("_c", "_row", F.col("_no_turn").desc(), "_t", "_role", "_text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, audit, at, state, place = None, "", 0, _NOTHING, 0

        def inserted():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                yield [c, place, None, "assistant" if state == _U else "user", "", "I"]
                at, state, place = at + 1, _insert(state), place + 1

        for pdf in batches:
            out = []
            for k, is_row, no_turn, t, r, x, a in zip(*(pdf[n].tolist() for n in ("_c", "_row", "_no_turn", "_t", "_role", "_text", "_audit"))):
                if not is_row:
                    c, audit, at, state, place = k, a, 0, _NOTHING, 0
                else:
                    e = audit[at]
                    at += 1
                    if e != "D":
                        r = r if e == "K" else "assistant" if state == _U else "user"
                        out.append([c, place, None if no_turn else t, r, x, e])
                        state, place = _take(state, r[:1]), place + 1
                out.extend(inserted())
            yield pd.DataFrame(out, columns=["_c", "position", "_t", "_role", "_text", "edit"]).astype({"_t": "Int64"})

    out = dealt.mapInPandas(stream, "_c string, position long, _t long, _role string, _text string, edit string")
    return out.select(F.when(F.col("_c") != "n", F.expr("substring(_c, 2)").cast(kind)).alias(conversation), "position", F.col("_t").alias(turn),
                      F.col("_role").alias(role), F.col("_text").alias(text), "edit")
