"""Repair of the structure of conversations at the least cost.

A sound conversation's role initials match ``(s?(ua)+)?``: nothing, or an optional system turn and pairs of user and assistant. Rows are
taken by turn (null first), then role, then SHA-256 of the text. A row's first fault counts: blank (nothing but white space), duplicate
(role and text were there before), truncated (its last character isn't one of ``.!?``). Edits are Delete (2; the only one for blank and
duplicate rows), Insert of an empty user or assistant turn (5), Keep (0) and Rerole to user or assistant (1); a truncated row that
stays costs 5 more.

Costs are found in layers, in the manner of approximate matching with bit vectors: for each cost, from 0 upwards, and for each row a
bitset holds the states of the grammar from which the rest of the conversation can be made sound at that cost, each layer out of the
ones an edit cheaper. The first layer that has the start state gives the cost, and the trace through the bitsets that always takes
the least letter that still meets the layer's cost gives the cheapest edits whose initials are least in ASCII. The letter and the state
determine what a row becomes, so the trace is unique.

Blank and duplicate rows cost 2 whatever else is done, and come before inserts at the same place, so the layers leave them out. Rows that
repeat a whole row are one row with a number. Conversations are range-sorted, so one of any length is spread over tasks, in pieces of
``PIECE`` rows. A conversation that lies within one piece is repaired there. Of the others each piece gives its costs from every state to
every state; folding these from the end gives the cost of what follows each piece, under which pieces are traced, once for every state
they may be entered in; only what depends on the order of the whole, the digest and joining the edits, is a pass over a conversation.

Defined results: nulls in role and text are one blank; a null conv_id is a conversation of its own; turns may be null; a conversation
without rows has zeros, an empty audit and the digest of nothing; an empty table gives an empty one; very long texts travel a piece at
a time; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, discard, map_arrow, materialize

#: Rows, and bytes of their texts, of one piece of a conversation.
PIECE, PIECE_BYTES = 64, 4 << 20
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 40
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn (only the first and the last may end).
ENDS = (0, NEVER, NEVER, 0)
#: By a row's initial (s, u, a, other): the state that each state goes to, or None.
_STEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))
#: An inserted or reroled turn is a user's, but after a user's an assistant's.
_EDIT = (2, 2, 3, 2)
_INITIALS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {"su", "ua", "au"}


def _before(step) -> tuple[int, ...]:
    """By set of states: those that ``step`` leads into it."""
    return tuple(sum(1 << q for q, to in enumerate(step) if to is not None and s >> to & 1) for s in range(16))


_KEEPS, _EDITS = tuple(_before(s) for s in _STEP), _before(_EDIT)


def symbol(role: str, truncated: bool) -> int:
    """What the layers see of a row: its initial, and whether it is truncated."""
    return _INITIALS.get(role[:1], 3) + 4 * truncated


class Layers:
    """``sets[c][i]``: states from which rows ``i`` on and then an end can be had for at most ``c``; ``ends`` says what each state's end costs."""

    def __init__(self, rows: bytes, ends=ENDS):
        self.rows, self.ends, self.sets = rows, ends, []

    def add(self) -> int:
        """Another layer; its states at the first row."""
        c, n, sets = len(self.sets), len(self.rows), self.sets
        own = [0] * (n + 1)
        inserted = sets[c - INSERT] if c >= INSERT else None
        own[n] = sum(1 << q for q, cost in enumerate(self.ends) if cost <= c) | (_EDITS[inserted[n]] if inserted else 0)
        for i in range(n - 1, -1, -1):
            row = self.rows[i]
            more = TRUNCATED if row > 3 else 0
            s = own[i + 1] if not more else sets[c - more][i + 1] if c >= more else 0
            s = _KEEPS[row & 3][s]
            if c >= DELETE:
                s |= sets[c - DELETE][i + 1]
            if c >= REROLE + more:
                s |= _EDITS[sets[c - REROLE - more][i + 1]]
            if inserted:
                s |= _EDITS[inserted[i]]
            own[i] = s
        sets.append(own)
        return own[0]

    def costs(self, wanted: int) -> list[int]:
        """For each state of ``wanted`` the first layer that has it at the first row; the others never."""
        out, c = [NEVER] * 4, 0
        while wanted:
            got = (self.add() if c == len(self.sets) else self.sets[c][0]) & wanted
            for q in range(4):
                if got >> q & 1:
                    out[q] = c
            wanted &= ~got
            c += 1
        return out

    def trace(self, state: int, cost: int) -> tuple[str, int]:
        """The least letters that cost ``cost`` from ``state``, and the state they end in."""
        out, i, n, sets = [], 0, len(self.rows), self.sets
        while i < n or self.ends[state] > cost:
            if i < n and cost >= DELETE and sets[cost - DELETE][i + 1] >> state & 1:
                out.append("D")
                cost, i = cost - DELETE, i + 1
                continue
            if cost >= INSERT and sets[cost - INSERT][i] >> _EDIT[state] & 1:
                out.append("I")
                cost, state = cost - INSERT, _EDIT[state]
                continue
            row = self.rows[i]
            more, to = TRUNCATED if row > 3 else 0, _STEP[row & 3][state]
            if to is not None and cost >= more and sets[cost - more][i + 1] >> to & 1:
                out.append("K")
                cost, state, i = cost - more, to, i + 1
            else:
                out.append("R")
                cost, state, i = cost - more - REROLE, _EDIT[state], i + 1
        return "".join(out), state


def between(rows: bytes) -> list[int]:
    """Costs of a piece from each state (outer) to each state."""
    columns = []
    for end in range(4):
        can = (0b0001, 0b0011 if any(r & 3 == 0 for r in rows) else 0b0010, 0b1111, 0b1111)[end]
        columns.append(Layers(rows, tuple(0 if q == end else NEVER for q in range(4))).costs(can))
    return [columns[end][start] for start in range(4) for end in range(4)]


class Piece(NamedTuple):
    """Consecutive rows of a conversation: the rows that may stay, and how many that must go are before each and at the end."""

    gone: list[int]
    roles: list[str]
    texts: list[str]
    rows: bytes
    tail: int


def audit(piece: Piece, letters: str) -> str:
    """``letters``, of the rows that may stay, with the deletes of those that must go: at each place they come first."""
    out, i = ["D" * (piece.gone[0] if piece.gone else piece.tail)], 0
    for x in letters:
        out.append(x)
        if x != "I":
            i += 1
            out.append("D" * (piece.gone[i] if i < len(piece.gone) else piece.tail))
    return "".join(out)


def repaired(piece: Piece, letters: str, state: int):
    """The turns that ``letters`` leave, as ``role:text``."""
    i = 0
    for x in letters:
        if x == "K":
            yield f"{piece.roles[i]}:{piece.texts[i]}"
            state = _STEP[piece.rows[i] & 3][state]
        elif x != "D":
            state = _EDIT[state]
            yield ("user:" if state == 2 else "assistant:") + (piece.texts[i] if x == "R" else "")
        i += x != "I"


class Digest:
    """SHA-256 of turns joined by newlines, as they come."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def update(self, turns) -> None:
        for t in turns:
            self.sha.update((("\n" if self.any else "") + t).encode("utf-8", "surrogatepass"))
            self.any = True

    def hexdigest(self) -> str:
        return self.sha.hexdigest()


_BODY = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("gone", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("rows", pa.binary()), ("tail", pa.int64()), ("between", pa.list_(pa.int64())), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string())])
_BODY_SQL = "conv_id bigint, part int, seq bigint, illegal bigint, first string, last string, gone array<bigint>, roles array<string>, texts array<string>, rows binary, tail bigint, between array<bigint>, cost bigint, audit string, sha string"


def _pieces(ordered: DataFrame) -> DataFrame:
    """Pieces of ``ordered(conv_id, role, text, n, stays, truncated)``, of which whole conversations come repaired: cost, audit and sha are set."""

    def run(batches):
        part, seq, done, size, known = TaskContext.get().partitionId(), 0, [], 0, {}
        key, first_of_task = None, True
        held = last = None

        def start():
            return {"gone": [], "roles": [], "texts": [], "rows": bytearray(), "tail": 0, "illegal": 0, "first": None, "last": None, "bytes": 0}

        def put(open_: bool):
            nonlocal seq, size
            piece = Piece(held["gone"], held["roles"], held["texts"], bytes(held["rows"]), held["tail"])
            row = {"conv_id": key, "part": part, "seq": seq, "illegal": held["illegal"], "first": held["first"], "last": held["last"]}
            if open_:
                row |= piece._asdict() | {"between": between(piece.rows)}
                size += held["bytes"]
            else:
                if piece.rows not in known:
                    if len(known) > 50_000:
                        known.clear()
                    layers = Layers(piece.rows)
                    cost = layers.costs(1)[0]
                    known[piece.rows] = cost, layers.trace(0, cost)[0]
                cost, letters = known[piece.rows]
                sha = Digest()
                sha.update(repaired(piece, letters, 0))
                row |= {"cost": cost + DELETE * (sum(piece.gone) + piece.tail), "audit": audit(piece, letters), "sha": sha.hexdigest()}
            done.append(row)
            seq += 1

        def flush():
            nonlocal size
            out = pa.RecordBatch.from_pylist(done, _BODY)
            done.clear()
            size = 0
            return out

        split = False  # whether earlier pieces of this conversation have gone out
        for b in batches:
            for conv, role, text, n, stays, truncated in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text", "n", "stays", "truncated")), strict=True):
                if held is None or conv != key:
                    if held is not None:
                        put(first_of_task or split)  # the task's first conversation may have begun in the one before
                        first_of_task = False
                    key, held, last, split = conv, start(), None, False
                elif len(held["rows"]) >= PIECE or held["bytes"] >= PIECE_BYTES:
                    put(True)
                    held, split = start(), True
                initial = role[:1]
                if held["first"] is None:
                    held["first"] = initial
                    last = None
                held["illegal"] += n - 1 + (last is not None and last + initial not in _LEGAL)
                held["last"] = last = initial
                if stays:
                    held["gone"].append(held["tail"])
                    held["roles"].append(role)
                    held["texts"].append(text)
                    held["rows"].append(symbol(role, truncated))
                    held["bytes"] += len(text)
                    held["tail"] = n - 1
                else:
                    held["tail"] += n
                if len(done) >= 2000 or size > PIECE_BYTES:
                    yield flush()
        if held is not None:
            put(True)  # and the last one may go on in the next
        if done:
            yield flush()

    return map_arrow(ordered, run, _BODY_SQL, heavy="text", most=4 << 20)


def _followed(pieces: DataFrame) -> DataFrame:
    """conv_id, part, seq, after: what everything behind a piece costs from each state, and the cost of the whole with its first piece."""
    schema = pa.schema([("c", pa.int64()), ("p", pa.int32()), ("s", pa.int64()), ("after", pa.list_(pa.int64()))])

    def run(batches):
        key, costs, any_ = None, list(ENDS), False
        for b in batches:
            out = []
            for conv, part, seq, m in zip(*(b[c].to_pylist() for c in ("conv_id", "part", "seq", "between")), strict=True):
                if not any_ or conv != key:
                    key, costs, any_ = conv, list(ENDS), True
                out.append({"c": conv, "p": part, "s": seq, "after": costs})
                costs = [min(m[4 * q + x] + costs[x] for x in range(4)) for q in range(4)]
                costs = [min(c, NEVER) for c in costs]
            yield pa.RecordBatch.from_pylist(out, schema)

    own = pieces.select("conv_id", "part", "seq", "between").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    return map_arrow(own, run, "c bigint, p int, s bigint, after array<bigint>")


_TRACED = "conv_id bigint, part int, seq bigint, illegal bigint, first string, last string, gone array<bigint>, roles array<string>, texts array<string>, rows binary, tail bigint, letters array<string>, ends array<int>, cost array<bigint>"


def _traced(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the letters, the state in the end and the cost for each state that they may be entered in (null where none leads on)."""
    same = ["conv_id", "part", "seq", "illegal", "first", "last", "gone", "roles", "texts", "rows", "tail"]

    def run(batches):
        for b in batches:
            letters, ends, paid = [], [], []
            for rows, after in zip(b["rows"].to_pylist(), b["after"].to_pylist(), strict=True):
                least = min(after)
                left = tuple(c - least if c < NEVER else NEVER for c in after)
                layers = Layers(rows, left)
                # What leads on from a state is known of its own costs, so that layers end.
                can = sum(1 << q for q in range(4) if _leads(rows, q, left))
                costs = layers.costs(can)
                got = [layers.trace(q, c) if c < NEVER else (None, None) for q, c in enumerate(costs)]
                letters.append([x for x, _ in got])
                ends.append([s for _, s in got])
                paid.append([None if s is None else c - left[s] for (_, s), c in zip(got, costs, strict=True)])
            more = pa.array(letters, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32())), pa.array(paid, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in same), *more], names=[*same, "letters", "ends", "cost"])

    return map_arrow(pieces.select(*same, "after"), run, _TRACED)


def _leads(rows: bytes, state: int, ends: tuple[int, ...]) -> bool:
    """Whether a piece entered in ``state`` can be left in a state that an end follows."""
    if ends[2] < NEVER or ends[3] < NEVER:
        return True
    return ends[0] < NEVER and state == 0 or ends[1] < NEVER and (state == 1 or state == 0 and any(r & 3 == 0 for r in rows))


def _joined(traced: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit, sha of conversations in several pieces, in their order."""
    schema = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string())])

    def run(batches):
        key, state = None, None

        def row():
            at, illegal, cost, audits, sha, _ = state
            return pa.RecordBatch.from_pylist([{"conv_id": key, "illegal": illegal, "cost": cost, "audit": "".join(audits), "sha": sha.hexdigest()}], schema)

        for b in batches:
            for x in b.to_pylist():
                if state is None or x["conv_id"] != key:
                    if state is not None:
                        yield row()
                    key, state = x["conv_id"], [0, 0, 0, [], Digest(), None]
                at, last = state[0], state[5]
                piece, letters = Piece(x["gone"], x["roles"], x["texts"], x["rows"], x["tail"]), x["letters"][at]
                state[1] += x["illegal"] + (last is not None and last + x["first"] not in _LEGAL)
                state[2] += x["cost"][at] + DELETE * (sum(piece.gone) + piece.tail)
                state[3].append(audit(piece, letters))
                state[4].update(repaired(piece, letters, at))
                state[0], state[5] = x["ends"][at], x["last"]
        if state is not None:
            yield row()

    return map_arrow(traced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"), run, "conv_id bigint, illegal bigint, cost bigint, audit string, sha string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows as a fifth of them come out of a careless copy, by ``crc32(conv_id:turn) % 20``: dropped, emptied, without ``.!?``, repeated or said by the user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in ``turns(conv_id, turn, role, text)``."""
    space = F.lit(" ")
    own = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    sha, at = F.sha2("text", 256), F.struct(F.col("turn").isNotNull().alias("k"), "turn")
    first = own.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), sha.alias("f_sha")).agg(F.min(at).alias("first"))
    first = materialize(first, "repair-first")
    alike = own.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("sha", sha)
    met = alike.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("sha") == F.col("f_sha")))
    trimmed = F.rtrim("text", F.lit(WHITESPACE))
    new = F.col("first").eqNullSafe(at)
    flags = {"blank": trimmed == "", "new": new, "ended": F.right(trimmed, F.lit(1)).isin(".", "!", "?")}
    flagged = materialize(met.withColumns(flags).select("conv_id", "turn", "role", "text", "sha", "n", "blank", "new", "ended"), "repair-rows")
    again = F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(F.col("new"), 1).otherwise(0))
    stays = F.col("new") & ~F.col("blank")
    counts = flagged.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(again).alias("duplicate"), F.count_if(stays & ~F.col("ended")).alias("truncated"))
    parts = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = flagged.repartitionByRange(parts, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "sha").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "sha")
    pieces = materialize(_pieces(ordered.select("conv_id", "role", "text", "n", stays.alias("stays"), (~F.col("ended")).alias("truncated"))), "repair-pieces")
    result = ["conv_id", "illegal", "cost", "audit", "sha"]
    spread = pieces.where("sha IS NULL")
    after = materialize(_followed(spread), "repair-after")
    long = _joined(_traced(spread.join(after, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))))
    made = materialize(pieces.where("sha IS NOT NULL").select(*result).unionByName(long), "repair-made").withColumnRenamed("conv_id", "m_conv")
    counts = materialize(counts, "repair-counts")
    discard(first, flagged, pieces, after)
    return counts.join(made, F.col("conv_id").eqNullSafe(F.col("m_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair`` of what ``damage`` leaves of ``turns``, with a row for every conversation of ``turns``."""
    there = turns.select(F.col("conv_id").cast("bigint").alias("t_conv")).distinct()
    made = there.join(repair(damage(turns)), F.col("t_conv").eqNullSafe(F.col("conv_id")), "left")
    zero = F.lit(0).cast("bigint")
    numbers = [F.coalesce(F.col(c).cast("bigint"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return made.select(F.col("t_conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
