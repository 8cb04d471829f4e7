"""Repairing the structure of conversations at the least cost.

Of a turn only its role and its fault matter to the structure: one of nine symbols. The symbols
of a conversation's turns, in chunks, are sequences of which most occur many times. Re-Pair
replaces the most frequent adjacent pairs by rules, round after round, over all distinct
sequences. Every symbol has a transfer matrix: what it costs at least to get from one state
of the repaired conversation to another over the symbol's turns, with the edits that do it. A
rule's matrix is the min-plus product of its two symbols' matrices, made once and shared by
all sequences; the edits are ropes that share their parts. A sequence's matrix is the product
over its compressed form, a conversation's cost and audit that over its chunks.

Of two audits of equal cost between the same states neither begins the other, as it would
then miss inserts, which cost. So the least is kept by appending the same edits, and the
matrices are a semiring's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm import common
from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize

# White space, ends of sentences, and what edits cost; an undeleted cut-off turn costs one more.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE_COST, REROLE_COST, INSERT_COST, CUT_COST = 3, 2, 2, 1

#: Numbers of turns that a chunk spans; a task holds the symbols and initials of one chunk's turns, no texts.
CHUNK_TURNS = 1024
#: Bounds of the grammar. What they leave uncompressed is evaluated symbol by symbol.
ROUNDS, PAIRS_A_ROUND, MAX_RULES = 8, 24, 128
#: Symbols of rules are characters from here on.
FIRST_RULE = 0x100

#: States of a repaired conversation so far: nothing, a system turn, ends with a user turn, with an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where a turn may follow, by its role's initial, and the state that it leads to.
FOLLOWS = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
ROLES = {"u": "user", "a": "assistant"}
#: Symbols: turns that must go, else the role's initial (o: other), upper case if cut off.
GONE, OTHER = "x", "o"

# A rope is a string or (length, rope, rope); an entry of a matrix is (cost, rope), or None where no edits lead.
Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


def length(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def joined(left: Rope, right: Rope) -> Rope:
    return right if not length(left) else left if not length(right) else (length(left) + length(right), left, right)


def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += [part[2], part[1]]
    return "".join(out)


def before(x: Rope, y: Rope) -> bool:
    """Whether ``x`` is less than ``y``, by code points; parts that both share at one place aren't looked into."""
    a, b = [x], [y]
    while a and b:
        left, right = a.pop(), b.pop()
        if left is right:
            continue
        if isinstance(left, str) and isinstance(right, str):
            n = min(len(left), len(right))
            if left[:n] != right[:n]:
                return left < right
            a += [left[n:]] if len(left) > n else []
            b += [right[n:]] if len(right) > n else []
        elif length(left) >= length(right) and not isinstance(left, str) or isinstance(right, str):
            a += [left[2], left[1]]
            b.append(right)
        else:
            a.append(left)
            b += [right[2], right[1]]
    return bool(b) and not a


def better(x: tuple[int, Rope] | None, y: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    """The cheaper entry; of equal ones that with the least edits."""
    if x is None or y is None:
        return y if x is None else x
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if before(y[1], x[1]) else x


def applied(row: Sequence, matrix: Matrix) -> list:
    """One row of a min-plus product."""
    out: list = [None] * len(STATES)
    for r in STATES:
        if row[r] is not None:
            cost, rope = row[r]
            for q, entry in enumerate(matrix[r]):
                if entry is not None and (out[q] is None or cost + entry[0] <= out[q][0]):
                    out[q] = better(out[q], (cost + entry[0], joined(rope, entry[1])))
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    return [applied(row, right) for row in left]


def inserts() -> Matrix:
    """From state to state by inserted turns alone."""
    made: Matrix = [[(0, "") if p == q else None for q in STATES] for p in STATES]
    for p in STATES:
        state, cost, edits = p, 0, ""
        while True:
            initial = "a" if state == USER else "u"
            state, cost, edits = FOLLOWS[initial][1], cost + INSERT_COST, edits + "I"
            if made[p][state] is not None:
                break
            made[p][state] = (cost, edits)
    return made


INSERTS = inserts()


def terminal(symbol: str) -> Matrix:
    """A turn's edit, and then any inserts."""
    edits: Matrix = [[(DELETE_COST, "D") if p == q else None for q in STATES] for p in STATES]
    if symbol != GONE:
        cut = CUT_COST if symbol.isupper() else 0
        options = [(i, REROLE_COST + cut, "R") for i in ROLES] + [(symbol.lower(), cut, "K")]
        for initial, cost, edit in options:
            states, to = FOLLOWS.get(initial, ((), NOTHING))
            for p in states:
                edits[p][to] = better(edits[p][to], (cost, edit))
    return product(edits, INSERTS)


SYMBOLS = [GONE, *"suao", *"SUAO"]


def matrices(rules: Sequence[str]) -> dict[str, Matrix]:
    """Every symbol's matrix, rules after the symbols that they are made of."""
    known = {s: terminal(s) for s in SYMBOLS}
    for i, pair in enumerate(rules):
        known[chr(FIRST_RULE + i)] = product(known[pair[0]], known[pair[1]])
    return known


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by rule, for tests of repairs: ``conv_id, turn, role, text``; nulls in the last two are a space.

    The CRC-32 of ``conv_id:turn`` (null: a space) modulo 20 decides: 0 drops the turn, 1 empties its text, 2 takes
    the ends of its sentences, 3 repeats it, 4 makes its role ``user``.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.explode(F.sequence(F.lit(1), times)).alias("copy"),
    ).drop("copy")


def filled(turns: DataFrame) -> DataFrame:
    """The columns that matter, with a digest of the text; a null role or text is a space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, n, blank, cut, fresh`` of ``filled`` turns: equal rows of one turn once, ``n`` times.

    ``fresh``: the first of them has not been seen earlier in its conversation. Narrow; hot texts
    are summed up before they are shuffled.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    cut = ~F.right(bare, F.lit(1)).isin(*ENDS)
    rows = turns.select("conv_id", "turn", "role", "digest", (bare == "").alias("blank"), cut.alias("cut"))
    rows = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    same = ["conv_id", "role", "digest"]
    firsts = rows.filter("not blank").groupBy(*same).agg(
        F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unnumbered")
    )
    firsts = materialize(firsts.filter("turns > 1"))
    counts = firsts.select(*same, F.col("turns").alias("n"))
    seen = lookup_join(rows, firsts.drop("turns"), same, "left", spread=["turn"], counts=counts, null_safe=True)
    fresh = F.when(F.col("unnumbered").isNull(), True).when(F.col("unnumbered"), F.col("turn").isNull())
    return seen.select(*rows.columns, fresh.otherwise(F.col("turn").eqNullSafe(F.col("first"))).alias("fresh"))


_CHUNK = "symbols string, head string, tail string, illegal long, blank long, duplicate long, cut long, turns long, low long, high long"
_CHUNK_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]


def order(turn: str = "turn") -> list[Column]:
    """Turns by number, those without one first; equal numbers by role and digest."""
    return [F.col(turn).asc_nulls_first(), F.col("role"), F.col("digest")]


def chunks(rows: DataFrame) -> DataFrame:
    """``conv_id, block`` and per chunk of turns its symbols and counts, from ``faults``."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        key, symbols, initials, counts, numbers = None, [], [], [0, 0, 0], []

        def close() -> None:
            if key is not None:
                text = "".join(symbols)
                pairs = zip(initials, initials[1:])
                illegal = sum(n - 1 if x + x not in LEGAL else 0 for x, n in runs) + sum(x + y not in LEGAL for x, y in pairs)
                low, high = (numbers[0], numbers[-1]) if numbers else (None, None)
                made.append((*key, text, initials[0], initials[-1], illegal, *counts, len(numbers), low, high))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(["conv_id", "block", *_CHUNK_NAMES], r)) for r in made], schema)
            made.clear()
            return out

        schema = None
        for b in batches:
            schema = schema or pa.schema(
                [pa.field("conv_id", b.schema.field(0).type), pa.field("block", pa.int64())]
                + [pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in _CHUNK.split(", "))]
            )
            for conv, block, turn, role, blank, cut, fresh, n in zip(*[c.to_pylist() for c in b.columns]):
                if key != (conv, block):
                    close()
                    key, symbols, initials, counts, numbers, runs = (conv, block), [], [], [0, 0, 0], [], []
                if turn is not None and (not numbers or numbers[-1] != turn):
                    numbers.append(turn)
                first = role[:1]
                initials.append(first)
                runs.append((first, n))
                symbol = first if first in FOLLOWS else OTHER
                if blank:
                    counts[0] += n
                else:
                    counts[1] += n - fresh
                    counts[2] += cut and fresh
                keep = fresh and not blank
                symbols.append((symbol.upper() if cut else symbol) + GONE * (n - 1) if keep else GONE * n)
            if len(made) >= 2_000:
                yield batch()
        close()
        if made:
            yield batch()

    block = F.floor(F.col("turn") / CHUNK_TURNS).cast("bigint")
    placed = rows.withColumn("block", block).repartition("conv_id", "block")
    dealt = placed.sortWithinPartitions(F.col("conv_id"), F.col("block"), *order())
    return dealt.select("conv_id", "block", "turn", "role", "blank", "cut", "fresh", "n").mapInArrow(
        run, f"conv_id {kind}, block long, {_CHUNK}"
    )


#: Initials of roles that may stand next to each other.
LEGAL = ("su", "ua", "au")


def grammar(sequences: DataFrame) -> tuple[list[str], DataFrame]:
    """Re-Pair over ``symbols, n`` (all distinct): the rules as pairs of symbols, and ``symbols, packed``.

    Every round counts the adjacent pairs of all sequences and makes rules of the most frequent, at most
    ``PAIRS_A_ROUND``, that don't share a place. The driver sees those pairs alone.
    """
    rules: list[str] = []
    packed = sequences.withColumn("packed", F.col("symbols"))
    for _ in range(ROUNDS):
        parts = F.split("packed", "")
        pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
        counted = packed.select(F.explode(pairs).alias("pair"), "n").filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.filter("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS_A_ROUND).collect()
        chosen: list[str] = []
        for pair in (r["pair"] for r in best):
            if not any(pair[0] == c[1] or pair[1] == c[0] for c in chosen) and len(rules) + len(chosen) < MAX_RULES:
                chosen.append(pair)
        if not chosen:
            break
        shorter = F.col("packed")
        for i, pair in enumerate(chosen, len(rules)):
            shorter = F.replace(shorter, F.lit(pair), F.lit(chr(FIRST_RULE + i)))
        packed = materialize(packed.withColumn("packed", shorter))
        rules += chosen
    return rules, packed.select("symbols", "packed")


def evaluated(packed: DataFrame, rules: list[str]) -> DataFrame:
    """``symbols, costs, audits``: each sequence's matrix, row by row; null where no edits lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        for b in batches:
            costs, audits = [], []
            for text in b.column(1).to_pylist():
                whole = known[text[0]]
                for symbol in text[1:]:
                    whole = product(whole, known[symbol])
                entries = list(chain(*whole))
                costs.append([e and e[0] for e in entries])
                audits.append([e and flat(e[1]) for e in entries])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                ["symbols", "costs", "audits"],
            )

    return packed.mapInArrow(run, "symbols string, costs array<long>, audits array<string>")


def planned(turns: DataFrame) -> DataFrame:
    """``chunks`` of ``filled`` turns, each with its sequence's matrix."""
    parts = materialize(chunks(faults(turns)))
    sequences = materialize(parts.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")))
    rules, packed = grammar(sequences)
    lookup = materialize(evaluated(packed, rules))
    # Matrices of common sequences are wide: they are sent to where the chunks are only if small, else hot ones are salted.
    return lookup_join(parts, lookup, "symbols", spread=["conv_id", "block"], counts=sequences)


class Conversation:
    """What the chunks of one conversation come to, chunk by chunk in order."""

    def __init__(self) -> None:
        self.row, self.tail, self.low, self.high = INSERTS[NOTHING], None, None, None
        self.illegal = self.blank = self.duplicate = self.cut = self.turns = 0

    def add(self, part: dict) -> None:
        entries = [c if c is None else (c, a) for c, a in zip(part["costs"], part["audits"])]
        width = len(STATES)
        self.row = applied(self.row, [entries[i : i + width] for i in range(0, len(entries), width)])
        if self.tail is not None and self.tail + part["head"] not in LEGAL:
            self.illegal += 1
        self.tail = part["tail"]
        for name in ("illegal", "blank", "duplicate", "cut", "turns"):
            setattr(self, name, getattr(self, name) + part[name])
        if part["low"] is not None:
            self.low, self.high = part["low"] if self.low is None else self.low, part["high"]

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return [gaps, self.blank, self.duplicate, self.cut, self.illegal]

    def cheapest(self) -> tuple[int, str]:
        cost, rope = better(self.row[NOTHING], self.row[ASSISTANT]) or (0, "")
        return cost, flat(rope)


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What becomes of conversations, turn by turn, from rows in which a conversation's chunks precede its turns.

    ``("start", conv_id, counts, cost, audit)``, then ``(edit, role, text)`` for every edit in order, then
    ``("end",)``. Only the audit of a conversation is held, no texts.
    """
    key: object = replayed  # no id yet
    whole, audit, at, state = Conversation(), "", 0, NOTHING

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            initial = "a" if state == USER else "u"
            at, state = at + 1, FOLLOWS[initial][1]
            yield "I", ROLES[initial], ""

    def begun() -> tuple:
        nonlocal audit, at, state
        (cost, audit), at, state = whole.cheapest(), 0, NOTHING
        return "start", key, whole.counts(), cost, audit

    open_turns = False
    for b in batches:
        names = b.schema.names
        for values in zip(*[c.to_pylist() for c in b.columns]):
            row = dict(zip(names, values))
            if key is replayed or row["conv_id"] != key:
                if key is not replayed:
                    if not open_turns:
                        yield begun()
                    yield from inserted()
                    yield ("end",)
                key, whole, open_turns = row["conv_id"], Conversation(), False
            if row["costs"] is not None:
                whole.add(row)
            elif row["role"] is not None:
                if not open_turns:
                    yield begun()
                    open_turns = True
                yield from inserted()
                edit, role, at = audit[at], row["role"], at + 1
                if edit != "D":
                    if edit == "R":
                        role = ROLES["a" if state == USER else "u"]
                    state = FOLLOWS[role[:1]][1]
                yield edit, role, row["text"]
    if key is not replayed:
        if not open_turns:
            yield begun()
        yield from inserted()
        yield ("end",)


def replay_rows(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks and turns of each conversation, in the order in which ``replayed`` takes them; ``ids`` adds conversations without turns.

    Digests of a whole conversation can only be taken in order, so a conversation's turns go through
    one task, as a stream; everything before this is split by turn.
    """
    rows = filled(turns)
    marks = ids.select("conv_id").distinct().withColumn("stage", F.lit(0))
    plans = planned(rows).drop("symbols").withColumn("stage", F.lit(1))
    both = marks.unionByName(plans, allowMissingColumns=True).unionByName(rows.withColumn("stage", F.lit(2)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "stage", F.col("block").asc_nulls_first(), *order())
    return dealt.drop("digest", "block", "turn", "stage")


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit``: the turns of the repaired conversations, numbered from 0, as (K)ept, (R)eroled or (I)nserted.

    Initials of the roles of each read ``(s?(ua)+)?``, at the least cost. ``turns(conv_id, turn, role, text)``
    are taken by turn, nulls first, rows of one turn by role and text digest; a null role or text is
    a space, null ids are one conversation, other roles count as none. A blank turn and one that repeats an earlier
    one go. Conversations without turns, and those of which none stays, have no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        ids = first.schema.field("conv_id").type
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [ids, pa.int64(), pa.string(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "position", "role", "text", "edit"]
            )

        conv, at, chars = None, 0, 0
        for event in replayed(chain([first], batches)):
            if event[0] == "start":
                conv, at = event[1], 0
            elif event[0] in ("K", "R", "I"):
                out.append((conv, at, event[1], event[2], event[0]))
                at, chars = at + 1, chars + len(event[2])
                if len(out) >= 10_000 or chars >= common.PORTION_CHARS:
                    yield batch()
                    chars = 0
        if out:
            yield batch()

    return replay_rows(turns, turns.limit(0)).mapInArrow(
        run, f"conv_id {_id_type(turns)}, position long, role string, text string, edit string"
    )


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``turns`` and ``ids(conv_id)``: its faults, the cheapest edits and a digest of the repaired turns.

    ``gaps``: numbers missing between the least and greatest turn, nulls passed over. ``blank, duplicate,
    truncated``: turns by first fault. ``illegal``: neighbours whose roles' initials aren't su, ua or au. ``audit``:
    initials of the edits in order, the least of the cheapest in ASCII. ``repaired_sha256``: of ``role:text`` of the
    ``repaired`` turns, joined by line ends. Turns are taken as in ``repaired``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        names = ["conv_id", *[c.split()[0] for c in REPORT.split(", ")]]
        kinds = [first.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        row, digest, some = (), hashlib.sha256(), False
        for event in replayed(chain([first], batches)):
            if event[0] == "start":
                row, digest, some = (event[1], *event[2], *event[3:]), hashlib.sha256(), False
            elif event[0] == "end":
                out.append((*row, digest.hexdigest()))
                if len(out) >= 2_000:
                    yield batch()
            elif event[0] != "D":
                digest.update(f"{chr(10) if some else ''}{event[1]}:{event[2]}".encode())
                some = True
        if out:
            yield batch()

    ids = turns if ids is None else ids
    return replay_rows(turns, ids).mapInArrow(run, f"conv_id {_id_type(turns)}, {REPORT}")
