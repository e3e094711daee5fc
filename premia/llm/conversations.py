"""Conversation structure repair: turns aligned to the alternating grammar ``(s?(ua)+)?`` by Wagner-Fischer tables.

A turn that stays must have the role the grammar asks for at its place, by its initial: an optional system turn, then user
and assistant by turns. A table holds the cost of aligning the turns from the i-th on with the last k roles of a target; as
all targets end alike, one table holds every feasible length. Ukkonen bands bound it: an alignment within a narrow band
gives an incumbent cost, and cells so far off the diagonal that insertions or deletions alone cost more are left out; the band is
widened until it holds all that the incumbent allows. Lengths of equal cost are traced back and their audits compared.

Conversations are hashed to tasks and sorted there, and stream through. Of a long one, ``CHUNK`` turns are aligned at a time,
from each state the grammar can be in to each other: costs add up and audits join, so the cheapest way through is carried
forward, and turns wait (on disk beyond a size, as a sort's do) only until all ways that are left agree on them.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.frames import pick

CHUNK = 512  # turns aligned at a time
BAND = 8  # first half-width of the band
WAITING = 32 << 20  # bytes of waiting turns kept in memory
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40

#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
WORD = "[^\\x20\\x09-\\x0D]"
FAULTS = ("blank", "duplicate", "truncated")


def _symbol(after: int, k: int) -> str:
    """The k-th role from the end of a target that ends in state ``after``."""

    return "ua"[(k + (after == USER)) % 2]


class Aligned:
    """Turns against the last k roles of every target that ends in one state, by banded tables of costs."""

    def __init__(self, initials: list[str], cut: np.ndarray, after: int) -> None:
        self.initials, self.after = initials, after
        self.extra = (cut * TRUNCATED).tolist()
        own = np.array([ord(x) if x else 0 for x in initials])
        # Cost of aligning each turn with an odd and an even place from the end.
        self.match = [np.where(own == ord(_symbol(after, k)), 0, REROLE) + cut * TRUNCATED for k in (1, 2)]
        self.must = np.concatenate([np.cumsum((cut * TRUNCATED)[::-1])[::-1], [0]])  # truncated turns cost that much, kept or not
        half = BAND
        while True:
            self._fill(half)
            need = max(self._reach(least) for least in (1, 2))
            if need <= half:
                return
            half = min(need, 2 * half)

    def _fill(self, half: int) -> None:
        n = len(self.initials)
        self.half = half
        self.rows: list[tuple[int, list[int]]] = [(0, [])] * (n + 1)
        below_low, below = 0, np.arange(half + 1) * INSERT
        self.rows[n] = (0, below.tolist())
        for i in range(n - 1, -1, -1):
            low, high = max(0, n - i - half), n - i + half
            k = np.arange(low, high + 1)
            padded = np.full(high - low + 2, FAR, dtype=np.int64)  # costs of the next row at low - 1 .. high
            a = max(low - 1, below_low)
            b = min(high, below_low + len(below) - 1)
            padded[a - low + 1 : b - low + 2] = below[a - below_low : b - below_low + 1]
            step = np.where(k % 2 == 1, self.match[0][i], self.match[1][i])
            cost = np.minimum(padded[1:] + DELETE, padded[:-1] + step)
            cost = np.minimum.accumulate(cost - INSERT * k) + INSERT * k
            below_low, below = low, cost
            self.rows[i] = (low, cost.tolist())

    def cost(self, i: int, k: int) -> int:
        low, row = self.rows[i]
        return row[k - low] if low <= k < low + len(row) else FAR

    def _reach(self, least: int) -> int:
        """Half-width beyond which no cell lies on a cheapest alignment of lengths least, least + 2, ..., by the incumbent."""

        low, row = self.rows[0]
        cost = min((cost for k, cost in enumerate(row, low) if k >= least and k % 2 == least % 2), default=FAR)
        if cost >= FAR:
            return 2 * self.half
        spare = cost - int(self.must[0])
        return max(spare // INSERT, min(spare, cost // DELETE))

    def lengths(self, odd: bool, least: int) -> Iterator[tuple[int, int]]:
        """(cost, k) of the feasible lengths."""

        low, row = self.rows[0]
        for k in range(max(low, least), low + len(row)):
            if (k % 2 == 1) == odd:
                yield row[k - low], k

    def trace(self, i: int, k: int, forced: list[bool], at: list[int]) -> str:
        """The ASCII-least edits of the turns from the i-th on (place at[i] among all turns, forced ones deleted) with the last k roles."""

        edits = []
        place = at[i - 1] + 1 if i else 0
        n = len(self.initials)
        while place < len(forced) or k:
            if place < len(forced) and forced[place]:
                edits.append("D")
                place += 1
                continue
            here = self.cost(i, k)
            if i < n and self.cost(i + 1, k) + DELETE == here:
                edits.append("D")
                i, place = i + 1, place + 1
            elif k and self.cost(i, k - 1) + INSERT == here:
                edits.append("I")
                k -= 1
            else:
                edits.append("K" if self.initials[i] == _symbol(self.after, k) else "R")
                i, place, k = i + 1, place + 1, k - 1
        return "".join(edits)


def align(initials: list[str], forced: list[bool], cut: list[bool], entries=(START,), exits=(START, ASSISTANT)) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest cost and ASCII-least audit from each state of ``entries`` to each of ``exits`` that can be reached."""

    at = [place for place, gone in enumerate(forced) if not gone]
    kept = [initials[place] for place in at]
    truncated = np.array([cut[place] for place in at], dtype=np.int64)
    base = DELETE * (len(forced) - len(at))
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(entry: int, after: int, cost: int, audit) -> None:
        known = found.get((entry, after))
        if known is None or cost < known[0]:
            found[entry, after] = cost, audit()
        elif cost == known[0]:
            found[entry, after] = cost, min(known[1], audit())

    for state in (START, SYSTEM):
        if state in entries and state in exits:
            offer(state, state, base + DELETE * len(at), lambda: "D" * len(forced))
    if START in entries and SYSTEM in exits:
        for i, initial in enumerate(kept):
            if initial == "s":
                cost = base + DELETE * (len(at) - 1) + TRUNCATED * int(truncated[i])
                offer(START, SYSTEM, cost, lambda i=i: "D" * at[i] + "K" + "D" * (len(forced) - at[i] - 1))
    for after in (USER, ASSISTANT):
        if after not in exits:
            continue
        table = Aligned(kept, truncated, after)
        for entry in entries:
            odd = (after == USER) != (entry == USER)
            least = 0 if entry == after else 1 if odd else 2
            lengths = list(table.lengths(odd, least))
            best = min((cost for cost, _ in lengths), default=FAR)
            for cost, k in lengths:
                if cost == best < FAR:
                    offer(entry, after, base + cost, lambda k=k: table.trace(0, k, forced, at))
            if entry == START:
                for i, initial in enumerate(kept):
                    if initial != "s":
                        continue
                    before = base + DELETE * i + TRUNCATED * int(truncated[i])
                    low, row = table.rows[i + 1]
                    for k in range(max(low, least), low + len(row)):
                        if (k % 2 == 1) == odd and row[k - low] < FAR and before + row[k - low] <= found.get((entry, after), (FAR,))[0]:
                            offer(entry, after, before + row[k - low], lambda i=i, k=k: "D" * at[i] + "K" + table.trace(i + 1, k, forced, at))
    return found


def _edits(audit: str, state: int, initials: list[str]) -> Iterator[tuple[int, str | None, int]]:
    """(turn or -1, new role or None, state after) of each edit of an audit that starts in ``state``."""

    place = 0
    for edit in audit:
        if edit == "D":
            yield place, None, state
        else:
            wanted = "assistant" if state == USER else "user"
            if edit == "K" and initials[place] == "s":
                state = SYSTEM
            else:
                state = ASSISTANT if wanted == "assistant" else USER
            yield (-1 if edit == "I" else place), (None if edit == "K" else wanted), state
        place += edit != "I"


class Output:
    """Edits as Arrow batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, step: int, turns: Turns, first: int, audit: str, state: int) -> tuple[int, int]:
        """Edits of turns from ``first`` on; the next step and the state after."""

        index, steps, edits, faults, illegal, costs, roles, anchors = self.columns
        count = len(audit) - audit.count("I")
        initials = turns.initials[first : first + count]
        for edit, (place, role, state) in zip(audit, _edits(audit, state, initials)):
            source = None if place < 0 else first + place
            index.append(source)
            steps.append(step)
            edits.append(edit)
            faults.append(None if place < 0 else turns.faults[source])
            illegal.append(place >= 0 and turns.illegal[source])
            cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            costs.append(cost + (TRUNCATED if edit in "KR" and faults[-1] == "truncated" else 0))
            roles.append(role)
            anchors.append(first)
            step += 1
        return step, state

    def flush(self, turns: Turns, conv) -> Iterator[pa.RecordBatch]:
        """``conv``: the conversations' ids, one a row of ``turns`` or one for all."""

        index, steps, edits, faults, illegal, costs, roles, anchors = self.columns
        if not index:
            return
        at = pa.array(index, pa.int64())
        if isinstance(conv, pa.Scalar):
            ids = pa.array([conv.as_py()] * len(index), conv.type)
        else:
            ids = conv.take(pa.array(anchors, pa.int64()))
        own = turns.role.take(at)
        new = pa.array(roles, pa.string())
        role = pc.coalesce(new, own)
        text = turns.text.take(at).fill_null("")
        columns = [ids, pa.array(steps, pa.int64()), pa.array(edits), pa.array(faults, pa.string()), pa.array(illegal), pa.array(costs, pa.int64()), turns.turn.take(at), role, text]
        self.columns = [[] for _ in range(8)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


class Turns:
    """Columns of turns in order, and what alignment needs of them."""

    def __init__(self, table: pa.Table, before: str | None = None) -> None:
        table = table.combine_chunks()
        self.table = table
        self.turn, self.role, self.text = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column for column in (table["turn"], table["role"], table["text"]))
        self.initials = [role[:1] for role in table["role"].to_pylist()]
        self.faults = table["fault"].to_pylist()
        self.illegal = [False] * len(self.initials)

    def pairs(self, first: int, end: int, before: str | None) -> None:
        """Mark turns whose initial may not follow the one before."""

        for i in range(first, end):
            if before is not None:
                self.illegal[i] = before + self.initials[i] not in ("su", "ua", "au")
            before = self.initials[i]

    def align(self, first: int, end: int, **states):
        faults = self.faults[first:end]
        forced = [fault in ("blank", "duplicate") for fault in faults]
        return align(self.initials[first:end], forced, [fault == "truncated" for fault in faults], **states)


class Long:
    """A conversation of more than a chunk: the cheapest way to each state, and the chunks on which ways still differ."""

    def __init__(self, conv: pa.Scalar, output: Output) -> None:
        self.conv, self.output, self.before, self.step, self.state = conv, output, None, 0, START
        self.ways: dict[int, tuple[int, list[tuple[int, str]]]] = {START: (0, [])}  # cost; (state before, audit) of waiting chunks
        self.store = tempfile.SpooledTemporaryFile(max_size=WAITING)  # as a sort's spill: gone with the task
        self.sizes: list[int] = []  # of the waiting chunks
        self.read = 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        turns = Turns(table)
        n = len(turns.initials)
        turns.pairs(0, n, self.before)
        self.before = turns.initials[-1]
        found = turns.align(0, n, entries=tuple(self.ways), exits=(START, SYSTEM, USER, ASSISTANT))
        following: dict[int, tuple[int, list]] = {}
        for (entry, after), (cost, audit) in found.items():
            so_far, way = self.ways[entry]
            option = so_far + cost, way + [(entry, audit)]
            known = following.get(after)
            if known is None or option[0] < known[0] or (option[0] == known[0] and _audit(option[1]) < _audit(known[1])):
                following[after] = option
        self.ways = following
        buffer = pa.BufferOutputStream()
        kept = table.append_column("illegal", pa.array(turns.illegal))
        with pa.ipc.new_stream(buffer, kept.schema) as stream:
            stream.write_table(kept)
        raw = buffer.getvalue()
        self.store.seek(0, 2)
        self.store.write(raw)
        self.sizes.append(raw.size)
        yield from self._settle()

    def _settle(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Pass on the chunks on which all ways agree."""

        while self.sizes and len({way[0] for _, way in self.ways.values()}) == 1:
            state, audit = next(iter(self.ways.values()))[1][0]
            self.store.seek(self.read)
            table = pa.ipc.open_stream(self.store.read(self.sizes[0])).read_all()
            self.read += self.sizes.pop(0)
            turns = Turns(table)
            turns.illegal = table["illegal"].to_pylist()
            self.step, self.state = self.output.add(self.step, turns, 0, audit, state)
            yield from self.output.flush(turns, self.conv)
            self.ways = {after: (cost, way[1:]) for after, (cost, way) in self.ways.items()}
        if not self.sizes:
            self.store.seek(0)
            self.store.truncate()
            self.read = 0

    def end(self) -> Iterator[pa.RecordBatch]:
        ways = [self.ways[state] for state in (START, ASSISTANT) if state in self.ways]
        self.ways = {0: min(ways, key=lambda way: (way[0], _audit(way[1])))}
        yield from self._settle()


def _audit(way: list[tuple[int, str]]) -> str:
    return "".join(audit for _, audit in way)


def _repairer(schema: pa.Schema, chunk: int):
    def repair(batches):
        output = Output(schema)
        left: pa.Table | None = None  # the last conversation so far, or what is not yet aligned of a long one
        long: Long | None = None

        def whole(table: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
            turns = Turns(table)
            for first, end in zip(bounds, bounds[1:]):
                turns.pairs(first, end, None)
                found = turns.align(first, end)
                _, audit = min(found.values())
                output.add(0, turns, first, audit, START)
            yield from output.flush(turns, table["conv_id"].combine_chunks())

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            table = table.combine_chunks()
            ids = table["conv_id"].to_pylist()
            bounds = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)]
            if long is not None and len(bounds) > 2:
                yield from _feed(long, table.slice(0, bounds[1]), chunk)
                yield from long.end()
                long, bounds = None, bounds[1:]
            run: list[int] = []
            for first, end in zip(bounds[:-1], bounds[1:-1]):
                if end - first > chunk:
                    whole_long = Long(table["conv_id"][first], output)
                    yield from _feed(whole_long, table.slice(first, end - first), chunk)
                    yield from whole_long.end()
            run = [b for b in bounds[:-1]]
            for group in _runs(run, chunk):
                yield from whole(table.slice(group[0], group[-1] - group[0]), [b - group[0] for b in group])
            left = table.slice(bounds[-2])
            while len(left) > chunk:
                long = long or Long(left["conv_id"][0], output)
                yield from long.add(left.slice(0, chunk))
                left = left.slice(chunk)
        if left is not None and long is not None:
            yield from long.add(left)
            yield from long.end()
        elif left is not None:
            yield from whole(left, [0, len(left)])

    return repair


def _feed(long: Long, table: pa.Table, chunk: int) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(table), chunk):
        yield from long.add(table.slice(first, chunk))


def _runs(bounds: list[int], chunk: int) -> Iterator[list[int]]:
    """Bounds of neighbouring conversations of at most a chunk."""

    run: list[int] = []
    for first, end in zip(bounds, bounds[1:]):
        if end - first > chunk:
            if run:
                yield run
            run = []
        else:
            run = run + [end] if run else [first, end]
    if run:
        yield run


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The edits that make each conversation fit the grammar, in order and, within a task, conversation by conversation.

    Turns are taken by turn (NULL first), equal turns by role and text; a NULL role or text counts as one space. A row's first fault
    counts: blank (no word), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no space is
    none of ``.!?``). Keep (K) costs 0, rerole to user or assistant (R) 3, delete (D) 4, insert a turn without text (I) 3; blank and duplicate
    turns are deleted, a truncated turn that is not adds 3. Among the cheapest audits the ASCII-least is taken.

    Returns conv_id, step (from 0), edit, fault (of the row, NULL for an inserted one), illegal (may the row's initial not follow that of the row
    before?), cost, turn (NULL for an inserted one), role and text (of the turn after the edit; a deleted one's own). Rows without
    conv_id are one conversation. An empty table gives no rows; other columns are dropped.
    """

    source = pick(conversations, "conv_id", "turn", "role", "text")
    source = source.withColumns({name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("role", "text")})
    rows = source.repartition("conv_id")
    again = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank")
        .when(F.col("again") > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    rows = rows.withColumn("again", F.row_number().over(again)).select("conv_id", "turn", "role", "text", "again", fault.alias("fault"))
    rows = rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "again")
    rows = rows.drop("again")
    shape = T.StructType(
        [
            source.schema["conv_id"], T.StructField("step", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("fault", T.StringType()),
            T.StructField("illegal", T.BooleanType()), T.StructField("cost", T.LongType()), source.schema["turn"], T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        ]
    )
    return rows.mapInArrow(_repairer(to_arrow_schema(shape), chunk), shape)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summarizer(schema: pa.Schema):
    def summarize(batches):
        now, open_ = None, False
        done: list[tuple] = []

        def close():
            counts, low, high, distinct, cost, audit, digest, illegal, _, _ = now
            gaps = 0 if low is None else high - low + 1 - distinct
            done.append((conv, gaps, *(counts[fault] for fault in FAULTS), illegal, cost, "".join(audit), digest.hexdigest()))

        conv = None
        for batch in batches:
            names = ("conv_id", "step", "edit", "fault", "illegal", "cost", "turn", "role", "text")
            for conv_id, step, edit, fault, illegal, cost, turn, role, text in zip(*(batch.column(name).to_pylist() for name in names)):
                if step == 0:
                    if open_:
                        close()
                    conv, open_ = conv_id, True
                    now = [dict.fromkeys(FAULTS, 0), None, None, 0, 0, [], hashlib.sha256(), 0, None, False]
                if fault:
                    now[0][fault] += 1
                if edit != "I" and turn is not None and turn != now[2]:
                    now[1] = turn if now[1] is None else now[1]
                    now[2], now[3] = turn, now[3] + 1
                now[4] += cost
                now[5].append(edit)
                if edit != "D":
                    now[6].update(("\n" * now[9] + f"{role}:{text}").encode())
                    now[9] = True
                now[7] += illegal
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if open_:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    return summarize


def summarize(edits: DataFrame) -> DataFrame:
    """One row a conversation from edits as repair() returns them, neither shuffled nor sorted: conv_id, gaps (turn numbers missing
    between the least and the greatest), blank, duplicate, truncated, illegal, cost, audit (the edits' initials) and repaired_sha256 (of the
    repaired turns' ``role:text``, joined by line ends)."""

    shape = T.StructType([edits.schema["conv_id"], *T._parse_datatype_string(SUMMARY).fields])
    return edits.mapInArrow(_summarizer(to_arrow_schema(shape)), shape)
