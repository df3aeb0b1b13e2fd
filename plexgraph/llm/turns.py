"""Repair of conversation structure by a min-plus matrix scan.

A repaired conversation has the role initials (s?(ua)+)?, which an automaton of four states accepts.
Each turn becomes a 4x4 matrix whose element (i, j) is the cheapest (cost, audit) that leads from
state i to state j past this turn: the closure of inserted turns, then the turn's own edit.  The
product of all turns' matrices, over the semiring of (least cost, then least audit; sum,
concatenation), and of one last closure is the whole conversation's answer.  The product is
associative, so a conversation of any length is cut wherever the range sort cuts it: every task reduces
its rows by a balanced tree, and what lies at a task's two ends is merged by further rounds of groups
of a fixed number.  Concatenation keeps the order of audits because two elements of one cost over the
same rows are never one the prefix of the other: what is longer has more inserts, which cost more.

Equal rows (conversation, turn, role and text) are folded into one with a count before anything is
sorted, faults are told by 128-bit hashes in narrow rows, and texts are shuffled once, to (conversation,
slice), where the audit that belongs there precedes them.  The digest of a repaired conversation is a
sequential hash by nature: of a conversation in several slices one task streams the chunks of its
repaired text, in constant memory.

Edge cases: a null role or text counts as one space, so such a text is blank and such a role fits no
state; turns that are null come first; rows of equal turns follow each other by role, then by the
hash of their text; repeated rows are duplicates; a null conv_id is a conversation like any other; a
conversation without rows has zeros, an empty audit and the hash of the empty string; a role is
judged by its first character, an empty one fits no state; a text or a conversation of any length is
handled; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._shared import CRC_TABLE_SQL, crc32_sql, drop_staged, hot_keys, ready, spread_join, stage, table

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STATES = 4  # nothing yet, after s, after u, after a
ACCEPTED = (0, 3)
BLANKS = " \t\n\x0b\x0c\r"
FINE, CUT, BLANK = 0, 1, 2
#: Rows that one task multiplies in a row before it merges, segments that one round merges, bytes of a digest's chunk.
LEAF, FAN, CHUNK = 32, 16, 1 << 20

Element = tuple[int, str] | None
Matrix = list[list[Element]]


def step(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, if it may follow."""
    return {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)


IDENTITY: Matrix = [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]


def either(a: Element, b: Element) -> Element:
    return a if b is None else b if a is None else min(a, b)


def product(left: Matrix, right: Matrix) -> Matrix:
    """left then right; left may have fewer rows."""
    out: Matrix = []
    for row in left:
        best: list[Element] = [None] * STATES
        for at, way in enumerate(row):
            if way is not None:
                cost, audit = way
                for to, more in enumerate(right[at]):
                    if more is not None:
                        found = (cost + more[0], audit + more[1])
                        if best[to] is None or found < best[to]:
                            best[to] = found
        out.append(best)
    return out


def power(m: Matrix, n: int) -> Matrix:
    out = IDENTITY
    while n:
        if n & 1:
            out = product(out, m)
        m, n = product(m, m) if n > 1 else m, n >> 1
    return out


def _edges(ways: Iterable[tuple[int, int | None, int, str]]) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i, j, cost, letter in ways:
        if j is not None:
            out[i][j] = either(out[i][j], (cost, letter))
    return out


def _closure() -> Matrix:
    """Any number of inserts: of STATES states, paths of STATES - 1 steps reach all."""
    once = _edges((i, step(i, r), INSERT, "I") for i in range(STATES) for r in "ua")
    return power([[either(once[i][j], IDENTITY[i][j]) for j in range(STATES)] for i in range(STATES)], STATES - 1)


CLOSURE = _closure()


@cache
def move(initial: str, cut: bool, gone: bool) -> Matrix:
    """A turn's matrix: inserts, then the turn kept, given another role, or deleted; gone must be deleted."""
    ways = [(i, i, DELETE, "D") for i in range(STATES)]
    if not gone:
        more = TRUNCATED if cut else 0
        ways += [(i, step(i, initial), more, "K") for i in range(STATES)]
        ways += [(i, step(i, r), REROLE + more, "R") for i in range(STATES) for r in "ua"]
    return product(CLOSURE, _edges(ways))


def scanned(moves: list[Matrix], start: Matrix = IDENTITY) -> Matrix:
    """The product of moves by a balanced tree, so that audits are copied log n times."""
    if len(moves) <= LEAF:
        return reduce(product, moves, start)
    half = len(moves) // 2
    return product(scanned(moves[:half], start), scanned(moves[half:]))


def finished(m: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, from the product of its turns."""
    ends = product(m[:1], CLOSURE)[0]
    return min(x for x in (ends[s] for s in ACCEPTED) if x is not None)


def slices(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut after so many turns each; inserts go with the turn that follows, the last ones with the last slice."""
    out, at = [], 0
    for n in sizes:
        low = at
        while n:
            n -= audit[at] != "I"
            at += 1
        out.append(audit[low:at])
    out[-1] += audit[at:]
    return out


# --- rows -------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): a fixed twentieth each is dropped (no copy), emptied, robbed of its sentence ends, repeated (two copies), or given the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _known(rows: DataFrame) -> DataFrame:
    """rows with nulls told, state (FINE, CUT or BLANK) and said, the hash of conversation, role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), *(["copies"] if "copies" in rows.columns else [F.lit(1).cast("long").alias("copies")]))
    ends = F.rtrim("text", F.lit(BLANKS))
    state = F.when(ends == "", BLANK).when(F.endswith(ends, F.lit(".")) | F.endswith(ends, F.lit("!")) | F.endswith(ends, F.lit("?")), FINE).otherwise(CUT)
    said = F.md5(F.concat(space("conv_id"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return own.select("conv_id", "turn", "role", "text", "copies", state.cast("int").alias("state"), F.unhex(said).alias("said"))


ORDER = ["conv_id", "turn", "role", "said"]


def _folded(known: DataFrame) -> DataFrame:
    """Narrow rows, equal ones folded: ORDER, state, n, and late where role and text were seen at an earlier turn."""
    rows = stage(known.groupBy(*ORDER, "state").agg(F.sum("copies").alias("n")), "turns")
    able = rows.where((F.col("n") > 0) & (F.col("state") != BLANK))
    seen = able.groupBy("said").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = hot_keys(seen, F.xxhash64("said"), rows.count())
    met = spread_join(rows, seen.drop("n"), ["said"], F.xxhash64("said"), hot, "left")
    return met.select(*ORDER, "state", "n", F.coalesce(F.col("first") < F.struct("turn"), F.lit(False)).alias("late"))


TOTALS = ["rows", "turns", "blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}
SEGMENT = (
    "conv_id long, part int, edge boolean, first_turn long, last_turn long, first_initial string, last_initial string, "
    + ", ".join(f"{x} long" for x in TOTALS)
    + ", cost array<long>, audit array<string>, pieces array<struct<rows:long,turn:long,role:string,said:binary>>"
)


class Segment:
    """What a run of one conversation's rows adds up to; merged with its successor by +."""

    def __init__(self, conv_id: int | None, part: int):
        self.conv_id, self.part, self.edge = conv_id, part, False
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.matrix, self.pieces = IDENTITY, []
        self._moves: list[Matrix] = []

    def add(self, turn: int | None, role: str, said: bytes, state: int, n: int, late: bool) -> None:
        """n equal rows, in order."""
        if not self.pieces:
            self.pieces = [{"rows": 0, "turn": turn, "role": role, "said": said}]
        if not n:
            return
        initial = role[:1]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.rows:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.illegal += (n - 1) * (2 * initial not in LEGAL)
        self.last_initial = initial
        self.rows += n
        self.pieces[0]["rows"] += n
        again = n if late else n - 1
        if state == BLANK:
            self.blank += n
            again = n
        else:
            self.duplicate += again
        if again < n:
            self.truncated += state == CUT
            self._moves.append(move(initial, state == CUT, False))
        if again:
            self._moves.append(power(move("", False, True), again))

    def close(self, whole: bool) -> Segment:
        """Multiply the moves; of a whole conversation only the start state counts."""
        self.matrix = scanned(self._moves, IDENTITY[:1] if whole else IDENTITY)
        self._moves = []
        return self

    def __add__(self, other: Segment) -> Segment:
        if self.rows and other.rows:
            self.illegal += self.last_initial + other.first_initial not in LEGAL
        if other.first_turn is not None:
            self.turns -= self.last_turn == other.first_turn
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        self.first_initial = other.first_initial if self.first_initial is None else self.first_initial
        self.last_initial = self.last_initial if other.last_initial is None else other.last_initial
        for x in TOTALS:
            setattr(self, x, getattr(self, x) + getattr(other, x))
        self.matrix = product(self.matrix, other.matrix)
        self.pieces += other.pieces
        return self

    def row(self) -> dict:
        out = {x: getattr(self, x) for x in ("conv_id", "part", "edge", "first_turn", "last_turn", "first_initial", "last_initial", *TOTALS, "pieces")}
        flat = [x for r in self.matrix for x in r]
        return out | {"cost": [None if x is None else x[0] for x in flat], "audit": [None if x is None else x[1] for x in flat]}

    @classmethod
    def of(cls, row: dict) -> Segment:
        out = cls(row["conv_id"], row["part"])
        out.__dict__ |= {x: row[x] for x in ("edge", "first_turn", "last_turn", "first_initial", "last_initial", *TOTALS, "pieces")}
        flat = [None if c is None else (c, a) for c, a in zip(row["cost"], row["audit"], strict=True)]
        out.matrix = [flat[i : i + STATES] for i in range(0, len(flat), STATES)]
        return out


def _types(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _segments(folded: DataFrame) -> DataFrame:
    """One row for each conversation and task of a range sort; edge marks a task's first and last, which may go on elsewhere."""
    types = _types(SEGMENT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, first, done = TaskContext.get().partitionId(), None, True, []
        for batch in batches:
            for conv_id, turn, role, said, state, n, late in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.close(not first))
                        now.edge, first = first, False
                    now = Segment(conv_id, part)
                now.add(turn, role, said, state, n, late)
            if len(done) > 4096:
                yield pa.RecordBatch.from_pylist([x.row() for x in done], types)
                done = []
        if now is not None:
            now.edge = True
            done.append(now.close(False))
        yield pa.RecordBatch.from_pylist([x.row() for x in done], types)

    ordered = folded.select(*ORDER, "state", "n", "late").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(scan, SEGMENT)


def _merged(edges: DataFrame) -> DataFrame:
    """Segments of tasks' ends, two for each task, merged by rounds of FAN neighbours to one for each conversation."""
    types = _types(SEGMENT)

    def merge(group: pa.Table) -> pa.Table:
        parts = [Segment.of(x) for x in sorted(group.to_pylist(), key=lambda x: x["part"])]
        whole = reduce(lambda a, b: a + b, parts)
        whole.part //= FAN
        return pa.Table.from_pylist([whole.row()], types)

    last = edges.agg(F.max("part")).first()[0] or 0
    now = edges
    while True:
        before, now = now, stage(now.groupBy("conv_id", F.floor(F.col("part") / FAN)).applyInArrow(merge, SEGMENT), "merged-turns")
        if before is not edges:
            drop_staged(before)
        if not last:
            return now
        last //= FAN


PIECES = "array<struct<rows:long,turn:long,role:string,said:binary>>"
REPORT = f"conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, headed boolean, audits array<struct<audit:string,before:long>>, pieces {PIECES}"


def reports(rows: DataFrame) -> DataFrame:
    """One row for each conversation (REPORT): its faults, the cheapest repair, and the audit's slices, each with the turns left before it, and the first row of each."""
    ready(rows.sparkSession)
    found = stage(_segments(_folded(_known(rows).drop("text"))), "turn-segments")
    types = _types(REPORT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in map(Segment.of, batch.to_pylist()):
                cost, audit = finished(x.matrix)
                parts = slices(audit, [p["rows"] for p in x.pieces])
                left = [len(p) - p.count("D") for p in parts]
                gaps = 0 if x.first_turn is None else x.last_turn - x.first_turn + 1 - x.turns
                told = {"gaps": min(gaps, (1 << 63) - 1), "cost": cost, "audit": audit, "headed": sum(left) % 2 == 1, "audits": [{"audit": p, "before": n} for p, n in zip(parts, accumulate([0, *left]), strict=False)]}
                out.append(told | {n: getattr(x, n) for n in ("conv_id", "blank", "duplicate", "truncated", "illegal", "pieces")})
            yield pa.RecordBatch.from_pylist(out, types)

    return found.where("not edge").unionByName(_merged(found.where("edge"))).mapInArrow(finish, REPORT)


REPAIRED = "conv_id long, slice int, slices int, nth long, role string, text string, edit string"


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The turns that stay or are inserted, numbered from 0 in each conversation (REPAIRED); report is a staged one of the same rows.

    The rows of a (conversation, slice) lie in one partition, in order.  Users and assistants alternate
    in what is left, after a head if its number is odd, so a turn's number tells its role."""
    ready(rows.sparkSession)
    # At most two conversations for each task of the sort.
    bounds = report.where(F.size("pieces") > 1).select(F.col("conv_id").alias("cut_id"), F.transform("pieces", lambda p: F.struct(p["turn"].alias("turn"), p["role"].alias("role"), p["said"].alias("said"))).alias("bounds"))
    known = _known(rows).where("copies > 0").join(F.broadcast(bounds), F.col("conv_id").eqNullSafe(F.col("cut_id")), "left")
    number = F.size(F.filter("bounds", lambda b: b <= F.struct("turn", "role", "said"))) - 1
    number = F.when(F.col("bounds").isNull(), 0).otherwise(number)
    texts = known.select("conv_id", number.cast("int").alias("slice"), F.lit(1).alias("kind"), "turn", "role", "said", F.when(F.col("state") != BLANK, F.col("text")).alias("text"), "copies", F.lit(0).alias("slices"), F.lit(False).alias("headed"))
    marks = report.select("conv_id", F.size("audits").alias("slices"), "headed", F.posexplode("audits").alias("slice", "own"))
    none = lambda kind: F.lit(None).cast(kind)
    marks = marks.select("conv_id", "slice", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("said"), F.col("own.audit").alias("text"), F.col("own.before").alias("copies"), "slices", "headed")
    types = _types(REPAIRED)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, count, head, audit, at, nth = None, 0, 0, 0, "", 0, 0

        def told(role: str | None, text: str, edit: str) -> dict:
            nonlocal nth
            nth += 1
            return {"conv_id": conv, "slice": number, "slices": count, "nth": nth - 1, "role": role or ("user", "assistant")[(nth - 1 - head) % 2], "text": text, "edit": edit}

        def inserts() -> Iterator[dict]:
            nonlocal at
            while audit[at : at + 1] == "I":
                at += 1
                yield told(None, "", "I")

        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not row[2]:
                    out += inserts()  # the last of the slice before
                    conv, number, _, _, audit, nth, count, head = row
                    at = 0
                    continue
                for _ in range(row[5]):
                    out += inserts()
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        out.append(told(row[3] if edit == "K" else None, row[4], edit))
            yield pa.RecordBatch.from_pylist(out, types)
        yield pa.RecordBatch.from_pylist(list(inserts()), types)

    met = texts.unionByName(marks).repartition("conv_id", "slice").sortWithinPartitions("conv_id", "slice", "kind", "turn", "role", "said")
    return met.select("conv_id", "slice", "kind", "role", "text", "copies", "slices", "headed").mapInArrow(rewrite, REPAIRED)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired conversations that have turns: of role:text, joined by line ends.

    A conversation of one slice is hashed where it lies; of the others, chunks of bounded size go, in
    order, to one task for each conversation, as the hash asks."""

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, held, size, done = None, [], 0, []

        def chunk(last: bool) -> None:
            data = b"\n".join(held)
            conv, number, slices, nth, digest = whose
            if slices > 1:
                done.append({"conv_id": conv, "slice": number, "nth": nth, "data": data, "digest": None})
            else:
                digest.update((b"\n" if nth else b"") + data)
                if last:
                    done.append({"conv_id": conv, "slice": 0, "nth": 0, "data": None, "digest": digest.hexdigest()})
            whose[3] += 1
            held.clear()

        for batch in batches:
            for conv, number, slices, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if whose is None or whose[:2] != [conv, number]:
                    if whose is not None:
                        chunk(True)
                    whose, size = [conv, number, slices, 0, hashlib.sha256()], 0
                elif size >= CHUNK:
                    chunk(False)
                    size = 0
                held.append(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                size += len(held[-1])
            yield pa.RecordBatch.from_pylist(done, types)
            done.clear()
        if whose is not None:
            chunk(True)
        yield pa.RecordBatch.from_pylist(done, types)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, done = None, None, []
        for batch in batches:
            for own, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if digest is None or own != conv:
                    if digest is not None:
                        done.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest = own, hashlib.sha256(data)
                else:
                    digest.update(b"\n" + data)
        if digest is not None:
            done.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(done, ends)

    told, want = "conv_id long, slice int, nth long, data binary, digest string", "conv_id long, repaired_sha256 string"
    types, ends = _types(told), _types(want)
    found = stage(turns.select("conv_id", "slice", "slices", "role", "text").mapInArrow(here, told), "turn-digests")
    open_ = found.where("data is not null").repartition("conv_id").sortWithinPartitions("conv_id", "slice", "nth").select("conv_id", "data")
    return found.where("data is null").select("conv_id", F.col("digest").alias("repaired_sha256")).unionByName(open_.mapInArrow(across, want))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    report = stage(reports(rows), "turn-reports")
    found = digests(repaired(rows, report)).withColumnRenamed("conv_id", "own_id")
    both = report.join(found, F.col("conv_id").eqNullSafe(F.col("own_id")), "left")
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same repair as a recursion over turns, with one (cost and audit, text) for each state."""
    add = lambda e, cost, letter, out="''": f"CASE WHEN {e} IS NOT NULL THEN struct_pack(k := lpad(CAST(CAST(left({e}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({e}.k, 10) || '{letter}', o := {e}.o || {out}) END"
    line = lambda role: f"{role} || ':' || text || chr(10)"
    insert = lambda e, role: add(e, INSERT, "I", f"'{role}:' || chr(10)")
    drop = lambda e: add(e, DELETE, "D")
    keep = lambda e, first: f"CASE WHEN able AND initial = '{first}' THEN {add(e, 'more', 'K', line('role'))} END"
    rerole = lambda e, role: f"CASE WHEN able THEN {add(e, f'more + {REROLE}', 'R', line(repr(role)))} END"
    closed = lambda source: f"SELECT * REPLACE (least(e3, {insert('e2', 'assistant')}) AS e3) FROM (SELECT * REPLACE (least(e2, {insert('e0', 'user')}, {insert('e1', 'user')}, {insert('e3', 'user')}) AS e2) FROM {source})"
    to_user = ", ".join(f"{keep(e, 'u')}, {rerole(e, 'user')}" for e in ("e0", "e1", "e3"))
    return f"""
WITH RECURSIVE {CRC_TABLE_SQL},
told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')))")} % 20 AS kind
  FROM conversations, crc_table
),
bad AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM told
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare
  FROM bad
),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed
),
turns AS (SELECT conv_id, p, role, text, initial, coalesce(fault NOT IN ('blank', 'duplicate'), TRUE) AS able, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more FROM judged),
counts AS (
  SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, struct_pack(k := '000000000', o := '') AS e0, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)) AS e1, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)) AS e2, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)) AS e3 FROM conversations
  UNION ALL
  SELECT c.conv_id, t.p, {drop("e0")}, least({drop("e1")}, {keep("e0", "s")}), least({drop("e2")}, {to_user}), least({drop("e3")}, {keep("e2", "a")}, {rerole("e2", "assistant")})
  FROM ({closed("ways")}) c JOIN turns t ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND t.p = c.p + 1
),
ends AS (SELECT conv_id, p, least(e0, e3) AS best FROM ({closed("ways")}))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(left(best.k, 9) AS BIGINT) AS cost, substr(best.k, 10) AS audit, sha256(left(best.o, greatest(length(best.o) - 1, 0))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE e.p = coalesce(c.n, 0)
"""


ORACLE_SQL = _oracle()
