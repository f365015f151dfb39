"""Conversation structure repair by weighted CYK parsing.

A conversation should read (s?(ua)+)? by the initials of its roles.  The automaton of
that pattern has the states start, system, user, assistant; the repair grammar is its
Chomsky normal form: a nonterminal X(p, q) derives the stretches that lead from p to q,
with X(p, r) -> X(p, q) X(q, r) and one terminal rule per edit of a row (keep, rerole,
delete).  A cell of the span table holds, for one span and one nonterminal, the least
(cost, audit), the audit being the initials of the edits.  Insertions are closed over in
the cells of single rows.

Cells are combined bottom-up by span length: 1, 2, 4, ...  In this grammar every split of
a span gives the same cells, so one split is enough and a conversation costs as many
cells as it has rows.  Spans also combine across tasks: a long conversation is cut into
ranges of rows that different tasks parse, and only their cells meet.

Audits compare as a whole.  This is sound cell by cell: two audits of one span and equal
cost hold as many letters of rows, so neither begins with the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches
from gleaner.plans.sizing import materialise

# Costs of edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
# Which state a role initial leads to.
STEPS = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
ACCEPTED = (START, ASSISTANT)
# Only these two can be inserted or given to a row.
GIVEN = "ua"

# Words, as in the other operators, are separated by these.
_BLANK = r"^[\x20\x09-\x0D]*$"
_ENDED = r"[.!?][\x20\x09-\x0D]*$"

# A cell table: (from, to) -> (cost, audit).
Cells = dict[tuple[int, int], tuple[int, str]]


def _product(left: Cells, right: Cells) -> Cells:
    """X(p, r) -> X(p, q) X(q, r), the least of all q."""
    out: Cells = {}
    onward: dict[int, list] = {}
    for (q, r), cell in right.items():
        onward.setdefault(q, []).append((r, *cell))
    for (p, q), (cost, audit) in left.items():
        for r, more, rest in onward.get(q, ()):
            found = (cost + more, audit + rest)
            if (p, r) not in out or found < out[p, r]:
                out[p, r] = found
    return out


def _inserted() -> Cells:
    """Cells of the empty span: nothing, or the fewest insertions that lead from p to q."""
    out: Cells = {(p, p): (0, "") for p in STEPS}
    one = {(p, q): (INSERT, "I") for p, steps in STEPS.items() for initial, q in steps.items() if initial in GIVEN}
    for _ in STEPS:
        for key, found in _product(out, one).items():
            out[key] = min(found, out.get(key, found))
    return out


EMPTY = _inserted()


def _row(letter: str) -> Cells:
    """Cells of a row, insertions around it included.

    ``letter`` is the initial of its role, in upper case if the row is truncated, "-" if
    it has to go, "x" or "X" if no role of its own fits.
    """
    edits: Cells = {(p, p): (DELETE, "D") for p in STEPS}
    if letter != "-":
        extra = TRUNCATED if letter.isupper() else 0
        for p, steps in STEPS.items():
            for initial, q in steps.items():
                if initial == letter.lower():
                    edits[p, q] = (extra, "K")
                elif initial in GIVEN:
                    edits[p, q] = min(edits.get((p, q), (1 << 30, "")), (extra + REROLE, "R"))
    return _product(_product(EMPTY, edits), EMPTY)


ROWS = {letter: _row(letter) for letter in "sSuUaAxX-"}


class Spans:
    """Cell tables of a growing stretch of rows: spans of falling length, each a power of two or longer."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Cells]] = []

    def add(self, length: int, cells: Cells) -> None:
        self.stack.append((length, cells))
        while len(self.stack) > 1 and self.stack[-2][0] <= self.stack[-1][0]:
            self._merge()

    def _merge(self) -> None:
        (m, right), (n, left) = self.stack.pop(), self.stack.pop()
        self.stack.append((n + m, _product(left, right)))

    def cells(self) -> Cells:
        while len(self.stack) > 1:
            self._merge()
        return self.stack[0][1] if self.stack else EMPTY


def parse(letters: str) -> tuple[int, str]:
    """The least (cost, audit) of one conversation."""
    spans = Spans()
    for letter in letters:
        spans.add(1, ROWS[letter])
    return accepted(spans.cells())


def accepted(cells: Cells) -> tuple[int, str]:
    return min(cells[START, q] for q in ACCEPTED if (START, q) in cells)


# --- rows of a conversation ---------------------------------------------------


def classify(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, role, blank, truncated, n, first): the distinct rows.

    ``rows`` has conv_id, turn, role, text and copies, how often the row counts (0: not
    at all, but its conversation does).  ``n`` sums the copies of equal rows; ``first``
    tells whether no earlier turn of the conversation has the same role and text.  Equal
    rows are summed before anything else moves, text stays behind, and the earliest turn
    of a text is a grouped minimum, so no group is collected.
    """
    text = F.coalesce("text", F.lit(" "))
    role = F.coalesce("role", F.lit(" "))
    narrow = rows.select(
        "conv_id",
        "turn",
        digest(role, text).alias("digest"),
        F.substring(role, 1, 1).alias("initial"),
        text.rlike(_BLANK).alias("blank"),
        (~text.rlike(_ENDED)).alias("truncated"),
        "copies",
    )
    summed = narrow.groupBy("conv_id", "turn", "digest", "initial", "blank", "truncated").agg(F.sum("copies").alias("n"))
    there = F.when(F.col("n") > 0, F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    earliest = summed.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(there).alias("_earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    return summed.join(earliest, same).select(*summed.columns, F.col("turn").eqNullSafe(F.col("_earliest.turn")).alias("first"))


def digest(role: Column, text: Column) -> Column:
    """What stands for role and text: 128 bits, also the order of rows of one turn."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


# Columns of a stretch of rows of one conversation, and their Arrow types.
_COUNTS = ("rows", "turns", "blank", "duplicate", "truncated", "illegal")
_EDGES = ("first_turn", "last_turn", "first_initial", "last_initial")
_LEGAL = {"su", "ua", "au"}


class _Stretch:
    """What is known of consecutive rows of one conversation."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.spans = Spans()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.edges: list = [None, None, None, None]

    def add_row(self, turn: int | None, initial: str, blank: bool, truncated: bool, n: int, first: bool) -> None:
        for k in range(n):
            again = not first or k > 0
            gone = blank or again
            letter = "-" if gone else (initial if initial in "sua" and initial else "x")
            self.spans.add(1, ROWS[letter.upper() if truncated and not gone else letter])
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            own = dict.fromkeys(_COUNTS, 0) | {"rows": 1, "turns": 0 if turn is None else 1}
            if fault:
                own[fault] = 1
            self._append(own, [turn, turn, initial, initial])

    def add_stretch(self, counts: dict, edges: list, cells: Cells) -> None:
        if counts["rows"]:
            self.spans.add(counts["rows"], cells)
            self._append(counts, edges)

    def _append(self, counts: dict, edges: list) -> None:
        """Counts of two neighbouring stretches, seen over their border."""
        if self.counts["rows"]:
            self.counts["illegal"] += self.edges[3] + edges[2] not in _LEGAL
            self.counts["turns"] -= self.edges[1] is not None and self.edges[1] == edges[0]
        first_turn = self.edges[0] if self.edges[0] is not None else edges[0]
        last_turn = edges[1] if edges[1] is not None else self.edges[1]
        initial = self.edges[2] if self.counts["rows"] else edges[2]
        self.edges = [first_turn, last_turn, initial, edges[3]]
        for name, n in counts.items():
            self.counts[name] += n


_STRETCH = (
    "part int, cells array<struct<p:int,q:int,cost:long,audit:string>>,"
    + ",".join(f"n_{c} long" for c in _COUNTS)
    + ", first_turn long, last_turn long, first_initial string, last_initial string"
)
_CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
# Audits of a batch of finished stretches, in letters, before it is handed on.
_BATCH_LETTERS = 1 << 22


def _handed_on(done: list[_Stretch], part: int, key: pa.DataType) -> pa.RecordBatch:
    cells = [
        [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in s.spans.cells().items()] for s in done
    ]
    columns = [pa.array([s.conv for s in done], key), pa.array([part] * len(done), pa.int32()), pa.array(cells, _CELLS)]
    columns += [pa.array([s.counts[c] for s in done], pa.int64()) for c in _COUNTS]
    columns += [pa.array([s.edges[k] for s in done], pa.int64()) for k in (0, 1)]
    columns += [pa.array([s.edges[k] for s in done], pa.string()) for k in (2, 3)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "cells", *(f"n_{c}" for c in _COUNTS), *_EDGES])


def _folded(batches: Iterator[pa.RecordBatch], part: int, add) -> Iterator[pa.RecordBatch]:
    """One stretch per conversation of ordered rows; ``add`` puts a row into a stretch."""
    key, stretch, done, letters = pa.null(), None, [], 0
    for batch in batches:
        key = batch.schema.field("conv_id").type
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = dict(zip(names, values, strict=True))
            if stretch is None or row["conv_id"] != stretch.conv:
                if stretch is not None:
                    done.append(stretch)
                    letters += stretch.counts["rows"]
                    if letters > _BATCH_LETTERS or len(done) > 1000:
                        yield _handed_on(done, part, key)
                        done, letters = [], 0
                stretch = _Stretch(row["conv_id"])
            add(stretch, row)
    if stretch is not None:
        yield _handed_on([*done, stretch], part, key)


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    def add(s: _Stretch, r: dict) -> None:
        s.add_row(r["turn"], r["initial"], r["blank"], r["truncated"], r["n"], r["first"])

    return _folded(batches, TaskContext.get().partitionId(), add)


def _join_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def add(s: _Stretch, r: dict) -> None:
        cells = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r["cells"]}
        s.add_stretch({c: r[f"n_{c}"] for c in _COUNTS}, [r[e] for e in _EDGES], cells)

    return _folded(batches, 0, add)


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: counts of faults, gaps, cost and audit of the cheapest repair.

    ``rows`` as for ``classify``.  Rows are dealt by ranges of (conv_id, turn, digest), so
    tasks share a long conversation; then the few stretches of each conversation meet.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    key = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "digest"]
    kinds = classify(rows).withColumn("turn", F.col("turn").cast("long"))
    stretches = (
        materialise(kinds)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_parse_rows, f"conv_id {key}, {_STRETCH}")
    )
    joined = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_join_stretches, f"conv_id {key}, {_STRETCH}")
    ends = F.filter("cells", lambda c: (c["p"] == START) & c["q"].isin(*ACCEPTED))
    best = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    return joined.select(
        "conv_id",
        gaps.alias("gaps"),
        *[F.col(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        best["cost"].alias("cost"),
        best["audit"].alias("audit"),
    )


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place, edit, role, text, one row per kept or inserted message.

    ``found`` is the result of ``audits`` over the same rows.  Texts stream beside the
    audit of their conversation, in order; a task holds one batch and one audit.
    """
    return _beside_audits(rows, found, _edit)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: of the repaired ``role:text``, joined by line feeds."""
    return _beside_audits(rows, found, _digest)


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _beside_audits(rows: DataFrame, found: DataFrame, work) -> DataFrame:
    """``work`` over each conversation's audit, followed by its rows in order."""
    bounded_batches(rows.sparkSession)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    texts = rows.filter("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), digest(role, text).alias("digest"),
        F.col("copies").cast("long").alias("copies"), role.alias("role"), text.alias("text"),
        *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in _FACTS],
    )
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("digest"),
        F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *_FACTS,
    )
    ordered = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    key = rows.schema["conv_id"].dataType.simpleString()
    columns, function = work()
    return ordered.mapInArrow(function, f"conv_id {key}, {columns}")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, tuple[str, str, str] | None]]:
    """(head, None) for each conversation, then (None, (edit, role, text)) for its messages.

    The automaton tells the role of an inserted or reroled message, since an audit of
    the pattern can be read in one way only.
    """
    audit, at, state = "", 0, START
    after = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}

    def given() -> str:
        nonlocal state
        role, state = after[state]
        return role

    def insertions() -> Iterator[tuple[None, tuple[str, str, str]]]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield None, ("I", given(), "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                audit, at, state = row["audit"], 0, START
                yield row, None
                yield from insertions()
                continue
            for _ in range(row["copies"]):
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = STEPS[state][row["role"][:1]]
                    yield None, ("K", row["role"], row["text"])
                elif edit == "R":
                    yield None, ("R", given(), row["text"])
                yield from insertions()


def _typed(batches: Iterator[pa.RecordBatch], kinds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The batches; ``kinds`` gets the type of their conv_id in front."""
    for batch in batches:
        if kinds[0][0] != "conv_id":
            kinds.insert(0, ("conv_id", batch.schema.field("conv_id").type))
        yield batch


def _edit():
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[tuple] = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        kept: dict[str, list] = {c: [] for c in ("conv_id", "place", "edit", "role", "text")}
        conv, place, letters = None, 0, 0
        for head, message in _messages(_typed(batches, kinds)):
            if head:
                conv, place = head["conv_id"], 0
                continue
            for column, value in zip(kept, (conv, place, *message), strict=True):
                kept[column].append(value)
            place, letters = place + 1, letters + len(message[2])
            if letters > _BATCH_LETTERS or len(kept["text"]) > 10_000:
                yield pa.RecordBatch.from_pydict(kept, pa.schema(kinds))
                kept, letters = {c: [] for c in kept}, 0
        if kept["text"]:
            yield pa.RecordBatch.from_pydict(kept, pa.schema(kinds))

    return "place long, edit string, role string, text string", stream


def _digest():
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[tuple] = [(c, pa.string() if c == "audit" else pa.int64()) for c in _FACTS] + [("repaired_sha256", pa.string())]
        done: list[dict] = []
        head, running, empty = None, hashlib.sha256(), True
        names = ("conv_id", *_FACTS)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, pa.schema(kinds))

        for found, message in _messages(_typed(batches, kinds)):
            if found:
                if head:
                    done.append({c: head[c] for c in names} | {"repaired_sha256": running.hexdigest()})
                    if len(done) >= 1000:
                        yield rows()
                        done.clear()
                head, running, empty = found, hashlib.sha256(), True
                continue
            _, role, text = message
            running.update((role + ":" + text if empty else "\n" + role + ":" + text).encode())
            empty = False
        if head:
            done.append({c: head[c] for c in names} | {"repaired_sha256": running.hexdigest()})
            yield rows()

    return REPORT, stream


def repair_report(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text, one row per conversation.

    ``rows``: conv_id, turn, role, text and optionally copies (how often a row counts,
    one by default; 0 keeps its conversation in the result); other columns are left out.
    Rows of a conversation are taken by turn, nulls first, rows of one turn by the hash
    of role and text, equal rows side by side.  A null role or text is one space.  The
    null conv_id is one conversation.  A role whose initial is not s, u or a, an empty
    role included, fits nowhere: such a row is reroled or deleted.  Conversations
    without rows have zeros, an empty audit and the hash of no text; no rows give none.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    rows = rows.select("conv_id", "turn", "role", "text", F.col("copies").cast("long").alias("copies"))
    return report(rows, materialise(audits(rows)))
