"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, the least audit among them, and the repaired turns.

``turns.least_paths`` does the work on sequences. This module brings each conversation's turns to a task in order. Conversations of
up to ``LONG_TURNS`` turns and ``LONG_BYTES`` bytes are dealt by conv_id, and each is solved whole. A longer one is never gathered:
its turns are sorted over many tasks, which cut them into spans; every span states its least costs between states (a 4 x 4
min-plus product), a chain over these few numbers gives the costs to go at its end, the spans then state where their least paths
lead, and the chain names the state in which each begins. Each span's edits are found by itself. All of it equals the whole solution.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import turns
from corpusmill.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
LONG_TURNS = 65_536
LONG_BYTES = 1 << 26
#: A task solves about so many turns or bytes of turns at once.
BATCH_TURNS = 16_384
BATCH_BYTES = 1 << 24
LONG = 1 << 63

#: One row per conversation, but several pieces (in order) of a long one. Counts add up over pieces.
COUNTS = "blank long, duplicate long, truncated long, illegal long, cost long"


def damaged(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: conv_id, turn, role, text, copies.

    0: dropped (copies 0), 1: text emptied, 2: sentence ends removed, 3: repeated (copies 2), 4: role user. A null counts as one
    space in the key, the role and the text; null turns and conv_ids stay null. Other columns are not read.
    """
    space = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col(conv_id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))), F.lit(20))
    marked = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), kind.alias("_kind")
    )
    fault = F.col("_kind")
    return marked.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _with_faults(rows: DataFrame) -> DataFrame:
    """Adds the class of the role's initial and the turn's own fault: blank (2), truncated (1) or none (0)."""
    initial = F.substring("role", 1, 1)
    cls: Column = F.lit(turns.OTHER)
    for letter, number in turns.CLASSES.items():
        cls = F.when(initial == letter, F.lit(number)).otherwise(cls)
    written = F.rtrim(F.col("text"), F.lit(BLANKS))
    ends = F.right(written, F.lit(1)).isin(*ENDINGS)
    fault = F.when(written == "", turns.DELETED).when(ends, turns.FINE).otherwise(turns.TRUNCATED)
    return rows.withColumns({"cls": cls.cast("int"), "fault": fault.cast("int")})


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Places where a value differs from the one before it; nulls equal each other."""
    values = column.combine_chunks()
    before, after = values.slice(0, len(values) - 1), values.slice(1)
    equal = pc.or_(pc.fill_null(pc.equal(before, after), False), pc.and_(pc.is_null(before), pc.is_null(after)))
    return np.concatenate([[0], np.flatnonzero(~equal.to_numpy(zero_copy_only=False)) + 1]) if len(values) else np.array([], dtype="int64")


def _whole_runs(batches):
    """Tables of whole conversations, about ``BATCH_TURNS`` rows or ``BATCH_BYTES`` each. Rows come ordered by conv_id."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < BATCH_TURNS and held.nbytes < BATCH_BYTES:
            continue
        starts = _starts(held.column("conv_id"))
        if len(starts) > 1:
            yield held.slice(0, int(starts[-1]))
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held


def _repeats(first: np.ndarray, roles: list[str], texts: list[str]) -> np.ndarray:
    """Turns whose role and text came earlier in their run. ``first``: whether a turn begins a run."""
    found = np.zeros(len(roles), dtype=bool)
    seen: set = set()
    for i, (begins, role, text) in enumerate(zip(first.tolist(), roles, texts)):
        if begins:
            seen = set()
        key = (role, text)
        if key in seen:
            found[i] = True
        else:
            seen.add(key)
    return found


def _legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether two classes of initials may follow each other: su, ua, au."""
    s, u, a = (turns.CLASSES[c] for c in "sua")
    return ((before == s) & (after == u)) | ((before == u) & (after == a)) | ((before == a) & (after == u))


def _gaps(turn: list[int | None]) -> int | None:
    known = {t for t in turn if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps if gaps < LONG else None


def _written(paths: turns.Paths, runs: int, roles: list[str], texts: list[str], more: list[int] | None = None) -> tuple[list[str], list[list[str]]]:
    """Audits and repaired turns of each run. ``more``: deleted copies that follow a turn."""
    audits: list[list[str]] = [[] for _ in range(runs)]
    lines: list[list[str]] = [[] for _ in range(runs)]
    new = turns.roles_of(paths, roles)
    for code, run, turn, role in zip(paths.letter.tolist(), paths.run.tolist(), paths.turn.tolist(), new):
        letter = turns.LETTERS[code]
        audits[run].append(letter)
        if role is not None:
            lines[run].append(f"{role}:" + ("" if letter == "I" else texts[turn]))
        if more and letter != "I" and more[turn]:
            audits[run].append("D" * more[turn])
    return ["".join(a) for a in audits], lines


def _solve_whole(batches):
    """One row per conversation from rows ordered by (conv_id, turn, role, text)."""
    for table in _whole_runs(batches):
        starts = _starts(table.column("conv_id"))
        runs = len(starts)
        sizes = np.diff(np.append(starts, table.num_rows))
        ids = table.column("conv_id").combine_chunks().take(pa.array(starts))
        copies = table.column("copies").to_numpy()
        rows = np.repeat(np.arange(table.num_rows), copies)
        run_of = np.repeat(np.arange(runs), sizes)[rows]
        lengths = np.bincount(run_of, minlength=runs)
        taken = table.take(pa.array(rows))
        roles, texts, turn = (taken.column(c).to_pylist() for c in ("role", "text", "turn"))
        cls, own = (taken.column(c).to_numpy().astype("int64") for c in ("cls", "fault"))
        first = np.concatenate([[True], run_of[1:] != run_of[:-1]])[: len(rows)]
        repeated = _repeats(first, roles, texts)
        blank = own == turns.DELETED
        repeated &= ~blank
        truncated = (own == turns.TRUNCATED) & ~repeated
        fault = np.where(repeated, turns.DELETED, own)
        paths = turns.least_paths(cls, fault, lengths)
        audits, lines = _written(paths, runs, roles, texts)
        within = ~first[1:] if len(rows) else np.array([], dtype=bool)
        illegal = within & ~_legal(cls[:-1], cls[1:])

        def counted(flags: np.ndarray, at: np.ndarray = run_of) -> pa.Array:
            return pa.array(np.bincount(at[flags], minlength=runs).astype("int64"))

        ends = np.cumsum(lengths)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(np.zeros(runs, dtype="int64")),
                pa.array([_gaps(turn[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                counted(blank),
                counted(repeated),
                counted(truncated),
                counted(illegal, run_of[1:]),
                pa.array(paths.cost, pa.int64()),
                pa.array(audits, pa.string()),
                pa.array(["\n".join(x) for x in lines], pa.string()),
                pa.array(list(map(bool, lines)), pa.bool_()),
            ],
            ["conv_id", "piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "written"],
        )


def _schema(kind: str) -> str:
    return f"conv_id {kind}, piece long, gaps long, {COUNTS}, audit string, repaired string, written boolean"


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def _spans(batches):
    """(number, table) of spans: rows of one long conversation in one task, cut by the same rule in every pass."""
    held: pa.Table | None = None
    number = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows:
            starts = _starts(held.column("conv_id"))
            run = int(starts[1]) if len(starts) > 1 else held.num_rows
            size = np.cumsum(held.column("bytes").to_numpy()[:run])
            end = min(BATCH_TURNS, int(np.searchsorted(size, BATCH_BYTES)) + 1)
            if end >= run and len(starts) == 1 and run < BATCH_TURNS:
                break  # more of it may come
            end = min(end, run)
            yield number, held.slice(0, end)
            number += 1
            held = held.slice(end)
    while held is not None and held.num_rows:
        size = np.cumsum(held.column("bytes").to_numpy())
        end = min(BATCH_TURNS, int(np.searchsorted(size, BATCH_BYTES)) + 1, held.num_rows)
        yield number, held.slice(0, end)
        number += 1
        held = held.slice(end)


def _span_kinds(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls, own = (table.column(c).to_numpy().astype("int64") for c in ("cls", "fault"))
    first = table.column("is_first").to_numpy(zero_copy_only=False).astype(bool)
    return cls, np.where(first, own, turns.DELETED), first


def _solve_long(rows: DataFrame, kind: str) -> DataFrame:
    """Pieces of the long conversations. Equal turns are merged, first ones marked, and all sorted over the tasks.

    The driver gets 16 numbers per span, a span being about 16,000 turns of a conversation that has more than ``LONG_TURNS``.
    """
    rows = rows.where("copies > 0").withColumn("digest", F.sha2(F.concat_ws("\x00", F.octet_length("role").cast("string"), "role", "text"), 256))
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("least"))  # null turns come first
    marks = first.select("conv_id", F.col("least.turn").alias("turn"), "digest", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("is_first"))
    marked = rows.select("conv_id", "turn", "digest", "copies", F.lit(False).alias("is_first"), "role", "text")
    merged = marked.unionByName(marks, allowMissingColumns=True).groupBy("conv_id", "turn", "digest")
    merged = merged.agg(F.sum("copies").alias("copies"), F.max("is_first").alias("is_first"), F.max("role").alias("role"), F.max("text").alias("text"))
    merged = _with_faults(merged.drop("digest").withColumn("bytes", F.octet_length("text").cast("long")))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    placed = cut_lineage(merged.orderBy(*order).withColumn("part", F.spark_partition_id()))
    gaps = rows.groupBy("conv_id").agg(F.max("turn").cast("decimal(38,0)").alias("high"), F.min("turn").cast("decimal(38,0)").alias("low"), F.count_distinct("turn").alias("n"))
    gaps = gaps.select("conv_id", F.expr("try_cast(coalesce(high - low + 1 - n, 0) AS bigint)").alias("gaps"))

    def measured(batches):
        for number, table in _spans(batches):
            cls, fault, _ = _span_kinds(table)
            part = table.column("part")[0].as_py()
            ids = table.column("conv_id").combine_chunks().slice(0, 1)
            numbers = [turns.span_costs(cls, fault), [int(cls[0]), int(cls[-1])]]
            yield pa.RecordBatch.from_arrays([ids, pa.array([part], pa.int32()), pa.array([number]), *[pa.array([x], pa.list_(pa.int64())) for x in numbers]], ["conv_id", "part", "span", "costs", "classes"])

    light = placed.select("conv_id", "cls", "fault", "is_first", "bytes", "part")
    found = light.mapInArrow(measured, f"conv_id {kind}, part int, span long, costs array<long>, classes array<long>").collect()
    spans = sorted(found, key=lambda r: (r["part"], r["span"]))
    ends: dict[tuple, tuple | None] = {}
    later, later_id = None, object()
    for r in reversed(spans):
        ends[r["part"], r["span"]] = None if later is None or r["conv_id"] != later_id else later
        end = turns.END if ends[r["part"], r["span"]] is None else later
        table = np.array(r["costs"]).reshape(4, 4)
        later = tuple(int(x) for x in (table + np.array(end)).min(axis=1))
        # Turns may also be inserted before a span's first one; span costs count that, the end of a span does not.
        later_id = r["conv_id"]

    def led(batches):
        for number, table in _spans(batches):
            cls, fault, _ = _span_kinds(table)
            part = table.column("part")[0].as_py()
            four = [turns.least_paths(cls, fault, np.array([len(cls)]), [ends[part, number]], np.array([state])).exits[0] for state in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number]), pa.array([[int(x) for x in four]], pa.list_(pa.int64()))], ["part", "span", "exits"])

    exits = {(r["part"], r["span"]): r["exits"] for r in light.mapInArrow(led, "part int, span long, exits array<long>").collect()}
    entries: dict[tuple, tuple[int, int]] = {}  # state before the span, and 1 if the border to the span before is illegal
    state, before = turns.START, None
    for r in spans:
        key = (r["part"], r["span"])
        same = before is not None and before["conv_id"] == r["conv_id"]
        state = state if same else turns.START
        border = same and not bool(_legal(np.array([before["classes"][1]]), np.array([r["classes"][0]]))[0])
        entries[key] = (state, int(border))
        state, before = exits[key][state], r

    def solved(batches):
        for number, table in _spans(batches):
            cls, fault, first = _span_kinds(table)
            own = table.column("fault").to_numpy()
            part = table.column("part")[0].as_py()
            state, border = entries[part, number]
            paths = turns.least_paths(cls, fault, np.array([len(cls)]), [ends[part, number]], np.array([state]))
            roles, texts = (table.column(c).to_pylist() for c in ("role", "text"))
            more = table.column("copies").to_numpy() - 1
            audits, lines = _written(paths, 1, roles, texts, more.tolist())
            blank = own == turns.DELETED
            count = more + 1
            n_truncated = int(((own == turns.TRUNCATED) & first).sum())
            illegal = int((~_legal(cls[:-1], cls[1:])).sum()) + int(more.sum()) + border
            edits = sum(turns.DELETE if c == "D" else turns.REROLE if c == "R" else turns.INSERT if c == "I" else 0 for c in audits[0])
            undeleted = paths.turn[(paths.letter == turns.LETTERS.index("K")) | (paths.letter == turns.LETTERS.index("R"))]
            cost = edits + turns.CUT * int((fault[undeleted] == turns.TRUNCATED).sum())
            values = (int(count[blank].sum()), int(count[~blank].sum() - (first & ~blank).sum()), n_truncated, illegal, cost)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("conv_id").combine_chunks().slice(0, 1),
                    pa.array([(part << 32) + number], pa.int64()),
                    pa.array([0], pa.int64()),
                    *[pa.array([v], pa.int64()) for v in values],
                    pa.array(audits, pa.string()),
                    pa.array(["\n".join(lines[0])], pa.string()),
                    pa.array([bool(lines[0])], pa.bool_()),
                ],
                ["conv_id", "piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "written"],
            )

    pieces = placed.mapInArrow(solved, _schema(kind)).drop("gaps")
    gaps = gaps.withColumnRenamed("conv_id", "_conv")
    return pieces.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def repair(rows: DataFrame, *, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations from rows of (conv_id, turn, role, text, copies); ``copies`` says how often a row stands there.

    Two tables of conv_id, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, written: whole conversations
    (one row each), and pieces of long ones in order (counts and cost add up, audits and texts are joined, ``written`` tells a piece
    without any turn left). Rows are taken by turn (nulls first), then role and text, so ties and repeated rows have one result. A null conv_id is a conversation
    of its own. Roles with another initial than s, u or a (also empty ones) are legal nowhere. A conversation without rows has an
    empty audit and an empty text. An empty table gives an empty result. Texts of any length are taken whole.
    """
    kind = dict(rows.select("conv_id").dtypes)["conv_id"]
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("bytes"))
    long_ids = cut_lineage(sizes.where((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("_conv")))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    some = not long_ids.isEmpty()
    short = rows.join(long_ids, same, "left_anti") if some else rows
    whole = _ordered(_with_faults(short).repartition("conv_id")).mapInArrow(_solve_whole, _schema(kind))
    if not some:
        return whole, whole.sparkSession.createDataFrame([], whole.schema)
    pieces = _solve_long(rows.join(long_ids, same, "left_semi"), kind)
    return whole, pieces.select(*whole.columns)


def _joined(batches):
    """Pieces of long conversations, in order, as one row each. Repaired text is hashed as it comes and not held."""
    now: dict | None = None

    def closed(row: dict) -> pa.RecordBatch:
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        values = [row["id"], *[pa.array([row[c]], pa.int64()) for c in names], pa.array(["".join(row["audit"])]), pa.array([row["hash"].hexdigest()])]
        return pa.RecordBatch.from_arrays(values, ["conv_id", *names, "audit", "repaired_sha256"])

    for batch in batches:
        for i, piece in enumerate(batch.drop_columns(["conv_id"]).to_pylist()):
            key = batch.column("conv_id")[i].as_py()
            if now is None or now["key"] != key:
                if now is not None:
                    yield closed(now)
                now = {"key": key, "id": batch.column("conv_id").slice(i, 1), "gaps": piece["gaps"], "audit": [], "hash": hashlib.sha256(), "begun": False}
                now.update(dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "cost"], 0))
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                now[c] += piece[c]
            now["audit"].append(piece["audit"])
            if piece["written"]:
                now["hash"].update((("\n" if now["begun"] else "") + piece["repaired"]).encode())
                now["begun"] = True
    if now is not None:
        yield closed(now)


def summaries(whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A long conversation's hash is taken over its pieces in order, by one task that holds no more than a piece and the audit.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    done = whole.select(*names, F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
    ordered = pieces.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "piece")
    return done.unionByName(ordered.mapInArrow(_joined, done.schema))
