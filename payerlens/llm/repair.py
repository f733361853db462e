"""Conversation repair: cheapest edits that bring the roles to ``(s?(ua)+)?``, by weighted CYK parsing.

The target language has four states: 0 start, 1 after the system turn, 2 after a user
turn, 3 after an assistant turn; 0 and 3 end it. The grammar in Chomsky normal form
has a nonterminal X_pq for every pair of states, derived by one row (kept, given another
role, deleted) or an inserted turn, or by X_pr X_rq. A span's cell holds the least
(cost, audit) of each X_pq, where the audit is the edits' initials in order. As X_pq
splits at every place of a span alike, one cut a span gives the whole cell: spans are
combined bottom-up at doubled lengths, which also spreads one long conversation over
tasks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import map_arrow, ordered

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STATES = 4
#: Turns of the language: state before, role initial, state after.
MOVES = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
ROLES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
#: Rows whose cells one task parses, and spans that one step up combines, as powers of two.
SPAN, FAN = 8, 6
BLANKS = r"[\x20\x09-\x0D]"

Cell = tuple[int, str]
Cells = tuple[Cell | None, ...]  # by state before * STATES + state after


def _least(x: Cell | None, y: Cell | None) -> Cell | None:
    return min((c for c in (x, y) if c), default=None)


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two spans side by side. Of equal costs no audit begins another, so the least parts make the least whole."""
    out: list[Cell | None] = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            x = left[p * STATES + r]
            if x:
                for q in range(STATES):
                    y = right[r * STATES + q]
                    if y:
                        at, both = p * STATES + q, (x[0] + y[0], x[1] + y[1])
                        if not out[at] or both < out[at]:
                            out[at] = both
    return tuple(out)


def _single(p_q: dict[tuple[int, int], Cell]) -> Cells:
    return tuple(p_q.get(divmod(i, STATES)) for i in range(STATES * STATES))


def insertions() -> Cells:
    """Cells of a span without rows: the closure of inserting user and assistant turns."""
    one = _single({(p, p): (0, "") for p in range(STATES)} | {(p, q): (INSERT, "I") for p, r, q in MOVES if r in ROLES})
    for _ in range(STATES):
        one = combined(one, one)
    return one


@lru_cache(maxsize=None)
def row_cells(code: str) -> Cells:
    """Cells of one row with any insertions around it.

    The code is the role's initial (s, u, a, else o): lower case for a sound row, upper case
    for a truncated one, and 0 to 3 for one that has to go.
    """
    edits = {(p, p): (DELETE, "D") for p in range(STATES)}
    if not code.isdigit():
        more = TRUNCATED if code.isupper() else 0
        for p, role, q in MOVES:
            if role == code.lower():
                edits[p, q] = (more, "K")
            elif role in ROLES:
                edits[p, q] = _least(edits.get((p, q)), (REROLE + more, "R"))
    around = insertions()
    return combined(combined(around, _single(edits)), around)


@lru_cache(maxsize=100_000)
def span_cells(codes: str) -> Cells:
    """Cells of a run of rows, bottom-up by span length."""
    spans = [row_cells(c) for c in codes]
    while len(spans) > 1:
        spans = [combined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def _blank_where_null(c: str, df: DataFrame) -> Column:
    return F.coalesce(df[c].cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the planted damage, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties the text, 2 removes its ``[.!?]``, 3 repeats the row, 4 makes the
    role user. Nulls count as one blank; null conv_id and turn stay null columns.
    """
    df = conversations
    key = F.concat(_blank_where_null("conv_id", df), F.lit(":"), _blank_where_null("turn", df))
    fault = F.crc32(key.cast("binary")) % 20
    text, role = _blank_where_null("text", df), _blank_where_null("role", df)
    return df.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).when(fault != 0, F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """The rows in order with ``place`` (ascending over all) and ``fault``: blank, duplicate, truncated or null.

    Rows go by conversation and turn (nulls first), rows of one turn by role and text. A
    duplicate has the role and text of an earlier row of its conversation. Nulls in role
    and text count as one blank. The table is settled.
    """
    whole = rows.select("conv_id", "turn", _blank_where_null("role", rows).alias("role"), _blank_where_null("text", rows).alias("text"))
    last = F.substring(F.regexp_replace("text", f"{BLANKS}+$", ""), -1, 1)
    placed = settle(
        ordered(whole, "conv_id", "turn", "role", "text")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        .withColumn("cut", ~last.isin(".", "!", "?"))
        .withColumn("said", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    )
    # copies merge before the shuffle, and only what was said twice comes back
    twice = (
        placed.where(~F.col("blank"))
        .groupBy("conv_id", "said")
        .agg(F.min("place").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("conv_id").alias("own_id"), F.col("said").alias("own_said"), "first")
    )
    met = placed.join(twice, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("said") == F.col("own_said")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return met.select("conv_id", "turn", "role", "text", "place", fault.alias("fault"))


def _codes(df: DataFrame) -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    bad = F.col("fault").isin("blank", "duplicate")
    return F.when(bad, F.translate(kind, "suao", "0123")).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)


_CELLS = "costs array<bigint>, audits array<string>"


def _as_lists(cells: Cells) -> tuple[list, list]:
    return [c[0] if c else None for c in cells], [c[1] if c else None for c in cells]


def _as_cells(costs: list, audits: list) -> Cells:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits))


def plans(rows: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(conv_id, cost, audit, illegal) of each conversation of a settled ``marked`` table.

    Runs of at most 2**span rows are parsed; the spans of longer conversations are
    combined by 2**fan at a time up a tree. ``illegal`` counts neighbours whose role initials are
    not su, ua or au.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    keys = f"conv_id {id_type}, place bigint, first string, last string, illegal bigint"
    spans = (
        rows.select("conv_id", "place", _codes(rows).alias("code"))
        .groupBy("conv_id", F.shiftright("place", span).alias("node"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("run"))
        .select("conv_id", F.col("run")[0]["place"].alias("place"), F.array_join("run.code", "").alias("codes"))
    )

    def parsed(batches):
        for batch in batches:
            out = []
            for codes in batch.column(2).to_pylist():
                kinds = codes.lower().translate(str.maketrans("0123", "suao"))
                illegal = sum(kinds[i : i + 2] not in ("su", "ua", "au") for i in range(len(kinds) - 1))
                out.append((kinds[0], kinds[-1], illegal, *_as_lists(span_cells(codes))))
            if out:
                yield [batch.column(0), batch.column(1), *map(list, zip(*out))]

    cells = settle(map_arrow(spans, parsed, f"{keys}, {_CELLS}"))
    several = cells.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("own_id"))
    same = F.col("conv_id").eqNullSafe(F.col("own_id"))
    done, rest = cells.join(several, same, "left_anti"), cells.join(several, same, "left_semi")
    bits = rows.agg(F.max(F.col("place").bitwiseAND(F.lit((1 << 33) - 1))), F.max(F.shiftright("place", 33))).first()
    for shift in _levels(span, fan, *((b or 0).bit_length() for b in bits)):
        rest = _step_up(rest, shift, f"{keys}, {_CELLS}")

    ways = F.array(*(F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in ENDS))
    best = F.array_min(F.filter(ways, lambda c: c["cost"].isNotNull()))
    return done.union(rest).select("conv_id", best["cost"].alias("cost"), best["audit"].alias("audit"), "illegal")


def _levels(span: int, fan: int, row_bits: int, part_bits: int) -> list[int]:
    """Shifts of the places, up to one node a conversation: within partitions, then over them."""
    within = [s for s in range(span + fan, 33, fan) if s < row_bits + fan]
    return [*within, *range(33, 33 + part_bits + fan, fan)]


def _step_up(spans: DataFrame, shift: int, schema: str) -> DataFrame:
    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["node"]).to_pylist(), key=lambda r: r["place"])
        total, illegal = _as_cells(rows[0]["costs"], rows[0]["audits"]), rows[0]["illegal"]
        for before, r in zip(rows, rows[1:]):
            total = combined(total, _as_cells(r["costs"], r["audits"]))
            illegal += r["illegal"] + (before["last"] + r["first"] not in ("su", "ua", "au"))
        costs, audits = _as_lists(total)
        row = rows[0] | {"last": rows[-1]["last"], "illegal": illegal, "costs": costs, "audits": audits}
        return pa.Table.from_pylist([row], schema=table.drop_columns(["node"]).schema)

    node = spans.withColumn("node", F.shiftright("place", shift))
    return node.groupBy("conv_id", "node").applyInArrow(join, schema)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of each conversation after its audit's edits.

    Deleted rows are left out. A conversation's rows stay together in their order, as they
    stream through one task, which holds only the audit.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    told = edits.select("conv_id", F.lit(-1).cast("bigint").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = (
        rows.select("conv_id", "place", "role", "text")
        .union(told)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place")
    )

    def work(batches):
        audit, at, state, position, conv = "", 0, 0, 0, None

        def turn(role, text, edit):
            nonlocal state, position
            wanted = "a" if state == 2 else "u"
            if edit == "K":
                wanted = role[:1]
            else:
                role = ROLES[wanted]
            state = next(q for p, r, q in MOVES if (p, r) == (state, wanted))
            position += 1
            return conv, position - 1, edit, role, text

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                yield turn("", "", "I")

        for batch in batches:
            out = []
            for own, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if place < 0:
                    out.extend(inserted())
                    audit, at, state, position, conv = text, 0, 0, 0, own
                    continue
                out.extend(inserted())
                edit, at = audit[at], at + 1
                if edit != "D":
                    out.append(turn(role, text, edit))
            if out:
                yield list(map(list, zip(*out)))
        out = list(inserted())
        if out:
            yield list(map(list, zip(*out)))

    return map_arrow(stream, work, f"conv_id {id_type}, position bigint, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` lines of a ``repaired`` frame, read in its order as it streams by."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def work(batches):
        conv, sha = None, None
        for batch in batches:
            out = []
            for own, position, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if not position:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = own, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if out:
                yield list(map(list, zip(*out)))
        if sha:
            yield [[conv], [sha.hexdigest()]]

    return map_arrow(turns, work, f"conv_id {id_type}, sha256 string")


def report(conversations: DataFrame, rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of every conv_id of the table.

    ``rows`` and ``edits`` are its ``marked`` and ``plans`` tables. A null conv_id is a
    conversation of its own; one without rows has zeros, an empty audit and the digest of an
    empty text; an empty table gives no rows. Columns other than conv_id, turn, role and
    text are not looked at.
    """
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
    )
    found = conversations.select("conv_id").distinct()
    for part in (counts, edits, digests(repaired(rows, edits))):
        own = part.withColumnRenamed("conv_id", "own_id")
        found = found.join(own, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    return found.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"]).na.fill(
        hashlib.sha256().hexdigest(), ["sha256"]
    )


def repair(conversations: DataFrame, span: int = SPAN, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(marked rows, plans) of a table of conversations; both settled.

    Nulls in role and text count as one blank, null turns come first. ``repaired`` applies
    the plans, ``report`` sums them up.
    """
    rows = settle(marked(conversations))
    return rows, settle(plans(rows, span, fan))
