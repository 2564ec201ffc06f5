"""Conversation structure repair: the cheapest edits that make the roles alternate.

A conversation's rows are an input word, its legal shape an automaton with four
states (nothing yet, after the system row, after a user, after an assistant; see
``_NEXT``), and every edit an arc.  Forward and backward minimum costs over
(row, state) find the tight arcs, those on some cheapest path; they make an acyclic
graph.  A set of states, the frontier, walks it from the start and takes the least
letter that any tight arc out of the set has, so the audit is the least of all
cheapest edit strings.

Costs of neighbouring states differ by a bounded amount, so a step of either pass
is a function of few distinct values and is computed once for each.

Scale: only a code and a few numbers a row are sorted by conversation; a task holds
some 30 bytes a row of the conversation that it walks, less than twenty times the
audit, which the result has in one value anyway.  Texts are joined to the edits by a
key that no two rows share and stream through the digest in order; no task holds a
conversation's texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import map_texts, materialise

INSERT, DELETE, REROLE, BROKEN = 5, 2, 1, 5  # costs; BROKEN: a truncated row that stays
SPACE = " \t\n\x0b\x0c\r"
_ROLES = ("", "s", "u", "a")
#: The states after a row of role s, u, a; state 0: nothing yet, 1: after s, 2: after u, 3: after a.
_NEXT = ({1: 1, 2: 2}, {2: 2}, {3: 3}, {2: 2})
_ENDS = (0, 3)
_INSERTS = [(x, y) for x in range(4) for role, y in _NEXT[x].items() if role > 1]
_FAR = 1 << 60
CLEAN, GONE, TRUNCATED = 0, 1, 2
_EDITS = "conv_id {id}, rid long, place long, before string, act string, after string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"


@lru_cache(maxsize=None)
def _arcs(code: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, state, next state, cost) of the edits of one row, letters ascending; ``code`` is 3 * role + fault."""
    role, fault = divmod(code, 3)
    out = [("D", x, x, DELETE) for x in range(4)]
    if fault != GONE:
        extra = BROKEN if fault == TRUNCATED else 0
        out += [("K", x, nxt[role], extra) for x, nxt in enumerate(_NEXT) if role in nxt]
        out += [("R", x, y, REROLE + extra) for x, y in _INSERTS]
    return tuple(out)


def _level(v: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(v)
    return tuple(min(c - least, _FAR) for c in v), least


def _relax(v: list[int], arcs: list[tuple[int, int]]) -> list[int]:
    for _ in range(3):  # no cheapest path inserts more rows in turn
        for x, y in arcs:
            v[y] = min(v[y], v[x] + INSERT)
    return v


@lru_cache(maxsize=1 << 16)
def _forward(v: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    out = [_FAR] * 4
    for _, x, y, cost in _arcs(code):
        out[y] = min(out[y], v[x] + cost)
    return _level(_relax(out, _INSERTS))


@lru_cache(maxsize=1 << 16)
def _backward(v: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    out = [_FAR] * 4
    for _, x, y, cost in _arcs(code):
        out[x] = min(out[x], v[y] + cost)
    return _level(_relax(out, [(y, x) for x, y in _INSERTS]))


@lru_cache(maxsize=1 << 16)
def _step(states: frozenset[int], ahead: tuple[int, ...], here: tuple[int, ...], rest: tuple[int, ...], slack: int, code: int) -> tuple[str, frozenset[int], bool]:
    """The least letter of the tight arcs out of ``states``, the states behind them, and whether the row is done.

    An arc is tight if the cost to its state (``ahead``), its own and that of the rest
    (``here`` behind an insertion, ``rest`` behind the row, ``slack`` more) make the
    least total, which is zero here.
    """
    out: dict[str, set[int]] = {}
    for x, y in _INSERTS:
        if x in states and ahead[x] + INSERT + here[y] == 0:
            out.setdefault("I", set()).add(y)
    for letter, x, y, cost in _arcs(code):
        if x in states and ahead[x] + cost + rest[y] + slack == 0:
            out.setdefault(letter, set()).add(y)
    letter = min(out)
    return letter, frozenset(out[letter]), letter != "I"


def repair_codes(codes: bytes) -> tuple[int, list[str], str]:
    """The least cost; for each row its letter, with an ``I`` before it for each insertion there; and the insertions at the end."""
    ends = _relax([0 if x in _ENDS else _FAR for x in range(4)], [(y, x) for x, y in _INSERTS])
    behind = [_level(ends)]
    for code in reversed(codes):  # costs to the end, from each row on: relative values and what the row adds
        behind.append(_backward(behind[-1][0], code))
    behind.reverse()
    ahead, base = _level(_relax([0, _FAR, _FAR, _FAR], _INSERTS))
    total = sum(add for _, add in behind) + behind[0][0][0]
    left = total - behind[0][0][0]  # what ``behind`` leaves out of the costs from this row on
    states, out = frozenset({0}), []
    for p, code in enumerate(codes):
        row = ""
        here, add = behind[p]
        gap = base + left - total
        done = False
        while not done:
            letter, states, done = _step(states, tuple(min(a + gap, _FAR) for a in ahead), here, behind[p + 1][0], -add, code)
            row += letter
        out.append(row)
        left -= add
        ahead, more = _forward(ahead, code)
        base += more
    last, x = "", min(states)
    while x not in _ENDS:  # a row is owed
        x, last = max(_NEXT[x].values()), last + "I"
    return total, out, last


def _lines(letters: str, state: int, role: int) -> tuple[str, str, int]:
    """What a row's letters insert before it, what becomes of it, and the state behind it."""
    before = []
    for letter in letters[:-1]:
        state = max(_NEXT[state].values())
        before.append("user:" if state == 2 else "assistant:")
    if letters[-1] == "D":
        return "\n".join(before), "D", state
    if letters[-1] == "K":
        return "\n".join(before), "K", _NEXT[state][role]
    state = max(_NEXT[state].values())
    return "\n".join(before), "user" if state == 2 else "assistant", state


def _walk(id_type: pa.DataType):
    """Rows sorted by conversation and place -> an edit for each row, and a row with the conversation's figures (rid null)."""
    names = ["conv_id", "rid", "place", "before", "act", "after", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit"]
    kinds = [id_type, pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 6, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, faults, codes = None, array("q"), [0] * 4, bytearray()
        illegal, low, high, distinct = 0, None, None, 0
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
            out.clear()
            return made

        def close() -> Iterator[pa.RecordBatch]:
            cost, letters, last = repair_codes(bytes(codes))
            state = 0
            for k, row in enumerate(letters):
                before, act, state = _lines(row, state, codes[k] // 3)
                after = _lines(last + "D", state, 0)[0] if k == len(letters) - 1 else ""
                if before or after or act != "D":
                    out.append((now, held[k], k, before or None, act, after or None, *[None] * 7))
                if len(out) >= 5000:
                    yield batch_of()
            gaps = min(high - low + 1 - distinct, (1 << 63) - 1) if distinct else 0
            out.append((now, *[None] * 5, *faults[1:], illegal, gaps, cost, "".join(letters) + last))

        first = True
        for batch in batches:
            for conv, rid, turn, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rid", "turn", "role", "fault"))):
                if first or conv != now:
                    if not first:
                        yield from close()
                    now, first = conv, False
                    held, faults, codes = array("q"), [0] * 4, bytearray()
                    illegal, low, high, distinct = 0, None, None, 0
                if codes and (codes[-1] // 3, role) not in ((1, 2), (2, 3), (3, 2)):
                    illegal += 1
                faults[fault] += 1
                held.append(rid)
                codes.append(3 * role + (CLEAN, GONE, GONE, TRUNCATED)[fault])
                if turn is not None:  # turns ascend
                    low = turn if low is None else low
                    distinct += turn != high
                    high = turn
        if not first:
            yield from close()
        if out:
            yield batch_of()

    return run


def _digest(id_type: pa.DataType):
    """Lines sorted by conversation and place -> the digest of each conversation's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, ids, sums = None, None, [], []
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if sha is None or conv != now:
                    if sha is not None:
                        ids.append(now)
                        sums.append(sha.hexdigest())
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode())
        if sha is not None:
            ids.append(now)
            sums.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])

    return run


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32(``conv_id:turn``) % 20 deals out; nulls in role and text, and in the key, become one space.

    0 drops the row, 1 empties its text, 2 takes out its full stops, exclamation and
    question marks, 3 repeats it, 4 sets its role to user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    rows = rows.where("fate <> 0").withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("again", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "again")


def _fault(first: Column) -> Column:
    """1 blank, 2 duplicate, 3 truncated, 0 none; ``first``: the row is the first of its role and text."""
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    return F.when(seen == "", 1).when(~first, 2).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations' figures and their repaired lines.

    The first table has a row for each conv_id (null is one): blank, duplicate,
    truncated, illegal, gaps, cost and audit.  The second has conv_id, place and
    ``line``, ``role:text`` of the rows that stay and of inserted ones (a line may hold
    several, one below the other).

    Rows are taken by turn, nulls first; rows of one turn by role, then by the first 64
    characters and the digest of the text.  A null role or text is one space.  A role
    counts by its first character; one that is empty or begins otherwise than s, u or a
    must be changed or deleted.  Texts are the same if their MD5 and length are.  Other
    columns are not read; an empty table gives empty results.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "turns")
    name = F.concat(F.md5("text"), F.length("text").cast("string"))
    firsts = rows.groupBy("conv_id", "role", name.alias("name")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("rid").alias("rid")))["rid"].alias("rid"))
    firsts = firsts.select("rid", F.lit(True).alias("first"))
    short = rows.select("conv_id", "rid", "turn", "role", F.substring("text", 1, 64).alias("head"), name.alias("name"), _fault(F.lit(True)).alias("fault"))
    short = short.join(firsts.hint("merge"), "rid", "left").withColumn("fault", F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault")))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "head", "name", "rid"]
    role = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(_ROLES) if r for x in (r, k)]), F.substring("role", 1, 1))
    codes = short.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "rid", "turn", F.coalesce(role, F.lit(0)).alias("role"), "fault")
    kind = rows.schema["conv_id"].dataType
    arrow = _arrow_type(kind)
    edits = materialise(codes.mapInArrow(_walk(arrow), _EDITS.format(id=kind.simpleString())), "edits")
    figures = edits.where("rid IS NULL").select("conv_id", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit")
    kept = edits.where("rid IS NOT NULL").select("rid", "place", "before", "act", "after")
    stays = F.when(F.col("act") != "D", F.concat(F.when(F.col("act") == "K", F.col("role")).otherwise(F.col("act")), F.lit(":"), F.col("text")))
    lines = rows.join(kept.hint("merge"), "rid").select("conv_id", "place", F.concat_ws("\n", "before", stays, "after").alias("line"))
    return figures, lines


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair_report(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """The figures of ``damaged`` and the digest of its repaired lines, for every conv_id of ``conversations``.

    A conversation that lost all its rows has zeros, an empty audit and the digest of
    nothing.
    """
    figures, lines = repair_conversations(damaged)
    kind = damaged.schema["conv_id"].dataType
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    sums = map_texts(ordered, _digest(_arrow_type(kind)), f"conv_id {kind.simpleString()}, repaired_sha256 string")
    every = conversations.select("conv_id").distinct()
    known = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    out = every.join(figures, known(every, figures), "left").join(sums, known(every, sums), "left")
    zero = [F.coalesce(figures[c], F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(every["conv_id"], *zero, F.coalesce(figures["audit"], F.lit("")).alias("audit"), F.coalesce(sums["repaired_sha256"], empty).alias("repaired_sha256"))
