"""Repair of the structure of conversations (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks

#: Costs of the edits, and of a truncated turn that stays.
RENAME, DELETE, INSERT, STAY_TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
#: What a legal sequence of roles, `(s?(ua)+)?`, has reached: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the state that the next user or assistant turn leads to, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Bits of a turn's code: the role's initial (0 another, 1 s, 2 u, 3 a), then its fault.
BLANK, REPEATED, TRUNCATED, GONE = 4, 8, 16, 32
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _after(state: int, initial: int) -> int | None:
    """The state behind a kept turn; None if it may not stand there."""
    if initial == 1:
        return SYSTEM if state == START else None
    return NEXT[state] if initial and initial == NEXT[state] else None


KEPT = [[_after(s, i) for i in range(4)] for s in range(4)]


def _inserted(v: list[int]) -> list[int]:
    """Costs to go of the four states, with insertions before the next turn: two lead round the cycle, so three steps settle it."""
    v = v[:]
    for _ in range(3):
        v = [min(v[s], INSERT + v[NEXT[s]]) for s in range(4)]
    return v


def _back(code: int, behind: list[int]) -> list[int]:
    """Costs to go of the four states before a turn, from those behind it."""
    out = []
    for s in range(4):
        least = DELETE + behind[s]
        if not code & (BLANK | REPEATED):
            stay = STAY_TRUNCATED if code & TRUNCATED else 0
            least = min(least, stay + RENAME + behind[NEXT[s]])
            if (to := KEPT[s][code & 3]) is not None:
                least = min(least, stay + behind[to])
        out.append(least)
    return _inserted(out)


def tight_edits(codes: bytes) -> tuple[int, str]:
    """(cost, edits) of one conversation's turns: the cheapest edits' initials, of several the ASCII-least.

    Cost-to-go vectors are kept at every sqrt(n)-th turn only. Walking forward, a block's vectors are computed again
    from the checkpoint behind it, and each step takes the ASCII-least edit that loses nothing. An edit's initial and
    the state decide the next state, so the least step is part of the least sequence.
    """
    n = len(codes)
    step = max(1, isqrt(n))
    last = _inserted([0, FAR, FAR, 0])
    marks, v = {n: last}, last
    for i in range(n - 1, -1, -1):
        v = _back(codes[i], v)
        if i % step == 0:
            marks[i] = v
    cost, state, edits = v[START], START, []
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        block = [marks[hi]]
        for i in range(hi - 1, lo - 1, -1):
            block.append(_back(codes[i], block[-1]))
        block.reverse()
        for i in range(lo, hi):
            here, behind, code = block[i - lo], block[i - lo + 1], codes[i]
            while True:
                left = here[state]
                if DELETE + behind[state] == left:
                    edits.append("D")
                elif INSERT + here[NEXT[state]] == left:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                else:  # without an insertion before it, the turn stays
                    to = KEPT[state][code & 3]
                    if to is not None and behind[to] + (STAY_TRUNCATED if code & TRUNCATED else 0) == left:
                        edits.append("K")
                        state = to
                    else:
                        edits.append("R")
                        state = NEXT[state]
                break
    while last[state]:
        edits.append("I")
        state = NEXT[state]
    return cost, "".join(edits)


class _Turns:
    """What is kept of a conversation while its short rows pass: 17 bytes a turn, and the times' range."""

    def __init__(self) -> None:
        self.codes, self.digests = bytearray(), bytearray()
        self.least = self.most = self.before = None
        self.distinct = 0

    def add(self, turn: int | None, code: int, digest: bytes, times: int) -> None:
        if code & GONE:
            return
        self.codes += bytes([code]) * times
        self.digests += digest * times
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.distinct += turn != self.before
            self.most = self.before = turn

    def close(self) -> tuple:
        """The report. The first fault of a turn counts: no text, the role and text of an earlier turn, no end."""
        codes = np.frombuffer(self.codes, np.uint8).copy()
        if not len(codes):
            return 0, 0, 0, 0, 0, 0, ""
        pairs = np.frombuffer(self.digests, np.dtype([("a", "<u8"), ("b", "<u8")]))
        first = np.zeros(len(codes), bool)
        first[np.unique(pairs, return_index=True)[1]] = True
        blank = codes & BLANK > 0
        repeated = ~first & ~blank
        truncated = (codes & TRUNCATED > 0) & ~blank & ~repeated
        initial = codes & 3
        legal = [1 << 2 | 2, 2 << 2 | 3, 3 << 2 | 2]
        cost, audit = tight_edits((initial | blank * BLANK | repeated * REPEATED | truncated * TRUNCATED).astype(np.uint8).tobytes())
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return gaps, int(blank.sum()), int(repeated.sum()), int(truncated.sum()), int((~np.isin(initial[:-1] << 2 | initial[1:], legal)).sum()), cost, audit


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text, report): for each conversation its report at place 0, then its repaired turns.

    A conversation's turns stand in the order of `turn` (long; null first), of equal ones by role and digest. `times`
    (1 if not given) repeats a turn next to itself; 0 leaves it out, but its conversation still has a report. Faults:
    blank (nothing but white space), duplicate (role and text of an earlier turn), truncated (the last other character
    is no `.`, `!` or `?`); a turn has the first one that applies. Roles must read `(s?(ua)+)?` by their initials. Edits
    and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate turns must go), Insert an empty
    user or assistant turn 5; a truncated turn that stays costs 5 more. Of the cheapest sequences of edits the one whose
    initials are ASCII-least is taken. report.gaps counts the turn numbers missing between the least and the greatest.

    Null roles and texts count as one space. Null ids are one conversation. A conversation without turns has a report of
    zeros and no edits; an empty table gives no rows. Other columns are left out.

    One exchange: each turn is sent twice, as a short row (digest and code) and as a whole one, and short rows come
    first in the order of a conversation. So a task knows the edits when the texts pass, and holds 17 bytes a turn of one
    conversation and none of its texts. A conversation is one task, as its edits are one string. Rows of a
    conversation leave in order, for digests() and the like behind it.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    initial = F.substring("role", 1, 1)
    tail = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(tail == "", BLANK).when(~tail.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text"), 256)), 1, 16)
    one = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), (F.lit(1) if times is None else times).cast("int").alias("times"))
    one = one.withColumn("digest", digest).withColumn("code", F.when(F.col("times") > 0, code).otherwise(GONE).cast("int"))
    whole = F.when(F.col("times") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = one.withColumn("whole", F.explode(whole)).withColumn("text", F.when(F.col("whole"), F.col("text")))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "whole", F.asc_nulls_first("turn"), "role", "digest")
    kind = turns.schema[conv_id].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(f"place long, edit string, role string, text string, report struct<{REPORT}>").fields])
    return dealt.select("conv_id", "whole", "turn", "role", "text", "times", "digest", "code").mapInArrow(_repaired, schema)


#: Bytes of text after which rows are handed on.
OUT_BYTES = 1 << 21


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REPORT.split(", ")]
    report_type = pa.struct([(n, pa.string() if n == "audit" else pa.int64()) for n in names])
    out, size, kind = [], 0, pa.null()

    def flush() -> pa.RecordBatch:
        columns = [*zip(*out)]
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), report_type)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "place", "edit", "role", "text", "report"])

    key, turns, audit, at, place, state = object(), None, None, 0, 0, START

    def begin() -> None:
        """The report, once all short rows of a conversation have passed."""
        nonlocal audit, at, place, state
        report = turns.close()
        audit, at, place, state = report[-1], 0, 0, START
        out.append((key, 0, None, None, None, dict(zip(names, report, strict=True))))

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place
        place += 1
        out.append((key, place, edit, role, text, None))

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            put("I", ROLE[state], "")
            state, at = NEXT[state], at + 1

    def end() -> None:
        if audit is None:
            begin()
        insert()

    for batch in batches:
        kind = batch.schema.field(0).type
        for part, _, _ in text_chunks(batch, "text"):
            for conv, whole, turn, role, text, times, digest, code in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if turns is None or conv != key:
                    if turns is not None:
                        end()
                    key, turns, audit = conv, _Turns(), None
                if not whole:
                    turns.add(turn, code, digest, times)
                    continue
                if audit is None:
                    begin()
                for _ in range(times):
                    insert()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = KEPT[state][code & 3]
                        put("K", role, text)
                    elif edit == "R":
                        put("R", ROLE[state], text)
                        state = NEXT[state]
                    size += len(text)
                if size >= OUT_BYTES or len(out) >= 4096:
                    if out:
                        yield flush()
                    size = 0
    if turns is not None:
        end()
    if out:
        yield flush()


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, the report's fields, repaired_sha256) of what repair() gives, straight behind it: SHA-256 of the repaired
    `role:text`, joined by line feeds. Rows pass once; nothing of a conversation is kept but its report."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    schema = T.StructType([repaired.schema["conv_id"], *T.StructType.fromDDL(f"{REPORT}, repaired_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, n = None, hashlib.sha256(), 0
        for batch in batches:
            rows, kind = [], batch.schema.field("conv_id").type
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "place", "role", "text", "report")]
            for conv, place, role, text, report in zip(*columns, strict=True):
                if place == 0:
                    if head is not None:
                        rows.append((*head, sha.hexdigest()))
                    head, sha, n = (conv, *[report[c] for c in names]), hashlib.sha256(), 0
                    continue
                sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
            if rows:
                yield table(rows, kind)
        if head is not None:
            yield table([(*head, sha.hexdigest())], kind)

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.string() if c == "audit" else pa.int64() for c in names], pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], ["conv_id", *names, "repaired_sha256"])

    return repaired.mapInArrow(run, schema)


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns (conv_id, turn, role, text, times) with planted faults, by crc32 of `conv_id:turn` (nulls: one space) modulo 20:
    0 drops the turn (times 0), 1 empties its text, 2 takes its `.`, `!` and `?` away, 3 repeats it (times 2), 4 makes it
    a user's. Null roles and texts become one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20
    texts = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    return turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(fate == 4, "user").otherwise(said(role)).alias("role"), texts.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("times"))
