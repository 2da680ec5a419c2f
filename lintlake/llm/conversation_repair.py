"""Operator 12, conversation structure repair: the cheapest edits, by secondary-sorted streaming.

Turns are dealt by conversation and sorted by turn; a stream over them carries the state of a dynamic
program from one Arrow batch to the next and keeps four bytes of backpointers a row, which go to a
spool file once they pass a size. The program's stream holds no texts. Its decisions go, as blocks of a
byte a row, into a second stream of the same order that has the texts and applies them.

The roles kept must read ``(s?(ua)+)?`` by initials. That is an automaton of four states: nothing yet, after
a system, a user, an assistant turn. Of equal costs the least string of edits wins; the best strings of two
states after a row both end with that row's edit, so that neither is the other's start and their order holds
whatever follows: the order of four states is all that is carried. Before a row one insertion at most can
pay: two lead from a state back to it or, after a system turn, cost more than its deletion, and from nothing
they give no more than nothing does.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of edits: another role, deletion, insertion, and a truncated turn that stays.
REROLE, DELETE, INSERT, STAYS = 1, 2, 5, 5
#: Edits of one row in order of their strings: I stands for an insertion before it.
EDITS = ("D", "ID", "IK", "IR", "K", "R")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Rows whose backpointers are one block, and bytes of a conversation's backpointers that stay in memory.
BLOCK, IN_MEMORY = 8192, 1 << 20
WHITE = " \t\n\x0b\x0c\r"
#: Neighbouring initials that are as they should be.
LEGAL = frozenset(("su", "ua", "au"))
FAULTS = ("blank", "duplicate", "truncated")
NAMES = {"u": "user", "a": "assistant"}
OWN = frozenset("sua")


def after(state: int, initial: str) -> int | None:
    """The state after a turn of that initial; None if it can't stand there."""
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == "s" and state == NOTHING else None


def wanted(state: int) -> str:
    """The initial that an inserted turn, or one of a new role, gets."""
    return "a" if state == USER else "u"


Carry = tuple[tuple[int, int] | None, ...]
#: For each state: cost above the cheapest, and place of its string of edits among those of the states.
BEGIN: Carry = ((0, 0), None, None, None)


@cache
def step(carry: Carry, initial: str, fault: str) -> tuple[Carry, int, int]:
    """The next carry, what the cheapest cost grows by, and the backpointers: five bits for each state (edit and state before).

    The costs of states differ by a few units, so there are few carries and each is worked out once.
    """
    best: dict[int, tuple[int, int, str, int]] = {}
    for state, held in enumerate(carry):
        if held is None:
            continue
        for lead in ("", "I"):
            at = state if not lead else after(state, wanted(state))
            cost = held[0] + (INSERT if lead else 0)
            options = [("D", at, DELETE)]
            if fault in ("", "truncated"):
                stays = STAYS if fault else 0
                options += [("K", after(at, initial), stays), ("R", after(at, wanted(at)), stays + REROLE)]
            for edit, to, more in options:
                option = (cost + more, held[1], lead + edit, state)
                if to is not None and (to not in best or option < best[to]):
                    best[to] = option
    least = min(o[0] for o in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    nxt = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
    back = sum((EDITS.index(o[2]) << 2 | o[3]) << 5 * s for s, o in best.items())
    return nxt, least, back


def ended(carry: Carry) -> tuple[int, int, bool]:
    """What the end adds to the cheapest cost, the state it comes from, and whether an assistant's turn is added."""
    options = [(carry[s][0] + (INSERT if s == USER else 0), carry[s][1], s) for s in (NOTHING, ASSISTANT, USER) if carry[s]]
    cost, _, state = min(options)
    return cost, state, state == USER


class Program:
    """The dynamic program over one conversation's rows, in their order; memory doesn't grow with them."""

    def __init__(self) -> None:
        self.carry, self.cost, self.rows, self.illegal, self.gaps = BEGIN, 0, 0, 0, 0
        self.counts = dict.fromkeys(FAULTS, 0)
        self.block, self.keys, self.spool = array("I"), [], None
        self.turns, self.initial = None, None

    def add(self, key: tuple, has_turn: bool, turn: int, role: str, fault: str, n: int) -> None:
        """A row and its n - 1 copies, which are duplicates and go."""
        if not self.block:
            self.keys.append(key)
        initial = role[:1]
        self.carry, more, back = step(self.carry, initial if initial in OWN else "", fault)
        self.cost += more + DELETE * (n - 1)
        self.block.append(back)
        if len(self.block) == BLOCK:
            self._spill()
        self.rows += n
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += n - 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # neighbours of the same initial
        self.initial = initial
        if has_turn:
            least, most, distinct = self.turns or (turn, turn, 0)
            self.turns = (least, turn, distinct + (distinct == 0 or turn != most))

    def _spill(self) -> None:
        if self.spool is None:
            self.spool = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)  # its file, if any, has no name and ends with it
        self.spool.write(self.block.tobytes())
        self.block = array("I")

    def close(self) -> tuple[int, bool]:
        """The cheapest cost and whether a turn is added at the end; blocks() then gives the edits."""
        if self.turns:
            self.gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2]
        more, self.state, tail = ended(self.carry)
        return self.cost + more, tail

    def blocks(self) -> Iterator[tuple[tuple, bytes]]:
        """The first row's key and each row's edit, block by block from the end."""
        block, size = self.block, BLOCK * 4
        for k in range(len(self.keys) - 1, -1, -1):
            if not block:
                self.spool.seek(k * size)
                block = array("I", self.spool.read(size))
            edits = bytearray(len(block))
            for i in range(len(block) - 1, -1, -1):
                one = block[i] >> 5 * self.state
                edits[i], self.state = one >> 2 & 7, one & 3
            yield self.keys[k], bytes(edits)
            block = None
        if self.spool is not None:
            self.spool.close()


KEY = ["conv", "has", "last", "has_turn", "turn", "role", "h"]
_KEY = "conv string, has boolean, last boolean, has_turn boolean, turn long, role string, h string"
COUNTS = ["rows", "gaps", *FAULTS, "illegal", "cost"]
_COUNTS = ", ".join(f"{c} long" for c in COUNTS)


def _decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of edits under the key of their first row; for each conversation a last row with its counts."""
    now, out = Program(), []
    frame = lambda rows: pd.DataFrame(rows, columns=[*KEY, "edits", "tail", *COUNTS])
    for part in parts:
        for row in zip(*[part[c].tolist() for c in [*KEY, "fault", "n"]], strict=True):
            key, fault, n = row[:-2], row[-2], row[-1]
            if not key[2]:
                now.add(key, key[3], key[4], key[5], fault, n)
                continue
            cost, tail = now.close()
            for first, edits in now.blocks():
                out.append((*first, edits, False, *[0] * len(COUNTS)))
                if len(out) >= 256:
                    yield frame(out)
                    out = []
            out.append((*key, b"", tail, now.rows, now.gaps, *now.counts.values(), now.illegal, cost))
            now = Program()
        if out:
            yield frame(out)
            out = []


REPAIRED = "conv string, has boolean, place long, edit string, has_turn boolean, turn long, role string, text string, " + _COUNTS


def _apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits on the rows with their texts, in order: kept, changed, inserted and deleted rows, then a row ``end`` with the counts."""
    none = [0] * len(COUNTS)
    edits, at, state, place, before = b"", 0, NOTHING, 0, None
    for part in parts:
        out = []
        for row in zip(*[part[c].tolist() for c in [*KEY, "text", "edits", "tail", *COUNTS]], strict=True):
            key, text, block, tail = row[:7], row[7], row[8], row[9]
            conv, has, last, has_turn, turn, role, _ = key

            def put(edit: str, role: str, text: str, has_turn: bool = False, turn: int = 0) -> None:
                nonlocal place
                out.append((conv, has, place, edit, has_turn, turn, role, text, *none))  # noqa: B023
                place += 1

            if last:
                if tail:
                    put("I", "assistant", "")
                out.append((conv, has, place, "end", False, 0, "", "", *row[10:]))
                edits, at, state, place, before = b"", 0, NOTHING, 0, None
            elif text is None:
                edits, at = block, 0
            elif key == before:  # a copy of the row before
                put("D", role, text, has_turn, turn)
            else:
                edit, before = EDITS[edits[at]], key
                at += 1
                if edit[0] == "I":
                    new = wanted(state)
                    put("I", NAMES[new], "")
                    state = after(state, new)
                if edit[-1] == "R":
                    role = NAMES[wanted(state)]
                put(edit[-1], role, text, has_turn, turn)
                if edit[-1] != "D":
                    state = after(state, role[:1])
        if out:
            yield pd.DataFrame(out, columns=["conv", "has", "place", "edit", "has_turn", "turn", "role", "text", *COUNTS])


def _keyed(turns: DataFrame) -> DataFrame:
    """Turns under columns of the stream's own; nulls of ids and turns apart, those of roles and texts one space."""
    return turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNotNull().alias("has"), F.lit(False).alias("last"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("h", F.md5("text"))


def _fault(text: Column, again: Column) -> Column:
    """A row's first fault, empty if it has none."""
    bare = F.rtrim(text, F.lit(WHITE))
    end = F.substring(bare, -1, 1)
    return F.when(bare == "", "blank").when(again, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")


def repaired(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Edited rows of conversations: conv string, has (false for the null conversation), place, edit, has_turn, turn, role, text, counts.

    ``turns``: conv_id, turn, role, text; other columns don't matter. ``every``: conv_ids that get an ``end`` row
    with their counts (rows, gaps, blank, duplicate, truncated, illegal, cost) even if they have no turns; else those of
    ``turns``. Edits: K kept, R with another role, D deleted, I inserted. The rows of a conversation stand in
    one part, in order.

    A null conversation id is a conversation of its own; null turns come first; null roles and texts are one
    space. Rows of equal turn are ordered by role and the md5 of their text; of equal rows all but the first are
    duplicates. Repeats are found by the key (conversation, role, md5) before the stream, so that it needs no memory
    of earlier rows. Equal rows are one row with a count in the first stream. A giant conversation is a long stream in one
    task (its order and the digest demand it), in bounded memory. An empty table gives an empty one.
    """
    rows = _keyed(turns)
    slim = rows.select(*KEY, _fault(F.col("text"), F.lit(False)).alias("fault")).groupBy(*KEY, "fault").agg(F.count("*").alias("n"))
    said, when = ["conv", "has", "role", "h"], F.struct("has_turn", "turn")
    first = slim.groupBy(*said).agg(F.min(when).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    slim = slim.join(first, said, "left")
    again = F.coalesce(when != F.col("first"), F.lit(False))
    slim = slim.withColumn("fault", F.when(again & (F.col("fault") != "blank"), "duplicate").otherwise(F.col("fault")))
    ends = _keyed((turns if every is None else every).select("conv_id").distinct().select("conv_id", *[F.lit(None).cast("string").alias(c) for c in ("turn", "role", "text")]))
    ends = ends.withColumn("last", F.lit(True)).select(*KEY, F.lit("").alias("fault"), F.lit(1).cast("long").alias("n"))
    stream = slim.select(*KEY, "fault", "n").unionByName(ends)
    decided = stream.repartition("conv", "has").sortWithinPartitions(*KEY).mapInPandas(_decide, f"{_KEY}, edits binary, tail boolean, {_COUNTS}")
    whole = rows.select(*KEY, "text", F.lit(None).cast("binary").alias("edits"), F.lit(False).alias("tail"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    whole = whole.unionByName(decided.withColumn("text", F.lit(None).cast("string")))
    return whole.repartition("conv", "has").sortWithinPartitions(*KEY, F.col("text").isNotNull()).mapInPandas(_apply, REPAIRED)


def turns_of(edited: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id string, place, turn, role, text; an inserted turn has no number."""
    d = edited.where(F.col("edit").isin("K", "R", "I"))
    return d.select(F.when(F.col("has"), F.col("conv")).alias("conv_id"), "place", F.when(F.col("has_turn"), F.col("turn")).alias("turn"), "role", "text", "edit")


def _digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha, audit, empty = hashlib.sha256(), [], True
    for part in parts:
        out = []
        for row in zip(*[part[c].tolist() for c in ["conv", "has", "edit", "role", "text", *COUNTS]], strict=True):
            conv, has, edit, role, text = row[:5]
            if edit == "end":
                out.append((conv, has, *row[5:], "".join(audit), sha.hexdigest()))
                sha, audit, empty = hashlib.sha256(), [], True
                continue
            audit.append(edit)
            if edit != "D":
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if out:
            yield pd.DataFrame(out, columns=["conv", "has", *COUNTS, "audit", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with faults put in by the checksum of ``conv_id:turn`` (nulls: one space), modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("r"))
    text = F.when(F.col("r") == 1, "").when(F.col("r") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.where("r != 0").select("conv_id", "turn", F.when(F.col("r") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("r") == 3, 2).otherwise(1))).alias("copy"))
    return d.drop("copy")


def digests(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of the damaged table: counts of faults, cost, audit and the digest of the repaired turns."""
    kind = conversations.schema["conv_id"].dataType
    d = repaired(damaged(conversations), conversations).mapInPandas(_digest, f"conv string, has boolean, {_COUNTS}, audit string, repaired_sha256 string")
    return d.select(F.when(F.col("has"), F.col("conv")).cast(kind).alias("conv_id"), "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256", F.col("rows").alias("n_rows"))


#: The same in DuckDB: a recursion over rows that keeps the best string of edits, and its text, for each state.
ORACLE_SQL = r"""
with recursive
tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as hx from conversations),
c as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(hx) // 2), lambda i: ('0x' || hx[2*i+1:2*i+2])::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as r from k, tab),
d as (select conv_id, turn, case when r = 4 then 'user' else role end as role, case when r = 1 then '' when r = 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(range(case r when 0 then 0 when 3 then 2 else 1 end)) from c)),
o as (select *, rtrim(text, E' \t\n\x0b\f\r') as bare, row_number() over w as i,
    left(role, 1) as init, lag(left(role, 1)) over w as prev from d window w as (partition by conv_id order by turn nulls first, role, md5(text))),
f as (select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
e(edit, lead) as (values ('D', 0), ('K', 0), ('R', 0), ('D', 1), ('K', 1), ('R', 1)),
dp as (
  select distinct conv_id, 0::bigint as i, 0 as st, 0::bigint as cost, '' as audit, null::varchar as txt from f
  union all
  select conv_id, i, st, cost, audit, txt from (
    select *, row_number() over (partition by conv_id, st order by cost, audit) as best from (
      select conv_id, i + 1 as i, case when edit = 'D' then s1 when edit = 'R' then case s1 when 2 then 3 else 2 end
          when init = 'u' and s1 <> 2 then 2 when init = 'a' and s1 = 2 then 3 when init = 's' and s1 = 0 then 1 end as st,
        cost + 5 * lead + case edit when 'D' then 2 else (edit = 'R')::int + 5 * (fault = 'truncated')::int end as cost,
        audit || case when lead = 1 then 'I' else '' end || edit as audit,
        case when edit = 'D' then t1 else coalesce(t1 || chr(10), '') || case when edit = 'K' then role when s1 = 2 then 'assistant' else 'user' end || ':' || text end as txt
      from (select dp.conv_id, dp.i, dp.cost, dp.audit, f.init, f.fault, f.role, f.text, edit, lead, case when lead = 0 then st when st = 2 then 3 else 2 end as s1,
          case when lead = 0 then txt else coalesce(txt || chr(10), '') || case when st = 2 then 'assistant:' else 'user:' end end as t1
        from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1, e where edit = 'D' or fault in ('', 'truncated'))) where st is not null) where best = 1),
n as (select conv_id, count(*) as n, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (prev is not null and prev || init not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from f group by conv_id),
z as (select conv_id, first(cost order by cost, audit) as cost, first(audit order by cost, audit) as audit, first(coalesce(txt, '') order by cost, audit) as txt
  from (select dp.conv_id, case when st = 2 then cost + 5 else cost end as cost, case when st = 2 then audit || 'I' else audit end as audit, case when st = 2 then txt || chr(10) || 'assistant:' else txt end as txt
    from dp join n on n.conv_id is not distinct from dp.conv_id and dp.i = n.n where st <> 1) group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(txt, '')) as repaired_sha256, coalesce(n, 0) as n_rows
from (select distinct conv_id from conversations) a left join n on n.conv_id is not distinct from a.conv_id left join z on z.conv_id is not distinct from a.conv_id
"""
