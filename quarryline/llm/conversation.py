"""Repair of conversations: an error-correcting Earley parse of the roles, at least cost.

The grammar says which roles may follow each other.  Error productions are added:
a role may be written over a row of another role (rerole), a role may stand where
there is no row (insert), and a row may be passed over (delete).  A chart item
keeps the least (cost, audit), the audit being the initials of the edits in order;
the item that is complete at the end gives the repair.  The grammar is left-linear,
so every item begins at the first row: a set of the chart holds one item for each
rule and dot at most, parsing is linear, and it can be entered at any row.

A conversation may hold any number of rows.  All rows are sorted across partitions
and cut into segments of ``SEGMENT`` rows at most.  Each segment is parsed from
every nonterminal that may be complete before it.  Of a whole conversation only
costs and ranks of its segments meet in one place, where the cheapest chain is
picked, and the edits go back to the rows by their position.  Inserts are made
before rows only (and after the last), so of two different audits over the same
rows none begins with the other and ranks of segments decide ties of the whole.

Defined cases: rows are taken by turn, null turns first, then by role and text;
equal rows are interchangeable; null roles and texts must be replaced before
(the query uses one space) and are read as empty; a row whose role the grammar does
not know can be written over or deleted only; a null conversation id is a
conversation; a conversation without rows, and an empty table, give no rows;
other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENT = 512
#: Charts of so many rows from a segment's beginning are remembered by the worker.
REMEMBERED = 12
FINE, DROP, CUT_OFF = ".", "d", "t"  # a row's fault: none; to be deleted; end missing
NOT_BLANK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """``left`` is ``before`` followed by one row of a role, given by its initial."""

    left: str
    before: str
    role: str


@dataclass(frozen=True)
class Grammar:
    """A left-linear grammar of roles.  ``start`` is complete before the first row, one of ``accepts`` must be at the end; ``written`` are the roles, by initial, that a repair may write."""

    rules: tuple[Rule, ...]
    start: str
    accepts: tuple[str, ...]
    written: tuple[tuple[str, str], ...]
    rerole: int = 3
    insert: int = 3
    delete: int = 4
    truncated: int = 3
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "names", tuple(sorted({self.start, *(r.left for r in self.rules), *(r.before for r in self.rules)})))


#: An optional system row, then pairs of user and assistant; or nothing at all.
TURNS = Grammar(
    rules=(Rule("system", "nothing", "s"), Rule("user", "nothing", "u"), Rule("user", "system", "u"), Rule("user", "assistant", "u"), Rule("assistant", "user", "a")),
    start="nothing",
    accepts=("nothing", "assistant"),
    written=(("u", "user"), ("a", "assistant")),
)
#: Pairs of neighbouring initials that are legal.
LEGAL = ("su", "ua", "au")

Best = tuple[int, str, str]  # cost, initials of the edits, role written or kept at each edit
Done = dict[str, Best]  # what is complete from the first row up to here


def _offer(done: Done, name: str, best: Best) -> bool:
    if name in done and done[name] <= best:
        return False
    done[name] = best
    return True


def predicted(grammar: Grammar, done: Done) -> dict[Rule, Best]:
    """Items whose dot stands before the role: one for each rule whose beginning is complete."""
    return {rule: done[rule.before] for rule in grammar.rules if rule.before in done}


def inserted(grammar: Grammar, done: Done) -> Done:
    """Completes items over no row, for the price of an insert, until no item gets cheaper."""
    done, roles, better = dict(done), dict(grammar.written), True
    while better:
        better = False
        for rule, (cost, audit, said) in predicted(grammar, done).items():
            if rule.role in roles:
                better |= _offer(done, rule.left, (cost + grammar.insert, audit + "I", said + rule.role))
    return done


def scanned(grammar: Grammar, done: Done, initial: str, fault: str) -> Done:
    """The next set of the chart: the row is deleted, kept or written over."""
    after: Done = {}
    for name, (cost, audit, said) in done.items():
        _offer(after, name, (cost + grammar.delete, audit + "D", said + "-"))
    if fault == DROP:
        return after
    extra, roles = grammar.truncated * (fault == CUT_OFF), dict(grammar.written)
    for rule, (cost, audit, said) in predicted(grammar, done).items():
        if rule.role == initial:
            _offer(after, rule.left, (cost + extra, audit + "K", said + initial))
        if rule.role in roles:
            _offer(after, rule.left, (cost + extra + grammar.rerole, audit + "R", said + rule.role))
    return after


@lru_cache(maxsize=100_000)
def _remembered(grammar: Grammar, seed: str, symbols: str) -> tuple[tuple[str, Best], ...]:
    if not symbols:
        return ((seed, (0, "", "")),)
    before = dict(_remembered(grammar, seed, symbols[:-2]))
    return tuple(scanned(grammar, inserted(grammar, before), *symbols[-2:]).items())


def chart(grammar: Grammar, seed: str, symbols: str) -> Done:
    """What is complete after the rows, where ``seed`` was complete before them; ``symbols`` has two letters a row: initial and fault."""
    done = dict(_remembered(grammar, seed, symbols[: 2 * REMEMBERED]))
    for i in range(2 * REMEMBERED, len(symbols), 2):
        done = scanned(grammar, inserted(grammar, done), symbols[i], symbols[i + 1])
    return done


def closing(grammar: Grammar, name: str) -> tuple[int, str] | None:
    """Cost and roles of the inserts after the last row."""
    ends = inserted(grammar, {name: (0, "", "")})
    best = min(((ends[a][0], ends[a][2]) for a in grammar.accepts if a in ends), default=None)
    return best


def parse(grammar: Grammar, symbols: str) -> Best | None:
    """Cost, audit and written roles of the cheapest repair of a whole conversation; None if the grammar allows none."""
    ends = [(cost + c, audit + "I" * len(r), said + r) for name, (cost, audit, said) in chart(grammar, grammar.start, symbols).items() if (end := closing(grammar, name)) for c, r in [end]]
    return min(ends, default=None)


_SEGMENT_TYPE = "conv_id {0}, seg long, pos array<long>, first string, last string, illegal long, costs array<int>, ranks array<int>, audits array<string>, said array<string>"


def _parse_segments(grammar: Grammar):
    """Each segment from every nonterminal to every nonterminal: cells in order of (from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for symbols in batch.column(3).to_pylist():
                cells = [done.get(name) for done in (chart(grammar, seed, symbols) for seed in grammar.names) for name in grammar.names]
                order = {x: i for i, x in enumerate(sorted({c[1:] for c in cells if c}))}
                initials = symbols[::2]
                made = (initials[0], initials[-1], sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), [c and c[0] for c in cells], [c and order[c[1:]] for c in cells], [c and c[1] for c in cells], [c and c[2] for c in cells])
                for column, value in zip(out, made, strict=False):
                    column.append(value)
            types = [pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.string())] * 2]
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["conv_id", "seg", "pos", "first", "last", "illegal", "costs", "ranks", "audits", "said"])

    return run


def cheapest_chain(grammar: Grammar, segments: list[dict]) -> tuple[int, int, list[int], str] | None:
    """Cost, illegal neighbours, the cell of each segment and the roles inserted at the end.  Ranks of chains are kept dense, so ties are decided as by the whole audits."""
    names = grammar.names
    live = {grammar.start: (0, 0)}  # nonterminal: cost, rank of the audit so far
    steps: list[dict[str, tuple[str, int]]] = []
    illegal, last = 0, None
    for s in segments:
        illegal += s["illegal"] + (last is not None and last + s["first"] not in LEGAL)
        last = s["last"]
        best: dict[str, tuple] = {}
        for i, seed in enumerate(names):
            if seed in live:
                for j, name in enumerate(names):
                    cell = i * len(names) + j
                    if s["costs"][cell] is not None:
                        key = (live[seed][0] + s["costs"][cell], live[seed][1], s["ranks"][cell], seed, cell)
                        best[name] = min(best.get(name, key), key)
        dense = {x: i for i, x in enumerate(sorted({k[1:3] for k in best.values()}))}
        live = {name: (k[0], dense[k[1:3]]) for name, k in best.items()}
        steps.append({name: (k[3], k[4]) for name, k in best.items()})
    ends = [(cost + end[0], rank, len(end[1]), end[1], name) for name, (cost, rank) in live.items() if (end := closing(grammar, name))]
    if not ends:
        return None
    cost, _, _, tail, name = min(ends)
    cells = []
    for step in reversed(steps):
        name, cell = step[name]
        cells.append(cell)
    return cost, illegal, cells[::-1], tail


def _chains(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, illegal, picks = [], [], []
            for segments in batch.column(1).to_pylist():
                found = cheapest_chain(grammar, segments)
                if found is None:
                    raise ValueError("the grammar allows no repair of a conversation")
                costs.append(found[0])
                illegal.append(found[1])
                ends = [""] * (len(segments) - 1) + [found[3]]
                picks.append([{"seg": s["seg"], "cell": c, "tail": t} for s, c, t in zip(segments, found[2], ends, strict=True)])
            kind = pa.list_(pa.struct([("seg", pa.int64()), ("cell", pa.int32()), ("tail", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(picks, kind)], ["conv_id", "cost", "illegal", "picks"])

    return run


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit: the position of the row it belongs to, its number there, its initial and the role said."""
    for batch in batches:
        out: list[tuple] = []
        for pos, audit, said, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            at = nth = 0
            for edit, role in zip(audit + "I" * len(tail), said + tail, strict=True):
                out.append((pos[min(at, len(pos) - 1)], nth, edit, role))
                nth += 1
                if edit != "I" and at + 1 < len(pos):
                    at, nth = at + 1, 0
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["pos", "nth", "edit", "said"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the lines of each conversation, which come in order; no conversation is held."""
    known, key, digest = False, None, hashlib.sha256()
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        keys, values = [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if known and conv == key:
                digest.update(b"\n")
            else:
                if known:
                    keys.append(key)
                    values.append(digest.hexdigest())
                known, key, digest = True, conv, hashlib.sha256()
            digest.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.string())], ["conv_id", "sha256"])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "sha256"])


@dataclass(frozen=True)
class Repair:
    """``rows``: conv_id, pos and nth (their order), edit, role, text, one for each edit, deleted rows included.  ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""

    rows: DataFrame
    conversations: DataFrame

    def digests(self) -> DataFrame:
        """conv_id, sha256 of the repaired ``role:text`` lines.  A digest is sequential, so a conversation's lines stream through one task; conversations without lines give no row."""
        lines = self.rows.filter("edit <> 'D'").select("conv_id", "pos", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
        lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "line")
        return lines.mapInArrow(_digests, f"conv_id {self.rows.schema['conv_id'].dataType.simpleString()}, sha256 string")


def ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text and pos, which rises along each conversation; stored.  A last key of no meaning lets a crowd of equal rows be cut."""
    rows = df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = rows.withColumn("any", F.monotonically_increasing_id())
    rows = rows.orderBy(*(F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "any"))).drop("any")
    return common.stored(rows.withColumn("pos", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, pos and the first fault of each row: blank, duplicate, truncated or null."""
    # What a row needs of its text is taken before anything is shuffled.
    end = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    slim = rows.select("conv_id", "turn", "role", "pos", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"), end.alias("end"))
    first = slim.groupBy("conv_id", "role", "h1", "h2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("end") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return slim.join(first, "pos", "left").select("conv_id", "turn", "role", "pos", fault.alias("fault"))


def symbol(role: Column, fault: Column, grammar: Grammar) -> Column:
    """Two letters: the role's initial where the grammar knows it, and the fault."""
    known = sorted({r.role for r in grammar.rules})
    initial = F.substring(role, 1, 1)
    mark = F.when(fault.isin("blank", "duplicate"), DROP).when(fault == "truncated", CUT_OFF).otherwise(FINE)
    return F.concat(F.when(initial.isin(known), initial).otherwise("-"), mark)


def repaired(df: DataFrame, grammar: Grammar = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    rows = ordered(df, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    marked = common.stored(faults(rows))
    # Positions count up from a multiple of SEGMENT in each partition, so no segment reaches across two.
    parts = marked.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", symbol(F.col("role"), F.col("fault"), grammar).alias("symbol")))).alias("x"))
    parts = parts.select("conv_id", F.col("x")[0]["pos"].alias("seg"), F.col("x.pos").alias("pos"), F.array_join("x.symbol", "").alias("symbols"))
    segments = common.stored(parts.mapInArrow(_parse_segments(grammar), _SEGMENT_TYPE.format(kind)))
    meet = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "first", "last", "illegal", "costs", "ranks"))).alias("segments"))
    chains = common.stored(meet.mapInArrow(_chains(grammar), f"conv_id {kind}, cost long, illegal long, picks array<struct<seg: long, cell: int, tail: string>>"))
    picks = chains.select(F.explode("picks").alias("p")).select("p.*")
    chosen = segments.join(picks, "seg").select("conv_id", "seg", "pos", F.col("audits")[F.col("cell")].alias("audit"), F.col("said")[F.col("cell")].alias("said"), "tail")
    audits = chosen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", F.concat("audit", F.expr("repeat('I', length(tail))")).alias("audit")))).alias("x"))
    edits = chosen.select("pos", "audit", "said", "tail").mapInArrow(_edits, "pos long, nth int, edit string, said string")
    names = F.create_map(*(F.lit(x) for pair in grammar.written for x in pair))
    role = F.when(F.col("edit").isin("R", "I"), names[F.col("said")]).otherwise(F.col("role"))
    out = edits.join(rows, "pos").select("conv_id", "pos", "nth", "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    many = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long"))
    counts = marked.groupBy("conv_id").agg(gaps.alias("gaps"), *many)
    whole = counts.alias("c").join(chains.alias("k"), F.col("c.conv_id").eqNullSafe(F.col("k.conv_id"))).join(audits.alias("a"), F.col("c.conv_id").eqNullSafe(F.col("a.conv_id")))
    whole = whole.select("c.*", "k.illegal", "k.cost", F.array_join("a.x.audit", "").alias("audit"))
    return Repair(out, whole)
