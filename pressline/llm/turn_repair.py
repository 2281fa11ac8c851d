"""Conversation structure repair by lightest derivations.

A conversation should read ``s?(ua)+`` in role initials (or be empty) and hold
no blank, repeated or cut-off turn. Its edits are weighted deductions over
hypergraph items, searched with Knuth's generalisation of Dijkstra's method:

* axioms: ``edit(i, r)``, row i kept, re-roled or deleted, giving role r or
  nothing; ``new(r)``, an inserted empty turn;
* ``prefix(i, q) x edit(i, r) -> prefix(i + 1, q')`` and
  ``prefix(i, q) x new(r) -> prefix(i, q')``, q being the state of the role
  pattern after the first i rows;
* the value of an item is (cost, rows covered, audit); a deduction adds costs
  and rows and concatenates audits. That function is monotone in both
  arguments and never below either of them (with equal cost and rows the other
  argument is the empty prefix), so the first time an item is popped from the
  agenda its value is final, and the search ends when the goal is popped.

Spark numbers nothing globally and gathers no conversation: equal rows are
counted before the shuffle, rows are range-partitioned by (conversation, turn)
and read as a sorted stream, ``BLOCK`` rows at a time. A conversation inside one
block is finished there. One that is cut, by its length or by a partition's
end, has a table per block, the lightest derivation from every state to every
state; a second pass streams the tables of a conversation and picks the path,
a third one streams its blocks and hashes the repaired turns in order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: rows of one conversation that are searched together
BLOCK = 512
#: costs of the edits, and of leaving a cut-off turn
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: states of the role pattern: nothing yet, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U,
        (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
GOALS = (START, AFTER_A)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
NO, BLANK, DUPLICATE, TRUNCATED = range(4)
_SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after reproducible damage: (conv_id, turn, role, text, copies),
    a dropped row with 0 copies. A null text or role is one space, as is a null
    conv_id or turn in the key that chooses the damage."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                             F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    return c.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Different rows with their counts and whether the same role and text
    stand at an earlier turn, sorted within ranges of (conv_id, turn)."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = (rows.withColumn("said", F.unhex(said)).groupBy("conv_id", "turn", "role", "said")
            .agg(F.first("text").alias("text"), F.sum("copies").alias("copies")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = (rows.where("copies > 0").groupBy("conv_id", "said").agg(F.min(at).alias("first"), F.max(at).alias("last"))
             .where("first < last").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first"))
    rows = rows.join(first, rows.conv_id.eqNullSafe(first.c) & (rows.said == first.s), "left")
    order = ["conv_id", "turn", "role", "text"]
    return (rows.select(*order, "copies", F.coalesce(at > F.col("first"), F.lit(False)).alias("seen"))
            .repartitionByRange(*order).sortWithinPartitions(*order))


def fault(role: str, text: str, seen: bool) -> int:
    end = text.rstrip(_SPACE)
    if not end:
        return BLANK
    if seen:
        return DUPLICATE
    return NO if end[-1] in ".!?" else TRUNCATED


def edits(role: str, kind: int, copies: int) -> list[tuple[str, tuple[int, int, str]]]:
    """(role initial or nothing, value) of every edit of a row; its further
    copies are duplicates, deleted behind it."""
    more = "D" * (copies - 1)
    rest = DELETE * (copies - 1)
    out = [("", (DELETE + rest, copies, "D" + more))]
    if kind in (NO, TRUNCATED):
        left = rest + (CUT_OFF if kind == TRUNCATED else 0)
        if role[:1] in ("s", "u", "a"):
            out.append((role[0], (left, copies, "K" + more)))
        out += [(r, (left + REROLE, copies, "R" + more)) for r in ROLE]
    return out


def lightest(rows: list[tuple[str, int, int]], start: int = START, goals: tuple[int, ...] | None = GOALS) -> dict[int, tuple[int, str]]:
    """Lightest derivations of ``prefix(all rows, q)`` from ``prefix(0, start)``.

    ``rows`` has (role, fault, copies). With ``goals`` the one item that is
    popped first among those states, without it one for every state."""
    n = len(rows)
    agenda: list = [((0, 0, ""), ("prefix", 0, start))]
    agenda += [((INSERT, 0, "I"), ("new", 0, r)) for r in ROLE]
    for i, row in enumerate(rows):
        agenda += [(value, ("edit", i, r)) for r, value in edits(*row)]
    heapq.heapify(agenda)
    final: set = set()
    # finalised items by what they can be combined with
    prefixes: list[list] = [[] for _ in range(n + 1)]
    changes: list[list] = [[] for _ in range(n)]
    new: list = []
    found: dict[int, tuple[int, str]] = {}

    def deduce(i: int, q: int, x: tuple, r: str, y: tuple, forward: int) -> None:
        to = STEP.get((q, r)) if r else q
        if to is not None and ("prefix", i + forward, to) not in final:
            heapq.heappush(agenda, ((x[0] + y[0], x[1] + y[1], x[2] + y[2]), ("prefix", i + forward, to)))

    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final and item[0] == "prefix":
            continue
        kind, i, what = item
        if kind == "prefix":
            final.add(item)
            if i == n:
                if goals is None or what in goals:
                    found[what] = (value[0], value[2])
                    if goals is not None:
                        break
            else:
                for r, y in changes[i]:
                    deduce(i, what, value, r, y, 1)
            for r, y in new:
                deduce(i, what, value, r, y, 0)
            prefixes[i].append((what, value))
        elif kind == "edit":
            changes[i].append((what, value))
            for q, x in prefixes[i]:
                deduce(i, q, x, what, value, 1)
        else:
            new.append((what, value))
            for j, at in enumerate(prefixes):
                for q, x in at:
                    deduce(j, q, x, what, value, 0)
    return found


def replay(rows: list[tuple[str, str, int]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that ``audit`` leaves of the (role, text, copies)
    rows, from ``state`` on."""
    flat = ((role, text) for role, text, copies in rows for _ in range(copies))
    for e in audit:
        role, text = next(flat) if e != "I" else ("", "")
        if e == "D":
            continue
        if e != "K":
            role = ROLE["a" if state == AFTER_U else "u"]
        state = STEP[state, role[0]]
        yield role, text


_STATS = "n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
_TURNS = "array<struct<role:string,text:string>>"


def _stats(block: list[tuple]) -> dict:
    """Counts of a block of (turn, role, text, copies, fault) rows."""
    out = dict(n=0, low=None, high=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, head=None, tail=None)
    for turn, role, _, copies, kind in block:
        out["n"] += copies
        if turn is not None:
            out["turns"] += turn != out["high"]
            out["low"] = turn if out["low"] is None else out["low"]
            out["high"] = turn
        out["blank"] += copies * (kind == BLANK)
        out["duplicate"] += copies * (kind == DUPLICATE) + (copies - 1) * (kind in (NO, TRUNCATED))
        out["truncated"] += kind == TRUNCATED
        at = role[:1]
        out["illegal"] += copies - 1 + (out["tail"] is not None and out["tail"] + at not in LEGAL)
        out["head"] = at if out["head"] is None else out["head"]
        out["tail"] = at
    return out


def merged(x: dict, y: dict) -> dict:
    """The counts of two runs of rows, one behind the other."""
    out = {k: x[k] + y[k] for k in ("n", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= x["high"] is not None and x["high"] == y["low"]
    out["illegal"] += x["tail"] is not None and y["head"] is not None and x["tail"] + y["head"] not in LEGAL
    first = lambda a, b: a if a is not None else b
    return out | {"low": first(x["low"], y["low"]), "high": first(y["high"], x["high"]),
                  "head": first(x["head"], y["head"]), "tail": first(y["tail"], x["tail"])}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` over a stream of rows as dictionaries."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(fn(_rows(batches)), arrow), schema)


def _blocks(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of the sorted rows of one partition. A conversation that neither
    opens nor closes the partition and fits in a block is whole."""
    ctx = TaskContext.get()
    part, number = ctx.partitionId() if ctx else 0, 0
    held: list[tuple] = []
    conv, pieces, opens, prev = None, 0, True, None

    def flush(whole: bool) -> dict:
        nonlocal number, pieces
        kinds = [(role, kind, copies) for _, role, _, copies, kind in held]
        texts = [(role, text, copies) for _, role, text, copies, _ in held]
        out = {"conv_id": conv, "part": part, "block": number, "whole": whole, **_stats(held)}
        if whole:
            (cost, audit), = lightest(kinds).values()
            turns = [{"role": r, "text": t} for r, t in replay(texts, audit, START)]
            text = "\n".join(f"{t['role']}:{t['text']}" for t in turns)
            out |= {"cost": cost, "audit": audit, "repaired": turns,
                    "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        else:
            every = [lightest(kinds, q, None) for q in range(4)]
            out["paths"] = [{"from": q, "to": to, "cost": c, "audit": a} for q in range(4) for to, (c, a) in every[q].items()]
            out["rows"] = [{"role": r, "text": t, "copies": n} for r, t, n in texts]
        number += 1
        pieces += 1
        held.clear()
        return out

    for r in rows:
        if prev is None or r["conv_id"] != conv:
            if prev is not None:
                yield flush(pieces == 0 and not opens)
                opens = False
            conv, pieces = r["conv_id"], 0
        elif len(held) >= BLOCK:
            yield flush(False)
        prev = r
        if r["copies"]:
            held.append((r["turn"], r["role"], r["text"], r["copies"], fault(r["role"], r["text"], r["seen"])))
    if prev is not None:
        yield flush(False)  # may go on in the next partition


class _Path:
    """One block's step of a derivation, linked to the block before it."""

    __slots__ = ("before", "state", "cost", "audit")

    def __init__(self, before: _Path | None, state: int, cost: int, audit: str) -> None:
        self.before, self.state, self.cost, self.audit = before, state, cost, audit


def _behind(x: _Path, y: _Path, a: str, b: str) -> bool:
    """Whether x's audit with ``a`` is above y's with ``b``; both have as many
    blocks, and are compared from where they part."""
    xs, ys = [a], [b]
    while x is not y:
        xs.append(x.audit)
        ys.append(y.audit)
        x, y = x.before, y.before
    return "".join(reversed(xs)) > "".join(reversed(ys))


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """The lightest derivation of every cut conversation, by block: folds the
    blocks' tables in order."""
    conv, order, at = object(), [], {}

    def done() -> Iterator[dict]:
        (*_, best) = [None, *(at[q] for q in GOALS if q in at)]
        for q in GOALS:
            x = at.get(q)
            if x is not None and (x.cost < best.cost or x.cost == best.cost and x is not best and _behind(best, x, "", "")):
                best = x
        for place in reversed(order):
            yield place | {"entry": best.before.state, "path": best.audit}
            best = best.before

    for r in rows:
        if not order or r["conv_id"] != conv:
            if order:
                yield from done()
            conv, order, at = r["conv_id"], [], {START: _Path(None, START, 0, "")}
        order.append({"part": r["part"], "block": r["block"]})
        then: dict[int, _Path] = {}
        for p in r["paths"]:
            x, to = at.get(p["from"]), p["to"]
            if x is None:
                continue
            cost, y = x.cost + p["cost"], then.get(to)
            if y is None or cost < y.cost or cost == y.cost and _behind(y.before, x, y.audit, p["audit"]):
                then[to] = _Path(x, to, cost, p["audit"])
        at = then
    if order:
        yield from done()


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    """Adds up the blocks of a cut conversation in order; the digest is fed
    turn by turn."""
    conv, stats, audit, digest = object(), None, [], None

    def done() -> dict:
        return {"conv_id": conv, **stats, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    started = False
    for r in rows:
        if stats is None or r["conv_id"] != conv:
            if stats is not None:
                yield done()
            conv, stats, audit, digest, started = r["conv_id"], None, [], hashlib.sha256(), False
        own = {k: r[k] for k in _stats([])}
        stats = own | {"cost": r["cost"]} if stats is None else merged(stats, own) | {"cost": stats["cost"] + r["cost"]}
        audit.append(r["path"])
        for role, text in replay([(x["role"], x["text"], x["copies"]) for x in r["rows"]], r["path"], r["entry"]):
            digest.update((("\n" if started else "") + f"{role}:{text}").encode())
            started = True
    if stats is not None:
        yield done()


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lightest repair of every conversation of (conv_id, turn, role, text,
    copies) rows; a row of 0 copies only names its conversation.

    Returns one row per conversation, (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256), and the repaired turns
    in pieces of at most ``BLOCK`` different rows, (conv_id, part, block,
    repaired), in that order within a conversation.

    All rows with a null conv_id are one conversation; null turns come first;
    rows of one turn are taken by role and text. A conversation without rows
    has zeros, an empty audit and the digest of the empty string. An empty
    table gives no rows; other columns are not read.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    blocks = cut(_mapped(_ordered(rows), _blocks, (
        f"conv_id {conv}, part int, block long, whole boolean, {_STATS}, cost long, audit string, repaired {_TURNS}, "
        "repaired_sha256 string, paths array<struct<`from`:int,`to`:int,cost:long,audit:string>>, "
        "rows array<struct<role:string,text:string,copies:long>>")), "turn-blocks")
    parts = blocks.where(~F.col("whole"))
    by = [F.col(x) for x in ("conv_id", "part", "block")]
    chosen = cut(_mapped(parts.select(*by, "paths").repartition("conv_id").sortWithinPartitions(*by), _chosen,
                         "part int, block long, entry int, path string"), "turn-paths")
    stats = [x.split()[0] for x in _STATS.split(", ")]
    cost = F.expr("filter(paths, p -> p.`from` = entry and p.audit = path)[0].cost").alias("cost")
    followed = parts.join(chosen, ["part", "block"]).select(*by, *stats, cost, "entry", "path", "rows")
    hashed = _mapped(followed.repartition("conv_id").sortWithinPartitions(*by), _hashed,
                     f"conv_id {conv}, {_STATS}, cost long, audit string, repaired_sha256 string")
    out = ["conv_id", *stats, "cost", "audit", "repaired_sha256"]
    summary = blocks.where("whole").select(*out).unionByName(hashed.select(*out))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    replayed = _mapped(followed.select(*by, "entry", "path", "rows"), lambda it: (
        {k: r[k] for k in ("conv_id", "part", "block")} | {"repaired": [
            {"role": role, "text": text} for role, text in
            replay([(x["role"], x["text"], x["copies"]) for x in r["rows"]], r["path"], r["entry"])]} for r in it),
        f"conv_id {conv}, part int, block long, repaired {_TURNS}")
    turns = blocks.where("whole").select(*by, "repaired").unionByName(replayed)
    return summary.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), turns
