"""Conversation repair: error-correcting Earley parsing of roles over a weighted grammar, in pieces of bounded size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import scratch

#: A conversation stands, and system, user and assistant begin its roles: s?(ua)+ or nothing.
GRAMMAR = (("S", ()), ("S", ("P",)), ("P", ("H", "u", "a")), ("P", ("P", "u", "a")), ("H", ()), ("H", ("s",)))
TERMINALS = ("s", "u", "a")
#: What a terminal may stand for when it is made anew.
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: From any item two inserts and a delete lead to where any other can lead: what costs more than that over the cheapest is no repair.
SLACK = 2 * INSERT + DELETE
#: Rows and characters of a piece at most (one row at least).
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20
SOLID = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
FAULTS = ("", "blank", "duplicate", "truncated")

Item = tuple[int, int]  # a rule's number and the place of the dot; every item begins at the conversation's start
Chart = dict[Item, tuple[int, str]]


def _expected(item: Item) -> str | None:
    body = GRAMMAR[item[0]][1]
    return body[item[1]] if item[1] < len(body) else None


#: The rules are left-recursive, so whatever is completed begins where the chart does, and waits there for this.
_PREDICTED = [(i, 0) for i in range(len(GRAMMAR))]
_WAITING = {x: [p for p in _PREDICTED if _expected(p) == x] for x in ("S", "P", "H")}
_NEXT = {item: _expected(item) for i, (_, body) in enumerate(GRAMMAR) for item in ((i, d) for d in range(len(body) + 1))}
#: Items at which a conversation may end, and those that a piece can begin with: they wait for a terminal or are such an end.
ENDS = [(0, 0), (1, 1)]
STARTS = [item for item, x in _NEXT.items() if x in TERMINALS] + ENDS


def closed(chart: Chart) -> Chart:
    """Complete what is done, and insert the terminals that may be inserted, as long as any item becomes cheaper."""
    todo = list(chart)
    while todo:
        item = todo.pop()
        cost, audit = chart[item]
        x = _NEXT[item]
        if x is None:
            steps = [((p[0], 1), (cost, audit)) for p in _WAITING[GRAMMAR[item[0]][0]]]
        elif x in NAMES:
            steps = [((item[0], item[1] + 1), (cost + INSERT, audit + "I"))]
        else:
            continue
        for new, value in steps:
            if new not in chart or value < chart[new]:
                chart[new] = value
                todo.append(new)
    return chart


def began(item: Item | None = None) -> Chart:
    """The chart before any row: all predicted items, or a piece's with one item open."""
    return closed(dict.fromkeys(_PREDICTED, (0, "")) if item is None else {item: (0, "")})


def scanned(chart: Chart, initial: str, fault: int, times: int = 1) -> Chart:
    """The chart after one row (or after times rows that must all be deleted)."""
    out: Chart = {}
    most = min(chart[i][0] for i in STARTS if i in chart) + SLACK
    for item in STARTS:  # what is done otherwise has been handed on
        cost, audit = chart.get(item, (most + 1, ""))
        if cost > most:
            continue
        x = _NEXT[item]
        options = [(item, (cost + DELETE * times, audit + "D" * times))]
        if fault not in (1, 2) and x in TERMINALS:
            more = TRUNCATED if fault == 3 else 0
            done = (item[0], item[1] + 1)
            if x == initial:
                options.append((done, (cost + KEEP + more, audit + "K")))
            elif x in NAMES:
                options.append((done, (cost + REROLE + more, audit + "R")))
        for new, value in options:
            if new not in out or value < out[new]:
                out[new] = value
    return closed(out)


def accepted(chart: Mapping[Item, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) of a conversation that ends here."""
    return min(chart[i] for i in ENDS if i in chart)


def replay(audit: str, roles: Iterable[str], texts: Iterable[str], state: str = "") -> tuple[list[str], str]:
    """The lines that an audit leaves of rows, and the state after it. state: '' at the start, else the role expected (u or a)."""
    rows, lines = zip(roles, texts, strict=True), []
    for letter in audit:
        role, value = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and not state and role[:1] == "s":
            lines.append(f"{role}:{value}")
            state = "u"
            continue
        due = state or "u"
        lines.append(f"{role}:{value}" if letter == "K" else f"{NAMES[due]}:{value}")
        state = "a" if due == "u" else "u"
    return lines, state


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with some rows dropped, emptied, unpunctuated, repeated or of role user.

    crc32 of conv_id:turn modulo 20 decides; a null there, as a null role or text, counts as one space. A dropped row stays
    as a row that says only that its conversation exists: times 0. Adds times.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    value = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    gone = kind == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, value).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _key(role: str, value: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{value}".encode("utf-8", "surrogatepass")).hexdigest()


class _Rows:
    """Rows of a conversation, or of a piece of one, in order; equal rows that follow each other are one entry with times."""

    def __init__(self, conv):
        self.conv = conv
        self.turns, self.roles, self.texts, self.times, self.keys = [], [], [], [], []
        self.chars = 0

    def add(self, turn, role, value, times) -> None:
        if times:
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(value)
            self.times.append(times)
            self.keys.append(_key(role, value))
            self.chars += len(value)

    def faults(self, first: set[str] | None = None) -> list[int]:
        """Each entry's first row's fault. first: keys that no earlier piece has; all without it."""
        seen, out = set(), []
        for role, value, key in zip(self.roles, self.texts, self.keys, strict=True):
            last = _LAST.search(value)
            if last is None:
                out.append(1)
            elif key in seen or (first is not None and key not in first):
                out.append(2)
            else:
                out.append(0 if last[1] in ".!?" else 3)
            seen.add(key)
        return out

    def counts(self, faults: list[int]) -> dict:
        n = [0, 0, 0, 0]
        illegal, before = 0, None
        for role, times, fault in zip(self.roles, self.times, faults, strict=True):
            n[fault] += 1 if fault != 1 else times
            n[2] += times - 1 if fault != 1 else 0
            here = role[:1]
            illegal += (before is not None and before + here not in ("su", "ua", "au")) + times - 1
            before = here
        known = [t for t in self.turns if t is not None]
        return {"blank": n[1], "duplicate": n[2], "truncated": n[3], "illegal": illegal, "turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None)}

    def parsed(self, chart: Chart, faults: list[int]) -> Chart:
        for role, times, fault in zip(self.roles, self.times, faults, strict=True):
            if fault == 1:
                chart = scanned(chart, "", 1, times)
                continue
            chart = scanned(chart, role[:1], fault)
            if times > 1:
                chart = scanned(chart, "", 2, times - 1)
        return chart

    def expanded(self, values: list[str]) -> Iterator[str]:
        return (v for v, n in zip(values, self.times, strict=True) for _ in range(n))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = [*[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
_RESULT_SQL = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_AT = [("part", pa.int64()), ("place", pa.int64())]
_AT_SQL = "part long, place long"
_ROWS = [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))]
_ROWS_SQL = "turns array<long>, roles array<string>, texts array<string>, times array<long>"
_EDGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
_TURNS = ("low", "high", "first_turn", "last_turn")
_PIECE = [("edges", pa.list_(_EDGE)), *[(c, pa.int64()) for c in _SUMS + _TURNS], ("head", pa.string()), ("tail", pa.string())]
_PIECE_SQL = "edges array<struct<start: long, end: long, cost: long, audit: string>>, " + ", ".join(f"{c} long" for c in _SUMS + _TURNS) + ", head string, tail string"
_ITEMS = sorted(_NEXT)
#: The state of replay at an item; a conversation's start is -1.
_STATES = {-1: ""} | {i: _NEXT[item] if _NEXT[item] in NAMES else "" for i, item in enumerate(_ITEMS)}


def _sha(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def _mapped(made: Callable[[Iterator[dict]], Iterator[dict]], fields: list, size: int = 512, chars: int = 1 << 24):
    """A function for mapInArrow out of one from rows to rows; conv_id keeps its type. Batches are bounded by rows and characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def rows() -> Iterator[dict]:
            for batch in batches:
                kind[:] = [batch.schema.field("conv_id").type]
                for at in range(0, batch.num_rows, size):
                    yield from batch.slice(at, size).to_pylist()

        out = lambda held: pa.RecordBatch.from_pylist(held, schema=pa.schema([("conv_id", kind[0]), *fields]))
        held, n = [], 0
        for r in made(rows()):
            held.append(r)
            n += sum(map(len, r.get("texts") or ())) + sum(len(r.get(c) or "") for c in ("audit", "share", "lines"))
            if len(held) >= size or n > chars:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return run


def _whole(rows: _Rows) -> dict:
    """The result of a conversation that is all here."""
    faults = rows.faults()
    n = rows.counts(faults)
    cost, audit = accepted(rows.parsed(began(), faults))
    lines, _ = replay(audit, rows.expanded(rows.roles), rows.expanded(rows.texts))
    gaps = 0 if n["low"] is None else n["high"] - n["low"] + 1 - n["turns"]
    return {"conv_id": rows.conv, "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": _sha("\n".join(lines))} | {c: n[c] for c in _SUMS if c != "turns"}


def _first_pass(found: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows of a range: the results of conversations that lie within it; pieces of its first, its last and the large ones."""
    held: _Rows | None = None
    first, split, place, part = True, False, 0, 0

    def piece() -> dict:
        return {"conv_id": held.conv, "part": part, "place": place, "turns": held.turns, "roles": held.roles, "texts": held.texts, "times": held.times}

    for r in found:
        part = r["part"]
        if held is None or held.conv != r["conv_id"]:
            if held is not None:
                yield piece() if first or split else _whole(held)
                place, first, split = place + 1, False, False
            held = _Rows(r["conv_id"])
        elif len(held.turns) >= PIECE_ROWS or held.turns and held.chars + len(r["text"] or "") > PIECE_CHARS:
            yield piece()
            place, split = place + 1, True
            held = _Rows(r["conv_id"])
        held.add(r["turn"], r["role"], r["text"], r["times"])
    if held is not None:
        yield piece()


def _rows_of(r: dict) -> _Rows:
    rows = _Rows(r["conv_id"])
    for x in zip(r["turns"], r["roles"], r["texts"], r["times"], strict=True):
        rows.add(*x)
    return rows


def _transfers(pieces: Iterator[dict]) -> Iterator[dict]:
    """Of each piece the cheapest way from each open item to each: (start, end, cost, audit)."""
    numbers = {item: i for i, item in enumerate(_ITEMS)} | {None: -1}
    for r in pieces:
        rows = _rows_of(r)
        faults = rows.faults(set(r["firsts"] or ()))
        edges = [
            {"start": numbers[start], "end": numbers[end], "cost": cost, "audit": audit}
            for start in (None, *STARTS) for end, (cost, audit) in rows.parsed(began(start), faults).items() if end in STARTS
        ]
        known = [t for t in rows.turns if t is not None]
        ends = {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None}
        ends |= {"head": rows.roles[0][:1], "tail": rows.roles[-1][:1]} if rows.roles else {"head": None, "tail": None}
        yield {"conv_id": r["conv_id"], "part": r["part"], "place": r["place"], "edges": edges} | rows.counts(faults) | ends


class _Joined:
    """Pieces of one conversation, in order, put together. Only those stay open on whose ways the cheapest ones differ."""

    def __init__(self):
        self.ways: dict[int, tuple[int, str]] = {-1: (0, "")}  # by item: cost, and audit beyond what all ways share
        self.open: list[tuple[dict, dict[int, tuple[int, str]]]] = []  # pieces, and by item the one before and the audit between
        self.settled: list[str] = []
        self.total = dict.fromkeys(_SUMS, 0)
        self.low = self.high = self.tail = self.turn = None

    def add(self, p: dict) -> Iterator[dict]:
        """Take a piece; give the shares of those that are settled by it."""
        new: dict[int, tuple[int, str, int, str]] = {}
        for e in p["edges"]:
            if e["start"] in self.ways:
                cost, audit = self.ways[e["start"]]
                value = (cost + e["cost"], audit + e["audit"], e["start"], e["audit"])
                if e["end"] not in new or value[:2] < new[e["end"]][:2]:
                    new[e["end"]] = value
        most = min(v[0] for v in new.values()) + SLACK
        new = {k: v for k, v in new.items() if v[0] <= most}
        low, high = min(v[1] for v in new.values()), max(v[1] for v in new.values())
        shared = next((i for i in range(len(low)) if low[i] != high[i]), len(low))
        self.ways = {k: (v[0], v[1][shared:]) for k, v in new.items()}
        self.open.append(({"conv_id": p["conv_id"], "part": p["part"], "place": p["place"]}, {k: (v[2], v[3]) for k, v in new.items()}))
        self._count(p)
        items = set(self.ways)
        for i in range(len(self.open) - 1, 0, -1):
            items = {self.open[i][1][k][0] for k in items}
            if len(items) == 1:
                yield from self._settle(i, items.pop())
                break

    def _settle(self, n: int, item: int) -> Iterator[dict]:
        """The first n open pieces lie on the way that ends at item."""
        out = []
        for at, back in reversed(self.open[:n]):
            item, share = back[item]
            out.append(at | {"share": share, "state": _STATES[item]})
        del self.open[:n]
        out.reverse()
        self.settled += [x["share"] for x in out]
        yield from out

    def _count(self, p: dict) -> None:
        for c in _SUMS:
            self.total[c] += p[c]
        if p["head"] is not None:
            self.total["illegal"] += self.tail is not None and self.tail + p["head"] not in ("su", "ua", "au")
            self.tail = p["tail"]
        if p["low"] is not None:
            self.total["turns"] -= p["first_turn"] == self.turn
            self.turn = p["last_turn"]
            self.low = p["low"] if self.low is None else min(self.low, p["low"])
            self.high = p["high"] if self.high is None else max(self.high, p["high"])

    def done(self) -> Iterator[dict]:
        """The conversation's result after the last piece, and the shares still open."""
        conv = self.open[-1][0]["conv_id"]
        end = min((k for k in map(_ITEMS.index, ENDS) if k in self.ways), key=self.ways.__getitem__)
        cost = self.ways[end][0]
        yield from self._settle(len(self.open), end)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.total["turns"]
        yield {"conv_id": conv, "gaps": gaps, "cost": cost, "audit": "".join(self.settled)} | {c: self.total[c] for c in _SUMS if c != "turns"}


def _joined(pieces: Iterator[dict]) -> Iterator[dict]:
    conv, held = None, None
    for p in pieces:
        if held is not None and p["conv_id"] != conv:
            yield from held.done()
            held = None
        conv, held = p["conv_id"], held or _Joined()
        yield from held.add(p)
    if held is not None:
        yield from held.done()


def _lines(pieces: Iterator[dict]) -> Iterator[dict]:
    """Of each piece the repaired lines, null for none."""
    for r in pieces:
        rows = _rows_of(r)
        found, _ = replay(r["share"], rows.expanded(rows.roles), rows.expanded(rows.texts), r["state"])
        yield {"conv_id": r["conv_id"], "part": r["part"], "place": r["place"], "lines": "\n".join(found) if found else None}


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    """Each conversation's result, first of its rows, with the hash of the lines that follow."""
    held, sha, some = None, None, False
    for r in rows:
        if r["part"] is None:
            if held is not None:
                yield held | {"repaired_sha256": sha.hexdigest()}
            held, sha, some = {c: r[c] for c in ("conv_id", *_COUNTS, "audit")}, hashlib.sha256(), False
        elif r["lines"] is not None:
            sha.update(("\n" * some + r["lines"]).encode("utf-8", "surrogatepass"))
            some = True
    if held is not None:
        yield held | {"repaired_sha256": sha.hexdigest()}


def repaired(rows: DataFrame) -> DataFrame:
    """From rows (conv_id, turn, role, text, times) a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A row stands times times; with times 0 it only says that its conversation exists. Rows are taken by turn (nulls
    first), those of one turn by role and by the md5 of their text. Null role and text are empty. A null conv_id is a
    conversation. Faults, edits and results are those of the contract: a conversation without rows has zeros, an empty
    audit and the hash of the empty string. Other columns are not carried; an empty table gives an empty one.

    Rows are dealt by ranges of that order, equal rows too. A conversation within a range is parsed there. Others are cut
    into pieces of at most PIECE_ROWS rows, each parsed from every item a chart can begin with, and the pieces' tables
    are put together in order: so no task holds a large conversation's rows. What must be one row's is in one task: its
    audit, and its lines as they pass through the hash.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    md5 = F.md5(F.col("text"))
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("times").cast("long").alias("times"))
    keyed = slim.withColumn("_text", md5).withColumn("_copy", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "_text", "_copy"]
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_text", "_copy").withColumn("part", F.spark_partition_id().cast("long"))
    table = scratch.table(ranges.mapInArrow(_mapped(_first_pass, [*_RESULT, *_AT, *_ROWS]), f"conv_id {kind}, {_RESULT_SQL}, {_AT_SQL}, {_ROWS_SQL}"), "repairs")
    whole = table.filter("part is null").select("conv_id", *_COUNTS, "audit", "repaired_sha256")
    pieces = table.filter("part is not null").select("conv_id", "part", "place", "turns", "roles", "texts", "times")
    both = pieces.select("conv_id", "part", "place", F.explode(F.arrays_zip("roles", "texts")).alias("x"))
    key = F.md5(F.concat(F.length("x.roles").cast("string"), F.lit(":"), F.col("x.roles"), F.col("x.texts")))
    firsts = both.groupBy("conv_id", key.alias("key")).agg(F.min(F.struct("part", "place")).alias("at"))
    firsts = firsts.groupBy(F.col("at.part").alias("_part"), F.col("at.place").alias("_place")).agg(F.collect_list("key").alias("firsts"))
    parsed = pieces.join(firsts, (F.col("part") == F.col("_part")) & (F.col("place") == F.col("_place")), "left").drop("_part", "_place")
    parsed = parsed.mapInArrow(_mapped(_transfers, [*_AT, *_PIECE]), f"conv_id {kind}, {_AT_SQL}, {_PIECE_SQL}")
    fields = [*[x for x in _RESULT if x[0] != "repaired_sha256"], *_AT, ("share", pa.string()), ("state", pa.string())]
    sql = f"conv_id {kind}, " + _RESULT_SQL.replace(", repaired_sha256 string", "") + f", {_AT_SQL}, share string, state string"
    joined = scratch.table(parsed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_mapped(_joined, fields), sql), "joined")
    shares = joined.filter("part is not null").select(F.col("part").alias("_part"), F.col("place").alias("_place"), "share", "state")
    lines = pieces.join(shares, (F.col("part") == F.col("_part")) & (F.col("place") == F.col("_place"))).drop("_part", "_place")
    lines = lines.mapInArrow(_mapped(_lines, [*_AT, ("lines", pa.string())]), f"conv_id {kind}, {_AT_SQL}, lines string")
    results = joined.filter("part is null").drop("share", "state")
    passed = results.unionByName(lines, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").asc_nulls_first(), "place")
    return whole.unionByName(passed.mapInArrow(_mapped(_hashed, _RESULT), f"conv_id {kind}, {_RESULT_SQL}"))
