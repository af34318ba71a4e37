"""Conversations brought back into (system)? (user assistant)+ by the cheapest edits, with the edits as an audit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import ranged, stored

#: What the output so far ends in: nothing, a system row, a user row, an assistant row (complete). BEGIN is EMPTY with rows still insertable.
EMPTY, SYSTEM, USER, ASSISTANT, BEGIN = range(5)
KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that may come next, as an inserted or renamed row.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
LEGAL = {"su", "ua", "au"}
SPACE = "\t\n\x0b\x0c\r "
MOD, POINT = (1 << 61) - 1, 1_000_003


def roll(h: int, piece: str) -> int:
    for c in piece:
        h = (h * POINT + ord(c)) % MOD
    return h


class Audit:
    """A string of edits as the last link of a chain; strings that begin alike share links.

    ``up[k]`` is the link 2^k pieces back, so any prefix is found in logarithmic time, and each link keeps the rolling hash of the
    string up to it. A piece is one edit, or the edits of a whole segment; ``mark`` says where a piece comes from.
    """

    __slots__ = ("piece", "length", "hash", "up", "mark")

    def __init__(self, parent: Audit | None, piece: str, mark: object = None):
        self.piece, self.mark = piece, mark
        self.length = (parent.length if parent else 0) + len(piece)
        self.hash = roll(parent.hash if parent else 0, piece)
        self.up, at = [], parent
        while at is not None:
            self.up.append(at)
            k = len(self.up) - 1
            at = at.up[k] if k < len(at.up) else None

    def reaching(self, length: int) -> Audit:
        """The first link whose string has ``length`` letters or more."""
        at = self
        while at.up and at.up[0].length >= length:
            at = next(x for x in reversed(at.up) if x.length >= length)
        return at

    def prefix(self, length: int) -> int:
        """Hash of the first ``length`` letters."""
        at = self.reaching(length)
        if at.length == length:
            return at.hash
        start, h = (at.up[0].length, at.up[0].hash) if at.up else (0, 0)
        return roll(h, at.piece[: length - start])

    def text(self) -> str:
        return "".join(n.piece for n in self.links())

    def links(self, stop: Audit | None = None) -> list[Audit]:
        out, at = [], self
        while at is not None and at is not stop:
            out.append(at)
            at = at.up[0] if at.up else None
        return out[::-1]


def split(a: Audit, b: Audit) -> Audit | None:
    """The last link that both chains share."""
    x, y = a, b
    while x is not y:
        if x is None or y is None:
            return None
        if x.length >= y.length and x.up:
            x = x.up[0]
        elif y.up:
            y = y.up[0]
        else:
            x = x.up[0] if x.up else None
    return x


def before(a: Audit, b: Audit) -> bool:
    """Is ``a`` the lesser string? The longest common prefix is searched by hashes and, as hashes can collide, held against the letters
    beyond the last shared link; if it does not stand, the letters decide."""
    if a is b:
        return False
    low, high = 0, min(a.length, b.length)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.prefix(mid) == b.prefix(mid) else (low, mid - 1)
    shared = split(a, b)
    x, y = ("".join(n.piece for n in s.links(shared)) for s in (a, b))
    done = low - (shared.length if shared else 0)
    if done < 0 or x[:done] != y[:done]:
        return x < y
    return x[done : done + 1] < y[done : done + 1]


Cells = list[tuple[int, Audit] | None]


def best(offers: list[tuple[int, Callable[[], Audit]]]) -> tuple[int, Audit] | None:
    """The cheapest offer; of equal ones the least string. Dearer strings are never made."""
    if not offers:
        return None
    low, out = min(c for c, _ in offers), None
    for c, make in offers:
        if c == low:
            a = make()
            out = a if out is None or before(a, out) else out
    return low, out


def insert(cells: Cells) -> Cells:
    """Rows inserted here: a user row after anything complete or fresh, then an assistant row. More can never be cheaper."""
    out = list(cells)
    for to, sources in ((USER, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        offers = [(out[to][0], lambda a=out[to][1]: a)] if out[to] else []
        offers += [(out[q][0] + COST["I"], lambda a=out[q][1]: Audit(a, "I")) for q in sources if out[q]]
        out[to] = best(offers)
    return out


def advance(cells: Cells, initial: str, fault: str) -> Cells:
    """The cheapest edits for each ending after one more row: keep, rename or delete it, then insert."""
    offers: list[list] = [[], [], [], []]
    late = 1 if fault == "truncated" else 0
    for q, cell in enumerate(cells):
        if cell is None:
            continue
        cost, a = cell
        offers[q].append((cost + COST["D"], lambda a=a: Audit(a, "D")))
        if fault in ("blank", "duplicate"):
            continue
        if (q, initial) in KEEP:
            offers[KEEP[q, initial]].append((cost + late, lambda a=a: Audit(a, "K")))
        offers[NEXT[q]].append((cost + COST["R"] + late, lambda a=a: Audit(a, "R")))
    return insert([best(x) for x in offers])


def solve(rows: list[tuple[str, str]], entry: int) -> Cells:
    """The cheapest edits of ``rows`` (initial, fault) from ``entry`` to each ending."""
    cells: Cells = [None] * 4
    cells[EMPTY if entry == BEGIN else entry] = (0, Audit(None, ""))
    cells = insert(cells) if entry == BEGIN else cells
    for initial, fault in rows:
        cells = advance(cells, initial, fault)
    return cells


def chosen(cells: Cells) -> tuple[int, Audit]:
    """The better of leaving nothing and of ending in an assistant row."""
    return best([(c[0], lambda a=c[1]: a) for c in (cells[EMPTY], cells[ASSISTANT]) if c])


def fault(role: str, text: str, seen: bool) -> str:
    core = text.strip(SPACE)
    return "blank" if not core else "duplicate" if seen else "truncated" if core[-1] not in ".!?" else ""


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else " "


def edited(rows: list[dict], faults: list[str], entry: int, edits: str) -> tuple[list[dict], int]:
    """The repaired rows and their cost."""
    q, i, cost, out = EMPTY if entry == BEGIN else entry, 0, 0, []
    for e in edits:
        cost += COST[e]
        if e == "I":
            q = NEXT[q]
            out.append({"role": ROLE[q], "text": ""})
            continue
        if e != "D":
            cost += faults[i] == "truncated"
            q = KEEP[q, initial(rows[i]["role"])] if e == "K" else NEXT[q]
            out.append({"role": rows[i]["role"] if e == "K" else ROLE[q], "text": rows[i]["text"]})
        i += 1
    return out, cost


ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
ROWS_SQL = "array<struct<turn:long,role:string,text:string>>"
#: A repaired segment: counts of faults, what the neighbouring segments need, the edits and the rows after them.
OUT = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("initials", pa.string()), ("least_turn", pa.int64()), ("most_turn", pa.int64()),
       ("turns", pa.int64()), ("cost", pa.int64()), ("edits", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
OUT_SQL = "blank long, duplicate long, truncated long, illegal long, initials string, least_turn long, most_turn long, turns long, cost long, edits string, repaired array<struct<role:string,text:string>>"


def report(rows: list[dict], faults: list[str], entry: int, edits: str) -> dict:
    out, cost = edited(rows, faults, entry, edits)
    letters = [r["role"][:1] or " " for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {**{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(x + y not in LEGAL for x, y in zip(letters, letters[1:])), "initials": letters[0] + letters[-1] if rows else "",
            "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "turns": len(set(turns)), "cost": cost, "edits": edits, "repaired": out}


def faults_of(rows: list[dict], first: set[int] | None = None) -> list[str]:
    """Every row's first fault; ``first`` holds the rows whose role and text no earlier row of the conversation has."""
    seen, out = set(), []
    for i, r in enumerate(rows):
        key = (r["role"], r["text"])
        out.append(fault(*key, key in seen if first is None else i not in first))
        seen.add(key)
    return out


def segments(turns: DataFrame, most_rows: int = 4096, most_bytes: int = 8 << 20) -> DataFrame:
    """Conversations in order, cut at ``most_rows`` rows, ``most_bytes`` of text and the borders of ranges; those surely in one piece are repaired.

    ``turns`` has ``_conv, _turn, _role, _text, _gone``. Returns ``_conv, part, seg, whole``, the columns of a repaired segment (null unless whole) and ``rows`` (null if whole).
    """
    conv = turns.schema["_conv"].dataType.simpleString()
    # Equal rows may lie in either order: a running number deals even a crowd of them over the ranges.
    d = ranged(turns.withColumn("_n", F.monotonically_increasing_id()), "_conv", "_turn", "_role", "_text", "_n").select("_part", "_conv", "_turn", "_role", "_text", "_gone")
    names = ["_conv", "part", "seg", "whole", *[n for n, _ in OUT], "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"rows": [], "size": 0, "count": 0, "seg": 0, "cut": True, "part": 0, "conv": None}
        blank = object()
        state["conv"], done = blank, []

        def close(open_end: bool) -> None:
            if state["conv"] is blank:
                return
            whole = not (open_end or state["cut"])
            rows, out = state["rows"], {n: None for n, _ in OUT}
            if whole:
                faults = faults_of(rows)
                out = report(rows, faults, BEGIN, chosen(solve([(initial(r["role"]), f) for r, f in zip(rows, faults)], BEGIN))[1].text())
            done.append({"_conv": state["conv"], "part": state["part"], "seg": state["seg"], "whole": whole, **out, "rows": None if whole else rows})
            state.update(rows=[], size=0, count=0, seg=state["seg"] + 1, cut=open_end)

        def flush() -> pa.RecordBatch:
            cols = [pa.array([r["_conv"] for r in done], kind), *[pa.array([r[n] for r in done], t) for n, t in (("part", pa.int32()), ("seg", pa.int32()), ("whole", pa.bool_()), *OUT, ("rows", ROWS))]]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("_conv").type
            for part, c, turn, role, text, gone in zip(*[batch.column(n).to_pylist() for n in ("_part", "_conv", "_turn", "_role", "_text", "_gone")]):
                state["part"] = part
                if state["conv"] is blank:
                    state["conv"] = c  # the first conversation may have begun in an earlier range
                elif c != state["conv"]:
                    close(False)
                    state["conv"] = c
                elif state["count"] >= most_rows or state["size"] >= most_bytes:
                    close(True)
                if not gone:
                    state["rows"].append({"turn": turn, "role": role, "text": text})
                    state["size"] += len(text)
                state["count"] += 1
            if len(done) >= 64:
                yield flush()
        close(True)  # the last one may go on in a later range
        if done:
            yield flush()

    return stored(d.mapInArrow(run, f"_conv {conv}, part int, seg int, whole boolean, {OUT_SQL}, rows {ROWS_SQL}"), "conversation-segments")


def join_segments(cut: DataFrame) -> DataFrame:
    """Repairs the conversations that lie in several segments: each is solved for every ending the one before may have, then the best line through them is taken.

    First rows of equal role and text are found across segments by digests. A task folds a conversation's segments in order and keeps four
    strings of edits that share what they have in common.
    """
    conv = cut.schema["_conv"].dataType.simpleString()
    key = F.sha2(F.concat(F.length("r.role").cast("string"), F.lit(":"), F.col("r.role"), F.col("r.text")), 256)
    each = cut.select("_conv", "part", "seg", F.posexplode("rows").alias("at", "r")).select("_conv", F.struct("part", "seg", "at").alias("p"), key.alias("h"))
    firsts = each.groupBy("_conv", "h").agg(F.min("p").alias("p")).groupBy("p.part", "p.seg").agg(F.collect_list("p.at").alias("first"))
    told = stored(cut.select("_conv", "part", "seg", "rows").join(firsts, ["part", "seg"], "left"), "conversation-firsts")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, first in zip(batch.column("rows").to_pylist(), batch.column("first").to_pylist()):
                line = [(initial(r["role"]), f) for r, f in zip(rows, faults_of(rows, set(first or [])))]
                out.append([{"entry": e, "exit": q, "cost": c[0], "edits": c[1].text()} for e in range(5) for q, c in enumerate(solve(line, e)) if c])
            kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("_conv"), batch.column("part"), batch.column("seg"), pa.array(out, kind)], ["_conv", "part", "seg", "ways"])

    solved = told.mapInArrow(ways, f"_conv {conv}, part int, seg int, ways array<struct<entry:int,exit:int,cost:long,edits:string>>")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = object()
        at, cells = blank, []

        def line() -> pa.RecordBatch:
            marks = [(*n.mark, n.piece) for n in chosen(cells)[1].links() if n.mark]
            cols = list(zip(*marks))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["part", "seg", "entry", "edits"])

        for batch in batches:
            for c, part, seg, found in zip(*[batch.column(n).to_pylist() for n in ("_conv", "part", "seg", "ways")]):
                if at is blank or c != at:
                    if at is not blank:
                        yield line()
                    at, cells = c, None
                offers: list[list] = [[], [], [], []]
                for w in found:
                    e = w["entry"]
                    start = ((0, None) if e == BEGIN else None) if cells is None else None if e == BEGIN else cells[e]
                    if start:
                        offers[w["exit"]].append((start[0] + w["cost"], lambda a=start[1], w=w, m=(part, seg, e): Audit(a, w["edits"], m)))
                cells = [best(x) for x in offers]
        if at is not blank:
            yield line()

    lines = solved.repartition(F.col("_conv")).sortWithinPartitions("_conv", "part", "seg").mapInArrow(fold, "part int, seg int, entry int, edits string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, first, entry, edits in zip(*[batch.column(n).to_pylist() for n in ("rows", "first", "entry", "edits")]):
                out.append(report(rows, faults_of(rows, set(first or [])), entry, edits))
            cols = [batch.column(n) for n in ("_conv", "part", "seg")] + [pa.array([r[n] for r in out], t) for n, t in OUT]
            yield pa.RecordBatch.from_arrays(cols, ["_conv", "part", "seg", *[n for n, _ in OUT]])

    return told.join(lines, ["part", "seg"]).select("_conv", "part", "seg", "rows", "first", "entry", "edits").mapInArrow(finish, f"_conv {conv}, part int, seg int, {OUT_SQL}")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: str | None = None, most_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that bring every conversation into an optional system row and pairs of user and assistant rows, or into nothing.

    Keeping a row costs 0, giving it the role user or assistant 2, deleting it 3 (rows without a visible character, and those whose role and
    text an earlier row has, must go), inserting an empty user or assistant row 2; a row that stays but does not end in . ! or ? costs 1 more.
    Of equal costs the edits whose initials (K, R, D, I) spell the least string are taken.

    Returns repaired segments in two frames, one row each: conversations in one piece, and the pieces of those that several ranges share.
    Both hold ``_conv, part, seg`` (the order of a conversation's pieces), fault counts, ``edits`` and ``repaired``, the rows after the edits.

    Rows are taken by turn, nulls first, then by role and text. A null role or text is one space; null conversations are one of their own;
    repeated rows are duplicates; rows with ``gone`` true take no part but keep their conversation in the result, with no edits and no rows. Texts
    of any length are whole. A conversation of any length is cut into segments of at most ``most_rows`` rows, so none is gathered whole. Other columns are not read, so their names cannot clash; an empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    out = F.lit(False) if gone is None else F.coalesce(F.col(f"`{gone}`"), F.lit(False))
    d = turns.select(F.col(f"`{conv_col}`").alias("_conv"), F.col(f"`{turn_col}`").cast("long").alias("_turn"), space(role_col).alias("_role"), space(text_col).alias("_text"), out.alias("_gone"))
    cut = segments(d, most_rows)
    return cut.filter("whole").drop("whole", "rows"), join_segments(cut.filter("NOT whole"))


def summary(segments: DataFrame, sorted_already: bool) -> DataFrame:
    """One row a conversation: ``_conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    A task reads the segments in order and holds one at a time; the digest of a conversation is sequential by definition.
    """
    conv = segments.schema["_conv"].dataType.simpleString()
    d = segments if sorted_already else segments.repartition(F.col("_conv")).sortWithinPartitions("_conv", "part", "seg")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = object()
        at, s, out = blank, {}, []

        def end() -> None:
            out.append({"_conv": at, "gaps": s["most"] - s["least"] + 1 - s["turns"] if s["turns"] else 0, **{k: s[k] for k in sums}, "audit": "".join(s["edits"]), "repaired_sha256": s["sha"].hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if at is blank or r["_conv"] != at:
                    if at is not blank:
                        end()
                    at, s = r["_conv"], {**dict.fromkeys(sums, 0), "edits": [], "sha": hashlib.sha256(), "last": "", "least": None, "most": None, "turns": 0, "any": False}
                for k in sums:
                    s[k] += r[k]
                if r["initials"]:
                    s["illegal"] += bool(s["last"]) and s["last"] + r["initials"][0] not in LEGAL
                    s["last"] = r["initials"][1]
                if r["turns"]:
                    s["turns"] += r["turns"] - (s["most"] == r["least_turn"])
                    s["least"] = r["least_turn"] if s["least"] is None else s["least"]
                    s["most"] = r["most_turn"]
                s["edits"].append(r["edits"])
                for x in r["repaired"]:
                    s["sha"].update((("\n" if s["any"] else "") + x["role"] + ":" + x["text"]).encode("utf-8", "replace"))
                    s["any"] = True
            if len(out) >= 1024:
                yield flush(out, batch.schema.field("_conv").type)
            kind = batch.schema.field("_conv").type
        if at is not blank:
            end()
            yield flush(out, kind)

    def flush(out: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([r["_conv"] for r in out], kind), *[pa.array([r[n] for r in out], pa.int64()) for n in ("gaps", *sums)], pa.array([r["audit"] for r in out]), pa.array([r["repaired_sha256"] for r in out])]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["_conv", "gaps", *sums, "audit", "repaired_sha256"])

    return d.mapInArrow(run, f"_conv {conv}, gaps long, " + ", ".join(f"{k} long" for k in sums) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` rows damaged by the CRC of ``conv_id:turn`` (nulls: one space): dropped (``gone``), emptied, without . ! ?, doubled, or given to the user."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    d = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    d = d.withColumns({"role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")), "gone": F.col("_kind") == 0,
                       "text": F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))})
    return d.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")
