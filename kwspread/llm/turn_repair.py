"""Operator 11: repair of conversation structure by a grammar-compressed program.

A conversation's rows in order are a sequence of symbols: the initial of the role and the
row's first fault. The cheapest edits that give role initials `(s?(ua)+)?` are a shortest
path through four states (nothing yet, after s, after u, after a), so a symbol is a 4 x 4
matrix over (min, +) whose entries carry the edits as a rope, and a sequence is their
product. Sequences repeat each other, within and across conversations:

1. `order_rows`: rows are dealt by ranges of (conversation, order); each range gives its
   conversations as pieces of at most PIECE symbols, so no conversation is gathered.
2. Distinct symbol strings of all pieces are dealt into shards. A shard compresses its
   strings by Re-Pair (the commonest pair of symbols becomes a rule, again and again) and
   evaluates one matrix per rule, bottom-up; a string is the product of what is left.
3. Pieces take their string's matrix. A conversation folds its pieces in order with one
   entry per state; the chosen edits of each piece give the repaired rows.
4. Repaired rows meet their texts by row number and are hashed in ranges
   (`ordered.joined_sha256`).

Ties go to the least edit initials. Within one entry all edits of equal cost consume the
same rows and none is the beginning of another (it would cost less), so the least of a
product is the product of the least ones. Ropes are compared by hashes (61 bits) of equal
parts from the left.

Defined results: null roles, texts, turns and conversation ids count as one space in what
is hashed and tagged; rows without conv_id form one conversation; rows with one turn go by
role, then by a hash of role and text, repeated rows stay neighbours; conversations that
lose all rows stay with zeros; an empty table gives an empty table; other columns are
ignored. A task that folds a conversation holds a few bytes per turn of it, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwspread.llm.common import materialise
from kwspread.llm.ordered import in_ranges, joined_sha256, part

PIECE = 16_384
SHARD_SYMBOLS = 50_000
#: A table of matrices is broadcast up to this many bytes of edit strings.
BROADCAST_BYTES = 32 << 20

#: White space of the contract, ends of a whole text, costs of the edits.
BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
ROLES = ("user", "assistant")

#: Symbols of rows: roles s, u, a, other by the faults none, truncated, blank, duplicate;
#: and what they are to the program, which must delete the last two kinds.
ROWS = "ABCDEFGHIJKLMNOP"
TAGS = "suaxSUAXdddddddd"
ALPHABET = "suaxSUAXd"
LEGAL = {(0, 1), (1, 2), (2, 1)}

NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
ENTRIES = [(p, q) for p in STATES for q in STATES]


# Ropes: (length, hash, text or None, left, right).

_MOD, _BASE = (1 << 61) - 1, 911_382_323_546_127_777
_POWERS: dict[int, int] = {}
_SHORT = 24


def _power(n: int) -> int:
    if n not in _POWERS:
        _POWERS[n] = pow(_BASE, n, _MOD)
    return _POWERS[n]


def leaf(text: str) -> tuple:
    h = 0
    for c in text.encode():
        h = (h * _BASE + c + 1) % _MOD
    return len(text), h, text, None, None


EMPTY = leaf("")


def concat(a: tuple, b: tuple) -> tuple:
    if not a[0]:
        return b
    if not b[0]:
        return a
    n, h = a[0] + b[0], (a[1] * _power(b[0]) + b[1]) % _MOD
    if n <= _SHORT:
        return n, h, a[2] + b[2], None, None
    return n, h, None, a, b


def flat(rope: tuple) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if r[2] is None:
            todo += [r[4], r[3]]
        else:
            out.append(r[2])
    return "".join(out)


def before(x: tuple, y: tuple) -> bool:
    """Whether rope x sorts before rope y."""
    left, right = [x], [y]
    while left and right:
        a, b = left.pop(), right.pop()
        if a[0] == b[0] and a[1] == b[1]:
            continue
        if a[2] is None and (b[2] is not None or a[0] >= b[0]):
            left += [a[4], a[3]]
            right.append(b)
        elif b[2] is None:
            right += [b[4], b[3]]
            left.append(a)
        else:
            n = min(a[0], b[0])
            if a[2][:n] != b[2][:n]:
                return a[2][:n] < b[2][:n]
            if a[0] > n:
                left.append(leaf(a[2][n:]))
            if b[0] > n:
                right.append(leaf(b[2][n:]))
    return not left and bool(right)


# Matrices: 16 entries (cost, rope) or None.


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def multiply(a: list, b: list) -> list:
    out: list = [None] * 16
    for p in STATES:
        for k in STATES:
            if (x := a[4 * p + k]) is None:
                continue
            for q in STATES:
                if (y := b[4 * k + q]) is None:
                    continue
                now, cost = out[4 * p + q], x[0] + y[0]
                if now is None or cost <= now[0]:
                    out[4 * p + q] = better(now, (cost, concat(x[1], y[1])))
    return out


def _matrix(moves: list[tuple[int, int, int, str]]) -> list:
    out: list = [None] * 16
    for p, q, cost, audit in moves:
        out[4 * p + q] = better(out[4 * p + q], (cost, leaf(audit)))
    return out


#: Moves that a row of role s, u or a makes.
STEPS = {"s": [(NOTHING, AFTER_S)], "u": [(p, AFTER_U) for p in (NOTHING, AFTER_S, AFTER_A)], "a": [(AFTER_U, AFTER_A)], "x": []}
#: Inserted rows before a row, or at the end.
INSERTS = _matrix(
    [(p, p, 0, "") for p in STATES]
    + [(p, AFTER_U, INSERT, "I") for p in (NOTHING, AFTER_S, AFTER_A)]
    + [(p, AFTER_A, 2 * INSERT, "II") for p in (NOTHING, AFTER_S)]
    + [(AFTER_U, AFTER_A, INSERT, "I")]
)


def _symbol_matrix(tag: str) -> list:
    moves = [(p, p, DELETE, "D") for p in STATES]
    if tag != "d":
        extra = CUT if tag.isupper() else 0
        moves += [(p, q, extra, "K") for p, q in STEPS[tag.lower()]]
        moves += [(p, q, REROLE + extra, "R") for p, q in STEPS["u"] + STEPS["a"]]
    return multiply(INSERTS, _matrix(moves))


SYMBOLS = [_symbol_matrix(t) for t in ALPHABET]


# Grammar.


def re_pair(sequences: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (left, right), numbered from len(ALPHABET), and the sequences in symbols.

    A round replaces the commonest pairs whose symbols don't meet, so that they can't
    overlap and none changes another's count; of a run of one symbol every second pair."""
    gap = -1
    line = np.concatenate([x for s in sequences for x in (s, [gap])]) if sequences else np.empty(0, np.int64)
    line = line.astype(np.int64)
    rules: list[tuple[int, int]] = []
    while len(line) > 1:
        whole = (line[:-1] != gap) & (line[1:] != gap)
        codes = np.where(whole, line[:-1] << 31 | line[1:], -1)
        pairs, counts = np.unique(codes[whole], return_counts=True)
        often = counts > 1
        pairs, counts = pairs[often], counts[often]
        if not len(pairs):
            break
        chosen, used = [], set()
        for code in pairs[np.lexsort((pairs, -counts))].tolist():
            a, b = code >> 31, code & 0x7FFFFFFF
            if a not in used and b not in used:
                used |= {a, b}
                chosen.append(code)
        first = len(ALPHABET) + len(rules)
        rules += [(c >> 31, c & 0x7FFFFFFF) for c in chosen]
        told = np.array(chosen)
        order = np.argsort(told)
        at = np.minimum(np.searchsorted(told[order], codes), len(told) - 1)
        place = np.flatnonzero(told[order][at] == codes)
        head = np.ones(len(place), bool)  # runs of overlapping places: every second one
        head[1:] = place[1:] != place[:-1] + 1
        begin = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
        place = place[(place - begin) % 2 == 0]
        line[place] = first + order[at[place]]
        line = np.delete(line, place + 1)
    ends = np.flatnonzero(line == gap)
    return rules, [x[x != gap] for x in np.split(line, ends)][: len(sequences)]


def rule_matrices(rules: list[tuple[int, int]]) -> list[list]:
    """Matrices of all symbols, bottom-up."""
    out = list(SYMBOLS)
    for a, b in rules:
        out.append(multiply(out[a], out[b]))
    return out


def sequence_matrix(symbols: list[int], matrices: list[list]) -> list | None:
    """Product of a sequence, halved again and again so that ropes stay shallow."""
    now = [matrices[s] for s in symbols]
    while len(now) > 1:
        now = [multiply(now[k], now[k + 1]) if k + 1 < len(now) else now[k] for k in range(0, len(now), 2)]
    return now[0]


MATRICES = "tags string, costs array<long>, audits array<string>"
_TAG_CODE = np.full(128, -1)
_TAG_CODE[list(ALPHABET.encode())] = np.arange(len(ALPHABET))


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    tags = sorted(rows["tags"])
    rules, sequences = re_pair([_TAG_CODE[np.frombuffer(t.encode(), np.uint8)] for t in tags])
    matrices = rule_matrices(rules)
    costs, audits = [], []
    for s in sequences:
        m = sequence_matrix(s.tolist(), matrices)
        costs.append([None if e is None else e[0] for e in m])
        audits.append([None if e is None else flat(e[1]) for e in m])
    return pd.DataFrame({"tags": tags, "costs": costs, "audits": audits})


def string_matrices(pieces: DataFrame) -> DataFrame:
    """tags, costs and audits (16 entries each) of the distinct symbol strings."""
    distinct = materialise(pieces.select("tags").distinct(), "tag-strings")
    shards = max(1, (distinct.agg(F.sum(F.length("tags"))).first()[0] or 0) // SHARD_SYMBOLS)
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("tags"), F.lit(shards)))
    return materialise(dealt.groupBy("shard").applyInPandas(_shard, MATRICES), "tag-matrices")


# Rows.


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated damage; a repeated row comes twice."""
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    role, text = spaced("role"), spaced("text")
    copies = F.when(fate == 0, F.array().cast("array<int>")).when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, "".join(ENDS), "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, row, role, two hashes of role and text, symbol (0..15)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    told = rows.select(
        "conv_id", "turn", "row", "role",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64("text", F.lit(11), "role").alias("h2"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(*ENDS)).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("who"),
    )
    lead = told.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("turn", "row"))["row"].alias("row"))
    marked = told.join(lead.select("row", F.lit(True).alias("lead")), "row", "left")
    fault = F.when(F.col("blank"), 2).when(F.col("lead").isNull(), 3).when(F.col("cut"), 1).otherwise(0)
    return marked.select("conv_id", "turn", "role", "h1", "h2", "row", (fault * 4 + F.col("who")).cast("int").alias("symbol"))


PIECES = (
    "conv_id long, part long, k long, symbols string, rows array<long>, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, head int, tail int"
)


def _piece(conv, here: int, k: int, codes: np.ndarray, rows: np.ndarray, turns: np.ndarray, known: np.ndarray) -> tuple:
    fault, who = codes >> 2, codes & 3
    turns = turns[known]
    legal = np.zeros(max(len(who) - 1, 0), bool)
    for a, b in LEGAL:
        legal |= (who[:-1] == a) & (who[1:] == b)
    ends = (int(turns[0]), int(turns[-1]), 1 + int((turns[1:] != turns[:-1]).sum())) if len(turns) else (None, None, 0)
    faults = np.bincount(fault, minlength=4)
    return (
        conv, here, k, (codes + 65).astype(np.uint8).tobytes().decode(), rows, *ends,
        int(faults[2]), int(faults[3]), int(faults[1]), int((~legal).sum()), int(who[0]), int(who[-1]),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, k = part(), 0
    kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64())] + [pa.int64()] * 7 + [pa.int32()] * 2
    names = [c.split()[0] for c in PIECES.split(", ")]
    conv, held, size = None, [], 0

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def emit() -> tuple:
        nonlocal k, held, size
        k += 1
        out = _piece(conv, here, k, *(np.concatenate(x) for x in zip(*held, strict=True)))
        held, size = [], 0
        return out

    for batch in batches:
        n, done = batch.num_rows, []
        ids, turn = batch.column("conv_id"), batch.column("turn")
        known = turn.is_valid().to_numpy(zero_copy_only=False)
        turn = turn.cast(pa.int64()).fill_null(0).to_numpy()
        number, there = ids.cast(pa.int64()).fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        codes, rows = batch.column("symbol").to_numpy(), batch.column("row").to_numpy()
        heads = np.flatnonzero((number[1:] != number[:-1]) | (there[1:] != there[:-1])) + 1
        for a, b in zip([0, *heads.tolist()], [*heads.tolist(), n], strict=True):
            if a == b:
                continue
            name = int(number[a]) if there[a] else None
            if held and name != conv:
                done.append(emit())
            conv = name
            while a < b:
                to = min(b, a + PIECE - size)
                held.append((codes[a:to], rows[a:to], turn[a:to], known[a:to]))
                size, a = size + to - a, to
                if size == PIECE:
                    done.append(emit())
        yield table(done)
    if held:
        yield table([emit()])


def order_rows(rows: DataFrame) -> DataFrame:
    """Pieces of the conversations; rows have conv_id, turn, role, text and row."""
    ordered = in_ranges(_symbols(rows), ["conv_id", "turn", "role", "h1", "h2", "row"])
    pieces = ordered.select("conv_id", "turn", "row", "symbol").mapInArrow(_pieces, PIECES)
    return materialise(pieces.withColumn("tags", F.translate("symbols", ROWS, TAGS)).drop("symbols"), "pieces")


FOLDED = (
    "conv_id long, piece long, state int, edits string, tags string, rows array<long>, gaps long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, audit string"
)


class _Fold:
    """Folds the pieces of one conversation, in order."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.best: list = [(0, EMPTY), None, None, None]
        self.pieces: list[tuple] = []  # rows, and per state the best entry and its edits
        self.counts = [0, 0, 0, 0]
        self.least = self.most = self.last = None
        self.turns, self.tail = 0, None

    def add(self, r: dict) -> None:
        now: list = [None] * 4
        back: list = [None] * 4
        for p in STATES:
            if self.best[p] is None:
                continue
            for q in STATES:
                if (cost := r["costs"][4 * p + q]) is None:
                    continue
                edits = r["audits"][4 * p + q]
                entry = (self.best[p][0] + cost, concat(self.best[p][1], leaf(edits)))
                if better(now[q], entry) is entry:
                    now[q], back[q] = entry, (p, edits)
        self.best = now
        self.pieces.append(((r["tags"], r["rows"]), back))
        inner = r["illegal"] + (self.tail is not None and (self.tail, r["head"]) not in LEGAL)
        self.counts = [a + b for a, b in zip(self.counts, (r["blank"], r["duplicate"], r["truncated"], inner), strict=True)]
        self.tail = r["tail"]
        if r["turns"]:
            self.turns += r["turns"] - (self.last == r["first_turn"])
            self.least = r["first_turn"] if self.least is None else self.least
            self.last = self.most = r["last_turn"]

    def rows(self) -> list[tuple]:
        found, state, closing = None, None, ""
        for p in STATES:
            for q in (NOTHING, AFTER_A):
                if self.best[p] and (end := INSERTS[4 * p + q]):
                    whole = (self.best[p][0] + end[0], concat(self.best[p][1], end[1]))
                    if better(found, whole) is whole:
                        found, state, closing = whole, p, flat(end[1])
        chosen = []
        for own, back in reversed(self.pieces):
            state, edits = back[state]
            chosen.append((state, edits + closing, *own))
            closing = ""
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        told = (gaps, *self.counts, found[0], flat(found[1]))
        return [(self.conv, k, *c, *(told if k == 0 else [None] * 7)) for k, c in enumerate(reversed(chosen))]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64())] + [pa.int64()] * 6 + [pa.string()]
    names = [c.split()[0] for c in FOLDED.split(", ")]

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    fold = None
    for batch in batches:
        done: list[tuple] = []
        for at in range(0, batch.num_rows, 64):
            for r in batch.slice(at, 64).to_pylist():
                if fold is None or r["conv_id"] != fold.conv:
                    if fold is not None:
                        done += fold.rows()
                    fold = _Fold(r["conv_id"])
                fold.add(r)
        yield table(done)
    if fold is not None:
        yield table(fold.rows())


def fold_pieces(pieces: DataFrame) -> DataFrame:
    """Chosen edits of every piece; the first piece of a conversation has its totals."""
    matrices = string_matrices(pieces)
    size = matrices.agg(F.sum(F.length("tags") * 17 + 256)).first()[0] or 0
    joined = pieces.join(F.broadcast(matrices) if size <= BROADCAST_BYTES else matrices, "tags")
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")
    return materialise(ordered.mapInArrow(_fold, FOLDED), "folded")


EDITED = "conv_id long, piece long, at long, row long, new_role string"
_AFTER = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row of the repaired conversations: the row it was (null: inserted) and
    its new role (null: kept)."""
    kinds = [pa.int64()] * 4 + [pa.string()]
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "state", "edits", "tags", "rows")]
        for conv, piece, state, edits, tags, rows in zip(*columns, strict=True):
            n = 0
            for at, edit in enumerate(edits):
                row = role = None
                if edit != "I":
                    row, tag, n = rows[n], tags[n].lower(), n + 1
                if edit == "K":
                    state = _AFTER[tag]
                elif edit != "D":  # each state has one of the two roles that may follow
                    role, state = (ROLES[1], AFTER_A) if state == AFTER_U else (ROLES[0], AFTER_U)
                if edit != "D":
                    out.append((conv, piece, at, row, role))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "piece", "at", "row", "new_role"])


def repaired_rows(folded: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, piece, at (order), role, text of the repaired conversations."""
    edited = materialise(folded.select("conv_id", "piece", "state", "edits", "tags", "rows").mapInArrow(_edited, EDITED), "edited")
    new = edited.where("row IS NULL").select("conv_id", "piece", "at", F.col("new_role").alias("role"), F.lit("").alias("text"))
    kept = edited.where("row IS NOT NULL").join(rows.select("row", "role", "text"), "row")
    return kept.select("conv_id", "piece", "at", F.coalesce("new_role", "role").alias("role"), "text").union(new)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number each, written so that the numbers stay."""
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "turns")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals and edits (`FOLDED`), and repaired rows, of conversations (conv_id, turn,
    role, text; role and text not null)."""
    rows = numbered(rows.select("conv_id", "turn", "role", "text"))
    folded = fold_pieces(order_rows(rows))
    return folded, repaired_rows(folded, rows)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, faults, illegal, cost, audit, repaired_sha256 of every conversation
    after the stated damage."""
    folded, repaired = repair(damage(conversations))
    lines = repaired.select("conv_id", "piece", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = joined_sha256(lines, "conv_id", ["piece", "at"], "line", "\n")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    totals = folded.where("piece = 0").select("conv_id", *COUNTS, "audit")
    out = ids.join(totals, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("key")), "left")
    return out.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
