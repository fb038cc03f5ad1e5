"""Repair of conversations' turn structure by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``. Reading turns from left to right an automaton of four states (nothing yet,
system, user, assistant) knows the next role; a turn is kept, given that role or deleted, and empty turns may be inserted. Costs forward
from the start and backward from the end, one number per state, meet in the middle; the state of an optimal crossing is fixed and both
halves are solved alike, so the space is linear and no table of all turns and states is kept.

Among optimal edits the one whose initials are least in ASCII is taken. Inserts count with the turn after them, so no forward string is a prefix of
another's, and their order needs no strings: a forward vector carries each state's rank beside its cost. A turn, and any run of turns, is a pair of
4 x 4 tables (cost and rank per entry and exit state) that compose.

Scale: turns are numbered by range partitions and cut into blocks of ``block`` places, so a conversation of any length is many blocks. Blocks of the
few conversations with more than one become tables, blocks of blocks likewise, until each conversation is one; crossings then go down
again level by level. Equal turns are counted before they are shuffled, first occurrences are found by grouped minima joined on the turn's own number, and only the
digest of a repaired text, serial by its nature, is read by one task per conversation, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.ordering import numbered
from ledgerfold.session import lean, materialize

#: Nothing yet, system, user, assistant; which role comes next; what it costs to end there by inserts.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
CLOSING = np.array([0, 4, 2, 0])
FINAL = -1
ROLES = ("", "system", "user", "assistant")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: A turn's class: its initial (other, s, u, a) and whether it is cut off, or that it must go.
GONE = 8
CLASSES = 9
FAR = 1 << 40
BLOCK = 1024
_BLANK = r"[^\x20\x09-\x0D]"


def _turn(kind: int, entry: int) -> dict[int, tuple[int, str]]:
    """The cheapest, then least edits of a turn of class ``kind`` from state ``entry``, by exit state."""
    best: dict[int, tuple[int, str]] = {}
    state, cost, edits = entry, 0, ""
    for _ in range(3):
        ways = [(state, DELETE, "D")]
        if kind != GONE:
            initial, late = kind % 4, CUT * (kind // 4)
            ways.append((NEXT[state], REROLE + late, "R"))
            if initial == NEXT[state] or (initial == SYSTEM and state == START):
                ways.append((initial, KEEP + late, "K"))
        for to, price, letter in ways:
            best[to] = min(best.get(to, (FAR, "")), (cost + price, edits + letter))
        state, cost, edits = NEXT[state], cost + INSERT, edits + "I"
    return best


def _tables() -> tuple[np.ndarray, np.ndarray, list[str]]:
    costs, ranks = np.full((CLASSES, 4, 4), FAR, np.int64), np.zeros((CLASSES, 4, 4), np.int64)
    edits = [""] * (CLASSES * 16)
    for kind, entry in product(range(CLASSES), range(4)):
        found = _turn(kind, entry)
        order = sorted(range(4), key=lambda x: (x not in found, found.get(x, (0, ""))[1]))
        for rank, x in enumerate(order):
            ranks[kind, entry, x] = rank
            if x in found:
                costs[kind, entry, x] = found[x][0]
                edits[(kind * 4 + entry) * 4 + x] = found[x][1]
    return costs, ranks, edits


COSTS, RANKS, EDITS = _tables()


def _forward(cost: np.ndarray, rank: np.ndarray, step: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (n, 4) behind one element each, whose tables are ``step`` and ``order`` (n, 4, 4)."""
    keys = (cost[:, :, None] + step) * 4 + rank[:, :, None]
    source = keys.argmin(1)
    rows = np.arange(len(cost))[:, None]
    new = keys[rows, source, np.arange(4)] >> 2
    tie = np.where(new >= FAR, 16, 0) + rank[rows, source] * 4 + order[rows, source, np.arange(4)]
    return np.minimum(new, FAR), tie.argsort(1, kind="stable").argsort(1, kind="stable")


def _entered(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cost = np.full((len(states), 4), FAR, np.int64)
    cost[np.arange(len(states)), states] = 0
    return cost, np.tile(np.arange(4), (len(states), 1))


def summaries(starts: np.ndarray, costs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables of whole runs of elements; run i has the elements ``starts[i]`` to ``starts[i + 1]``."""
    n = len(starts) - 1
    cost, rank = _entered(np.tile(np.arange(4), n))
    sizes = np.diff(starts)
    for k in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > k)
        at = np.repeat(starts[live] + k, 4)
        rows = (live[:, None] * 4 + np.arange(4)).ravel()
        cost[rows], rank[rows] = _forward(cost[rows], rank[rows], costs[at], ranks[at])
    return cost.reshape(n, 4, 4), rank.reshape(n, 4, 4)


def crossings(starts: np.ndarray, costs: np.ndarray, ranks: np.ndarray, entry: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """The state before each element and, at the last place, behind each run, of the least optimal edits from ``entry`` to ``exit_``.

    All runs are halved together: forward vectors of left halves and backward vectors of right halves meet in the middle, the crossing
    with the least sum, then the least rank, is kept, and both halves are halved again.
    Run i's states lie at ``starts[i] + i`` to ``starts[i + 1] + i``.
    """
    n = len(starts) - 1
    states = np.full(int(starts[-1]) + n, START, np.int64)
    shift = np.arange(n)
    lo, hi, off = starts[:-1].copy(), starts[1:].copy(), shift
    states[lo + off] = entry
    # the exit of a run that may end anywhere is the end whose closing inserts are cheapest; ties go to the least forward string
    free = exit_ == FINAL
    target = np.where(free[:, None], CLOSING, np.where(np.arange(4) == exit_[:, None], 0, FAR))
    whole = np.flatnonzero(hi > lo)
    lo, hi, off, target = lo[whole], hi[whole], off[whole], target[whole]
    states[starts[1:] + shift] = np.where(starts[1:] > starts[:-1], FINAL, entry)
    while len(lo):
        mid = np.where(hi - lo > 1, (lo + hi) // 2, hi)
        cost, rank = _entered(states[lo + off])
        for k in range(int((mid - lo).max())):
            live = np.flatnonzero(lo + k < mid)
            at = lo[live] + k
            cost[live], rank[live] = _forward(cost[live], rank[live], costs[at], ranks[at])
        back = target.copy()
        for k in range(int((hi - mid).max())):
            live = np.flatnonzero(hi - 1 - k >= mid)
            back[live] = np.minimum((costs[hi[live] - 1 - k] + back[live][:, None, :]).min(2), FAR)
        states[mid + off] = (np.minimum(cost + back, FAR) * 4 + rank).argmin(1)
        more = np.flatnonzero(hi - lo > 1)
        one = np.arange(4) == states[(mid + off)[more]][:, None]
        left, right = (lo[more], mid[more], off[more], np.where(one, 0, FAR)), (mid[more], hi[more], off[more], target[more])
        lo, hi, off, target = (np.concatenate(x) for x in zip(left, right))
    return states


def _rows(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), (np.concatenate(lists.to_list()) if len(lists) else np.zeros(0)).astype(np.int64)


def _tabled(level: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and rank tables of elements: of turns by their class, of blocks as they come."""
    if level == 0:
        return COSTS[values], RANKS[values]
    both = values.reshape(-1, 2, 4, 4)
    return both[:, 0], both[:, 1]


def _summary(level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            starts, values = _rows(b["elements"])
            cost, rank = summaries(starts if level == 0 else starts // 32, *_tabled(level, values))
            b["elements"] = list(np.stack([cost, rank], 1).reshape(len(b), 32))
            yield b

    return run


def _solve(level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            starts, values = _rows(b.pop("elements"))
            starts = starts if level == 0 else starts // 32
            entry, exit_ = b.pop("entry").to_numpy(np.int64), b.pop("exit").to_numpy(np.int64)
            states = crossings(starts, *_tabled(level, values), entry, exit_)
            ends = exit_ == FINAL
            b["states"] = [states[starts[i] + i : starts[i + 1] + i + 1] for i in range(len(b))]
            b["ends"] = ends
            yield b

    return run


def _digits(level: int) -> Column:
    """The elements of a block in order: the classes of turns, or tables one after another."""
    row = F.sort_array(F.collect_list(F.struct("at", "element")))
    return F.transform(row, lambda x: x["element"]) if level == 0 else F.flatten(F.transform(row, lambda x: x["element"]))


def _states(turns: DataFrame, block: int) -> DataFrame:
    """(conv, pos, entry, exit, ends) of each turn (conv, pos, kind): the states around it, and whether it is the conversation's last."""
    tile = lambda c: F.floor(F.col(c) / block).cast("long")
    level, found = 0, turns.select("conv", F.col("pos").alias("at"), F.col("kind").cast("long").alias("element"))
    levels = []
    while True:
        blocks = materialize(found.groupBy("conv", tile("at").alias("tile")).agg(_digits(level).alias("elements"), F.min("at").alias("first")))
        levels.append(blocks)
        several = blocks.groupBy("conv").count().where(F.col("count") > 1).select("conv")
        if level and not several.limit(1).count():
            break
        again = blocks.join(several.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")
        shape = f"conv {dict(turns.dtypes)['conv']}, at long, element array<long>"
        part = again.select("conv", F.col("tile").alias("at"), F.col("elements").alias("element"))
        done = part.withColumnRenamed("element", "elements").mapInPandas(_summary(level), shape.replace("element ", "elements "))
        found = done.withColumnRenamed("elements", "element")
        level += 1
    ends = [F.lit(START).alias("entry"), F.lit(FINAL).alias("exit")]
    given = None
    for level in range(len(levels) - 1, -1, -1):
        blocks = levels[level]
        if given is None:
            ready = blocks.select("*", *ends)
        else:  # blocks of conversations solved above have their states from there, the others are whole
            up = given.select(F.col("conv").alias("_conv"), F.col("at").alias("_tile"), F.col("entry"), F.when(F.col("ends"), FINAL).otherwise(F.col("exit")).alias("exit"))
            joined = blocks.join(up, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("tile") == F.col("_tile")), "left")
            ready = joined.select("conv", "tile", "elements", "first", F.coalesce("entry", ends[0]).alias("entry"), F.coalesce("exit", ends[1]).alias("exit"))
        schema = f"conv {dict(turns.dtypes)['conv']}, first long, states array<long>, ends boolean"
        solved = ready.select("conv", "first", "elements", "entry", "exit").mapInPandas(_solve(level), schema)
        steps = F.transform(F.expr("slice(states, 1, size(states) - 1)"), lambda x, i: F.struct(i.alias("i"), x.alias("entry"), F.element_at("states", i + 2).alias("exit")))
        each = solved.select("conv", "first", F.size("states").alias("n"), "ends", F.inline(steps))
        given = materialize(each.select("conv", (F.col("first") + F.col("i")).alias("at"), "entry", "exit", (F.col("ends") & (F.col("i") == F.col("n") - 2)).alias("ends")))
    return given.withColumnRenamed("at", "pos")


def repair_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edits of each turn of ``rows`` (conv_id, turn, role, text): (conv_id, pos, turn, copies, fault, edits, cost, illegal, new_turn, lines).

    Turns stand in the order of ``pos``: by turn (null first), role and a hash of the text, equal rows counted once with their
    ``copies``. ``fault`` is blank, duplicate, truncated or null; the copies after the first are duplicates, or blank. ``edits`` has an initial per edit
    of the turn and of inserts around it, ``cost`` their sum, ``lines`` the repaired ``role:text`` lines (null if none), ``illegal`` how many neighbours up to
    this turn break the order, ``new_turn`` whether its turn differs from the one before. Null conversations are one conversation, null roles and texts
    count as one blank, texts of any length stay in Spark, other columns are left out, an empty table gives an empty result.
    """
    lean(rows.sparkSession)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    counted = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
    counted = counted.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = counted.withColumn("said", F.sha2(F.to_binary("text", F.lit("utf-8")), 256))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "said")]
    placed = materialize(numbered(keyed, order, "pos").withColumn("pos", F.col("pos") - 1))

    last = F.regexp_extract("text", rf"(?s)({_BLANK})[\x20\x09-\x0D]*\z", 1)
    initial = F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).otherwise(0)
    thin = placed.select("conv", "pos", "turn", "copies", initial.alias("initial"), "role", "said", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    firsts = thin.groupBy("conv", "role", "said").agg(F.min("pos").alias("first")).select("first")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    kind = F.when(F.col("blank") | F.col("first").isNull(), GONE).otherwise(F.col("initial") + 4 * F.col("cut").cast("int"))
    # a join to the place before, on numbers, instead of a window per conversation
    before = thin.select((F.col("pos") + 1).alias("_pos"), F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("initial").alias("_initial"))
    same = F.col("_pos").isNotNull() & F.col("conv").eqNullSafe(F.col("_conv"))
    pair = (F.col("_initial") * 4 + F.col("initial")).isin(SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER)
    turns = thin.join(firsts, F.col("pos") == F.col("first"), "left").join(before, F.col("pos") == F.col("_pos"), "left").select(
        "conv", "pos", "copies", fault.alias("fault"), kind.alias("kind"),
        ((same & ~pair).cast("long") + F.col("copies") - 1).alias("illegal"), (F.col("turn").isNotNull() & ~(same & F.col("turn").eqNullSafe(F.col("_turn")))).alias("new_turn"),
    )
    turns = materialize(turns)
    states = _states(turns, block)

    own = F.element_at(F.array(*map(F.lit, EDITS)), (F.col("kind") * 16 + F.col("entry") * 4 + F.col("exit") + 1).cast("int"))
    cost = F.element_at(F.array(*(F.lit(int(c)) for c in COSTS.ravel())), (F.col("kind") * 16 + F.col("entry") * 4 + F.col("exit") + 1).cast("int"))
    closing = F.when(F.col("ends"), F.element_at(F.array(*(F.lit(int(c) // INSERT) for c in CLOSING)), F.col("exit").cast("int") + 1)).otherwise(0)
    after = (F.col("copies") - 1).cast("int")
    row = states.drop("conv").join(turns, "pos").withColumn("own", own).withColumn("closing", closing).select(
        "pos", "copies", "fault", "illegal", "new_turn", "own", "entry", "exit",
        F.concat("own", F.repeat(F.lit("D"), after), F.repeat(F.lit("I"), F.col("closing"))).alias("edits"),
        (cost + DELETE * after + INSERT * F.col("closing")).cast("long").alias("cost"), "closing",
    )
    name = lambda state: F.element_at(F.array(*map(F.lit, ROLES)), (state + 1).cast("int"))
    after_state = lambda state: F.element_at(F.array(*map(F.lit, NEXT)), (state + 1).cast("int"))
    said = lambda role: F.concat(role, F.lit(":"))
    inserted = F.length(F.regexp_replace("own", "[^I]", ""))
    one, two = after_state(F.col("entry")), after_state(after_state(F.col("entry")))
    lines = F.concat_ws(
        "\n",
        F.when(inserted > 0, said(name(one))), F.when(inserted > 1, said(name(two))),
        F.when(F.col("own").endswith("K"), F.concat(said(F.col("role")), "text")).when(F.col("own").endswith("R"), F.concat(said(name(F.col("exit"))), "text")),
        F.when(F.col("closing") > 0, said(name(after_state(F.col("exit"))))), F.when(F.col("closing") > 1, said(name(after_state(after_state(F.col("exit")))))),
    )
    some = F.col("edits").rlike("[^D]")
    out = placed.select("pos", F.col("conv").alias("conv_id"), "turn", "role", "text").join(row, "pos")
    return out.select("conv_id", "pos", "turn", "copies", "fault", "edits", "cost", "illegal", "new_turn", F.when(some, lines).alias("lines"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's joined pieces and its joined edits; pieces come sorted, and a conversation's are read one by one."""
    at, sha, audit, begun = None, None, [], False
    done: list[tuple] = []
    for b in batches:
        for conv, lines, edits in zip(b["conv_id"].astype(object).where(b["conv_id"].notna(), None), b["lines"], b["edits"]):
            if sha is None or conv != at:
                if sha is not None:
                    done.append((at, "".join(audit), sha.hexdigest()))
                at, sha, audit, begun = conv, hashlib.sha256(), [], False
            if lines is not None:
                sha.update((("\n" if begun else "") + lines).encode("utf-8", "surrogatepass"))
                begun = True
            audit.append(edits)
        yield pd.DataFrame(done, columns=["conv_id", "audit", "repaired_sha256"])
        done = []
    if sha is not None:
        yield pd.DataFrame([(at, "".join(audit), sha.hexdigest())], columns=["conv_id", "audit", "repaired_sha256"])


def conversation_reports(turns: DataFrame, block: int = BLOCK, piece: int = 1 << 20) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``repair_turns``' rows.

    Lines are joined in pieces of up to ``piece`` bytes before a task reads a conversation's pieces in order, as a stream.
    """
    turns = materialize(turns)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce(F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.sum(F.col("new_turn").cast("long")), F.lit(0))
    held = F.col("copies")
    count = lambda name: F.sum(F.when(F.col("fault") == name, held).otherwise(0)).alias(name)
    again = F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", held).otherwise(held - 1)).alias("duplicate")
    cut = F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated")
    sums = turns.groupBy("conv_id").agg(gaps.alias("gaps"), count("blank"), again, cut, F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    tile = F.floor(F.col("pos") / block).alias("tile")
    ahead = Window.partitionBy("conv_id", "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # ``block`` rows at most
    size = F.coalesce(F.sum(F.length("lines")).over(ahead), F.lit(0))
    cuts = turns.select("conv_id", "pos", "lines", "edits", tile).withColumn("part", F.floor(size / piece))
    row = F.sort_array(F.collect_list(F.struct("pos", "lines", "edits")))
    pieces = cuts.groupBy("conv_id", "tile", "part").agg(row.alias("row"))
    said = F.filter(F.transform("row", lambda r: r["lines"]), lambda x: x.isNotNull())
    pieces = pieces.select("conv_id", "tile", "part", F.when(F.size(said) > 0, F.array_join(said, "\n")).alias("lines"), F.array_join(F.transform("row", lambda r: r["edits"]), "").alias("edits"))
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "tile", "part").select("conv_id", "lines", "edits")
    digests = dealt.mapInPandas(_digest, f"conv_id {dict(turns.dtypes)['conv_id']}, audit string, repaired_sha256 string")
    both = sums.join(digests.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return both.select("conv_id", F.expr("try_cast(gaps AS BIGINT)").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that a checksum of conversation and turn chooses; nulls read as one blank."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "utf-8")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(fate == 4, "user").otherwise(spaced("role"))
    times = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time"))
    return out.drop("_time")


def repair_conversations(rows: DataFrame, originals: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One report row per conversation of ``originals`` (default ``rows``); one without rows has zeros, no edits and the digest of nothing."""
    named = (rows if originals is None else originals).select(F.col("conv_id").alias("_id")).distinct()
    found = conversation_reports(repair_turns(rows, block), block)
    out = named.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
