"""Operator 13: conversations repaired by the cheapest edits, found by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Tables, small_batches

#: Turns and bytes of text that one block holds at most; a longer conversation is repaired block by block.
TURNS, BYTES = 512, 8 << 20
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated turn that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after whole pairs, inside a pair. Initials: s, u, a, another.
START, SYSTEM, PAIRS, INSIDE = range(4)
KEEPS = ({START: SYSTEM}, {START: INSIDE, SYSTEM: INSIDE, PAIRS: INSIDE}, {INSIDE: PAIRS}, {})
#: What an inserted or re-roled turn must be in each state leads to the next one.
NEXT = {START: INSIDE, SYSTEM: INSIDE, PAIRS: INSIDE, INSIDE: PAIRS}
BEFORE = {state: [x for x, y in NEXT.items() if y == state] for state in range(4)}
#: Turns needed from each state to an end that is allowed.
TAILS = {START: b"", SYSTEM: b"II", PAIRS: b"", INSIDE: b"I"}
#: A turn's code: its initial, CUT if it is truncated, or GONE if it has to be deleted.
CUT, GONE = 4, 8


def ways(code: int) -> list[tuple[int, int, int, bytes]]:
    """(state, next state, cost, letter) of every edit that uses up a turn."""
    out = [(q, q, DELETE, b"D") for q in range(4)]
    if code < GONE:
        more = TRUNCATED if code & CUT else 0
        out += [(q, to, more, b"K") for q, to in KEEPS[code & 3].items()]
        out += [(q, to, REROLE + more, b"R") for q, to in NEXT.items()]
    return out


FORTH = [[[(to, cost, letter) for q, to, cost, letter in ways(code) if q == state] for state in range(4)] for code in range(GONE + 1)]
BACK = [[[(q, cost, letter) for q, to, cost, letter in ways(code) if to == state] for state in range(4)] for code in range(GONE + 1)]


def search(codes: bytes, start: int, goals: tuple[int, ...], tail: bool) -> tuple[int, bytes] | None:
    """(cost, audit) of the cheapest edits from the state ``start`` before the turns to one of ``goals`` after them, of
    equal costs the least audit. Without ``tail`` nothing is inserted after the last turn.

    Two heaps, one from either end, settle nodes (turns used up, state) in order of cost; an edge whose ends are settled
    from both sides is a crossing. When the heaps' least costs together exceed the best crossing, every crossing of that cost
    has been seen. Of two audits of one cost to one node neither begins or ends with the other (the rest would be free
    insertions), so the least audit of each half gives the least whole one."""
    n = len(codes)
    ahead: dict[tuple[int, int], tuple[int, bytes]] = {}
    behind: dict[tuple[int, int], tuple[int, bytes]] = {}
    front, rear = [(0, 0, b"", start)], [(0, -n, b"", q) for q in goals]
    best: tuple[int, bytes] | None = None
    if not n and start in goals:
        best = (0, b"")
    while front or rear:
        low, high = front[0][0] if front else 0, rear[0][0] if rear else 0
        if best and low + high > best[0]:
            break
        if front and (not rear or (low, len(ahead)) <= (high, len(behind))):
            cost, i, audit, q = heappop(front)
            if (i, q) in ahead:
                continue
            ahead[i, q] = cost, audit
            steps = [(i + 1, *x) for x in FORTH[codes[i]][q]] if i < n else []
            if i < n or tail:
                steps.append((i, NEXT[q], INSERT, b"I"))
            for j, to, more, letter in steps:
                if (other := behind.get((j, to))) is not None:
                    whole = cost + more + other[0], audit + letter + other[1]
                    best = whole if best is None or whole < best else best
                if (j, to) not in ahead:
                    heappush(front, (cost + more, j, audit + letter, to))
        else:
            cost, i, audit, q = heappop(rear)
            i = -i
            if (i, q) in behind:
                continue
            behind[i, q] = cost, audit
            steps = [(i - 1, *x) for x in BACK[codes[i - 1]][q]] if i else []
            if i < n or tail:
                steps += [(i, x, INSERT, b"I") for x in BEFORE[q]]
            for j, by, more, letter in steps:
                if (other := ahead.get((j, by))) is not None:
                    whole = other[0] + more + cost, other[1] + letter + audit
                    best = whole if best is None or whole < best else best
                if (j, by) not in behind:
                    heappush(rear, (cost + more, -j, letter + audit, by))
    return best


def routes(codes: bytes) -> list[int]:
    """For every state before and after a block: 16 costs (-1: there is no way), then 16 places of the audits among those
    from the same state. Audits that begin in one state and use up the same turns differ before either ends."""
    costs, places = [], []
    for start in range(4):
        found = [search(codes, start, (goal,), False) for goal in range(4)]
        order = sorted(x[1] for x in found if x)
        costs += [x[0] if x else -1 for x in found]
        places += [order.index(x[1]) if x else -1 for x in found]
    return costs + places


def chain(blocks: list[list[int]]) -> list[tuple[int, int]]:
    """The state before and after each block on the cheapest way through all, the least audit deciding between equal ones."""
    rest = {q: len(tail) * INSERT for q, tail in TAILS.items()}
    steps = []
    for block in reversed(blocks):
        least = {}
        for start in range(4):
            open_ = [(block[4 * start + q] + rest[q], block[16 + 4 * start + q], q) for q in rest if block[4 * start + q] >= 0]
            if open_:
                least[start] = min(open_)
        steps.append({start: x[2] for start, x in least.items()})
        rest = {start: x[0] for start, x in least.items()}
    state, out = START, []
    for step in reversed(steps):
        out.append((state, step[state]))
        state = step[state]
    return out


def apply(audit: bytes, codes: bytes, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    i, said, told = 0, [], []
    for letter in audit.decode():
        if letter == "D":
            i += 1
            continue
        said.append(roles[i] if letter == "K" else "assistant" if state == INSIDE else "user")
        told.append("" if letter == "I" else texts[i])
        state = KEEPS[codes[i] & 3][state] if letter == "K" else NEXT[state]
        i += letter != "I"
    return said, told


def extra(codes: bytes, audit: bytes) -> int:
    """What an audit costs."""
    i, cost = 0, 0
    for letter in audit.decode():
        cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[letter]
        if letter != "I":
            cost += TRUNCATED if letter != "D" and codes[i] & CUT else 0
            i += 1
    return cost


class Block:
    """Turns of one conversation that follow each other, and what is counted over them."""

    def __init__(self):
        self.roles, self.texts, self.codes, self.size = [], [], bytearray(), 0
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.turns += 1
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
        bare = text.strip(SPACE)
        cut = bool(bare) and not seen and bare[-1] not in ".!?"
        self.blank += not bare
        self.duplicate += bool(bare) and seen
        self.truncated += cut
        initial = "sua".find(role[:1]) if role else 3
        self.codes.append(GONE if not bare or seen else (3 if initial < 0 else initial) | CUT * cut)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)


PIECE = (
    "part int, no long, whole boolean, low long, high long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>, codes binary, routes array<int>"
)


ARROW = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32())]


def pieces_of(rows: DataFrame, id_col: str) -> DataFrame:
    """Blocks of the sorted rows (conversation, turn_, role_, text_, key_, mark_). A block that is a whole conversation is repaired
    at once; one whose conversation may go on elsewhere gets the costs of all ways through it."""
    schema = T.StructType([rows.schema[id_col], *T._parse_datatype_string(PIECE)])

    def run(batches):
        part, no = TaskContext.get().partitionId(), 0
        block, conv, alone, mark, marked = None, None, False, None, False
        arrow = None

        def closed(whole: bool):
            nonlocal no
            codes = bytes(block.codes)
            cost, audit = search(codes, START, (START, PAIRS), True) if whole else (None, None)
            roles, texts = apply(audit, codes, block.roles, block.texts) if whole else (block.roles, block.texts)
            values = (part, no, whole, block.low, block.high, block.turns, block.roles[0][:1], block.roles[-1][:1], block.blank, block.duplicate, block.truncated, block.illegal)
            values += (cost, audit.decode() if whole else None, roles, texts, None if whole else codes, None if whole else routes(codes))
            no += 1
            return (conv, *values)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), [arrow, *ARROW], strict=True)], names=schema.names)

        out, held = [], 0
        for batch in batches:
            arrow = batch.schema.field(0).type
            for own, turn, role, text, key, sign in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if block is None or own != conv:
                    if block is not None:
                        out.append(closed(alone))
                        held += block.size
                    alone = block is not None  # the first conversation may have begun in the partition before
                    block, conv, mark = Block(), own, None
                if sign:
                    mark, marked = (turn, role, key), sign == -2
                    continue
                if len(block.roles) >= TURNS or block.roles and block.size + len(text) > BYTES:
                    out.append(closed(False))
                    held += block.size
                    block, alone = Block(), False
                seen = mark == (turn, role, key)
                block.add(turn, role, text, seen and marked)
                marked = marked or seen
                if len(out) >= 1000 or held > BYTES:
                    yield batch_of(out)
                    out, held = [], 0
        if block is not None and block.roles:
            out.append(closed(False))
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, schema)


def chosen_routes(split: DataFrame, id_col: str) -> DataFrame:
    """(part, no, enter, leave, final): how the cheapest way goes through each block. A task takes some 100 bytes a block of a conversation."""

    def run(batches):
        conv, held, begun = None, [], False

        def done():
            ways_ = chain([x[2] for x in held])
            last = len(held) - 1
            return [(part, no, a, z, i == last) for i, ((part, no, _), (a, z)) in enumerate(zip(held, ways_, strict=True))]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["part", "no", "enter", "leave", "final"])

        for batch in batches:
            for own, *block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if begun and own != conv:
                    yield batch_of(done())
                    held = []
                conv, begun = own, True
                held.append(block)
        if held:
            yield batch_of(done())

    ordered = split.select(id_col, "part", "no", "routes").repartition(id_col).sortWithinPartitions(id_col, "part", "no")
    return ordered.mapInArrow(run, "part int, no long, enter int, leave int, final boolean")


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations of ``turns`` in pieces: (id, part, no, whole, .., cost, audit, roles, texts), in order of part
    and no; a conversation of up to TURNS turns is mostly one piece (whole). ``repaired_turns`` and ``conversation_audits`` read them.

    A conversation's turns are taken in order of turn (nulls first), then role, then a hash of the text. The first fault of
    a turn counts: blank; duplicate, if role and text were seen earlier; truncated, if the last visible character ends no
    sentence. Edits keep (K), re-role (R), delete (D, required for blank and duplicate turns) or insert (I) turns until the
    roles' initials are nothing or pairs of user and assistant after at most one system turn; the cheapest edits win, of
    equal ones the least audit.

    Rows are dealt by ranges of (id, turn), so a conversation of any length is spread over tasks; its blocks are searched
    from each state to each, and only 32 numbers a block meet in one task to choose the way through. Equal turns are counted on
    hashes before that, so texts are shuffled once.

    A null role or text counts as one space; an empty role has no initial. A null id is a conversation of its own. Repeated rows
    are duplicates of each other. Only the named columns are read. An empty table gives an empty result."""
    spark = turns.sparkSession
    tables = Tables(spark)
    small_batches(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col), F.col(turn_col).cast("long").alias("turn_"), space(role_col).alias("role_"), space(text_col).alias("text_"))
    rows = rows.withColumn("key_", F.unhex(F.md5("text_")))
    facts = rows.drop("text_")
    place = F.struct(F.col("turn_").isNotNull(), "turn_")
    again = facts.groupBy(id_col, "role_", "key_").agg(F.count("*").alias("n"), F.min(place).alias("at")).where("n > 1").select(F.col(id_col).alias("id2_"), F.col("role_").alias("role2_"), F.col("key_").alias("key2_"), F.col("at.turn_").alias("first_"))
    seen = facts.join(again, facts[id_col].eqNullSafe(F.col("id2_")) & (F.col("role_") == F.col("role2_")) & (F.col("key_") == F.col("key2_")))
    # one mark before the equal rows of a turn: -2 if all are duplicates, -1 if the first is not
    marks = seen.select(id_col, "turn_", "role_", F.lit("").alias("text_"), "key_", F.when(F.col("turn_").eqNullSafe(F.col("first_")), -1).otherwise(-2).alias("mark_")).distinct()
    both = rows.withColumn("mark_", F.lit(0)).unionByName(marks)
    order = [id_col, "turn_", "role_", "key_"]
    ordered = both.repartitionByRange(*order).sortWithinPartitions(*order, "mark_")
    pieces = tables.write(pieces_of(ordered, id_col), "pieces")

    def mend(batches):
        for batch in batches:
            lists = [batch.column(x).to_pylist() for x in ("codes", "roles", "texts", "enter", "leave", "final")]
            costs, audits, roles, texts = [], [], [], []
            for codes, said, told, enter, leave, final in zip(*lists, strict=True):
                audit = search(codes, enter, (leave,), False)[1] + (TAILS[leave] if final else b"")
                out = apply(audit, codes, said, told, enter)
                for x, y in zip((costs, audits, roles, texts), (extra(codes, audit), audit.decode(), *out), strict=True):
                    x.append(y)
            changed = {"cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string()), "roles": pa.array(roles, pa.list_(pa.string())), "texts": pa.array(texts, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([changed.get(x, None) if x in changed else batch.column(x) for x in kept], names=kept)

    kept = [x for x in pieces.columns if x not in ("codes", "routes")]
    split = pieces.where("not whole")
    mended = split.join(chosen_routes(split, id_col), ["part", "no"]).mapInArrow(mend, pieces.select(*kept).schema)
    return pieces.where("whole").select(*kept).unionByName(tables.write(mended, "mended"))


def repaired_turns(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, part, no, place, role, text): the turns after the repair, in order of part, no and place."""
    return pieces.select(id_col, "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x")).select(id_col, "part", "no", "place", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def conversation_audits(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``pieces``.

    The hash is that of the repaired ``role:text`` lines; gaps are the missing numbers between the least and greatest turn
    (null turns aside). Pieces of a conversation are hashed one after the other, so no task holds more than one."""
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    lines = F.array_join(F.zip_with("roles", "texts", lambda a, b: F.concat(a, F.lit(":"), b)), "\n")
    one = pieces.where("whole").select(id_col, gaps, *COUNTS[1:], "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    names = one.columns

    def run(batches):
        conv, begun = None, False
        hashed, audit, counts, turns, low, high, last, some = None, [], [], 0, None, None, "", False

        def done(arrow):
            gap = 0 if low is None else high - low + 1 - turns
            values = [[conv], [gap], *([x] for x in counts), ["".join(audit)], [hashed.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, [arrow, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            lists = [batch.column(x).to_pylist() for x in columns]
            for own, a, z, n, first, end, *each, told, roles, texts in zip(*lists, strict=True):
                if not begun or own != conv:
                    if begun:
                        yield done(arrow)
                    conv, begun, hashed, audit, counts, turns, low, high, last, some = own, True, hashlib.sha256(), [], [0] * 5, 0, None, None, None, False
                turns += n - (a is not None and a == high)
                low, high = a if low is None else low, high if z is None else z
                counts = [x + y for x, y in zip(counts, each, strict=True)]
                counts[3] += last is not None and last + first not in ("su", "ua", "au")
                last = end
                audit.append(told)
                for role, text in zip(roles, texts, strict=True):
                    hashed.update(("\n" * some + role + ":" + text).encode())
                    some = True
        if begun:
            yield done(arrow)

    columns = [id_col, "low", "high", "turns", "first", "last", *COUNTS[1:], "audit", "roles", "texts"]
    several = pieces.where("not whole").repartition(id_col).sortWithinPartitions(id_col, "part", "no").select(*columns, "part", "no")
    return one.unionByName(several.mapInArrow(run, one.schema))
