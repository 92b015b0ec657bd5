"""Conversation structure repair (operator 11): cheapest edits by dynamic programming over a trie of signatures.

A turn is blank, a repetition of an earlier turn of its conversation, truncated, or sound. What repair costs depends on
nothing but the initials of the roles and these faults, so each conversation becomes a signature of one letter a turn. The
distinct signatures are sorted over all tasks, which lays them out as the paths of a prefix trie; each task walks its
part of the trie with a stack of DP layers, one for each letter of the path, so a layer is worked out once for each
prefix that signatures share, and the answer is emitted where a signature ends.

A layer holds for each state of the grammar ``(s?(ua)+)?`` the least cost of getting there with all turns so far used
up, and the least of the edit strings of that cost. Strings are not kept: those that end with a used turn are
never prefixes of each other, so their order is a rank within the layer, and what may follow them are insertions only.

Roles without s, u or a as first letter (an empty role among them) fit no place of the grammar; they are given another role or deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Tables, record_batch, small_batches

#: Costs of edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
#: Where each initial leads: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
#: The turn that a user or an assistant may take in each state.
ROLE_AT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
NOT_BLANK = r"[^\x20\x09-\x0D]"
BIGGEST = 2**63 - 1


def letter(role: str, fault: int) -> str:
    """The letter of a turn in a signature."""
    return chr(ord("A") + 4 * (INITIALS.find(role[0]) if role and role[0] in INITIALS else 3) + fault)


def meaning(code: str) -> tuple[str, int]:
    """(initial, or an empty string; fault) of a letter."""
    n = ord(code) - ord("A")
    return (INITIALS + " ")[n // 4].strip(), n % 4


# A layer: for each state None or (cost, rank, insertions since the last used turn, state that turn was used in, its edits).
Layer = tuple


def _inserted(layer: list) -> Layer:
    """The layer with insertions: to state 2 from 0, 1 and 3, to state 3 from 2."""
    changed = True
    while changed:
        changed = False
        for a in range(4):
            if layer[a] is None:
                continue
            cost, rank, more, back, edits = layer[a]
            b = NEXT["a" if a == 2 else "u"][a]
            offer = (cost + INSERT, rank, more + "I", back, edits)
            if layer[b] is None or offer[:3] < layer[b][:3]:
                layer[b] = offer
                changed = True
    return tuple(layer)


FIRST = _inserted([(0, 0, "", None, ""), None, None, None])


@lru_cache(100_000)
def step(layer: Layer, code: str) -> tuple[Layer, int]:
    """The layer after one more turn, with costs counted from its least one, and that least cost.

    Few layers differ once costs are relative, so equal ones are one object.
    """
    initial, fault = meaning(code)
    stays = LEFT_TRUNCATED if fault == TRUNCATED else 0
    best: list = [None] * 4
    for a in range(4):
        if layer[a] is None:
            continue
        cost, rank, more, _, _ = layer[a]
        offers = [(a, cost + DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            offers.append((NEXT["a" if a == 2 else "u"][a], cost + REROLE + stays, "R"))
            if initial and a in NEXT[initial]:
                offers.append((NEXT[initial][a], cost + KEEP + stays, "K"))
        for b, total, edit in offers:
            offer = (total, rank, more + edit, a)
            if best[b] is None or offer[:3] < best[b][:3]:
                best[b] = offer
    order = {key: n for n, key in enumerate(sorted(x[1:3] for x in best if x))}
    low = min(x[0] for x in best if x)
    return _inserted([x and (x[0] - low, order[x[1:3]], "", x[3], x[2]) for x in best]), low


class Trie:
    """The path from the root to the signature met last: a layer and a total for each of its prefixes."""

    def __init__(self) -> None:
        self.path = ""
        self.layers: list[Layer] = [FIRST]
        self.low = [0]
        self.steps = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits); signatures come in ascending order, so neighbours share their prefixes."""
        shared = 0
        for x, y in zip(self.path, signature):
            if x != y:
                break
            shared += 1
        del self.layers[shared + 1 :], self.low[shared + 1 :]
        for code in signature[shared:]:
            layer, low = step(self.layers[-1], code)
            self.layers.append(layer)
            self.low.append(self.low[-1] + low)
            self.steps += 1
        self.path = signature
        state = min((s for s in ENDS if self.layers[-1][s]), key=lambda s: self.layers[-1][s][:3])
        cost = self.low[-1] + self.layers[-1][state][0]
        # A turn's edits begin with the insertions before it; those after the last turn come at the end.
        parts = [self.layers[-1][state][2]]
        for layer in reversed(self.layers):
            _, _, _, back, edits = layer[state]
            parts.append(edits)
            state = back
        return cost, "".join(reversed(parts))


def counts(signature: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, neighbours that are not system and user, user and assistant, assistant and user)."""
    turns = [meaning(c) for c in signature]
    faults = [f for _, f in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


_SIGNED = [("gaps", pa.int64()), ("signature", pa.string())]
_SOLVED = [("signature", pa.string()), ("_salt", pa.int32()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]
SOLVED = "signature string, _salt int, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _signed(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One signature for each conversation; the turns of one come together and in order."""
        out: list[tuple] = []
        now: tuple | None = None
        code: list[str] = []
        low = high = last = None
        distinct = 0

        def closed() -> tuple:
            gaps = 0 if low is None else min(high - low + 1 - distinct, BIGGEST)
            return (now[0], gaps, "".join(code))

        for conv, turn, role, fault in _rows(batches):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(closed())
                now, code, low, high, last, distinct = (conv,), [], None, None, None, 0
                if len(out) >= 2_000:
                    yield record_batch([("conv", id_type), *_SIGNED], out)
                    out = []
            code.append(letter(role, fault))
            if turn is not None:
                low = turn if low is None else low
                high = turn
                distinct += turn != last
                last = turn
        if now is not None:
            out.append(closed())
        if out:
            yield record_batch([("conv", id_type), *_SIGNED], out)

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in ascending order, with what they count and cost."""
    trie = Trie()
    last, found = None, ()
    for batch in batches:
        out = []
        for signature, salt in zip(*(c.to_pylist() for c in batch.columns)):
            if signature != last:
                last, found = signature, (*counts(signature), *trie.answer(signature))
            out.append((signature, salt, *found))
        yield record_batch(_SOLVED, out)


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, tie): nulls as one space."""
    space = F.lit(" ")
    named = turns.select(*(F.col(f"`{c}`").alias(n) for c, n in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))))
    filled = named.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return filled.withColumn("tie", F.md5(F.col("text").cast("binary")))


def in_order() -> list[Column]:
    """The order of a conversation's turns."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]


def audits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of a table of turns.

    Turns go by number, those without one first; equal numbers go by role and then by the digest of the text, so repeated
    rows are neighbours. A null role or text is one space; the null id is a conversation like any other. Empty texts are
    blank. Texts do not move: only their digests and faults do, whatever their length. Other columns are not read. An
    empty table gives no rows.
    """
    small_batches()
    id_type = pa.int64() if dict(turns.dtypes)[conv] in ("bigint", "int", "smallint", "tinyint") else pa.string()
    tables = Tables(turns.sparkSession)
    rows = _turns(turns, conv, turn, role, text)
    if id_type == pa.int64():
        rows = rows.withColumn("conv", F.col("conv").cast("long"))
    else:
        rows = rows.withColumn("conv", F.col("conv").cast("string"))
    ends = F.regexp_extract("text", rf"({NOT_BLANK})[\x20\x09-\x0D]*\z", 1)
    light = rows.select("conv", "turn", "role", "tie", F.when(~F.col("text").rlike(NOT_BLANK), BLANK).when(~ends.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND).alias("own"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "tie").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own"))
    # Dealt by conversation once; the window over equal turns and the order of turns both fit that.
    judged = light.repartition("conv").withColumn("fault", fault).sortWithinPartitions("conv", *in_order())
    sql_type = "long" if id_type == pa.int64() else "string"
    signed = judged.select("conv", "turn", "role", "fault").mapInArrow(_signed(id_type), f"conv {sql_type}, gaps long, signature string")
    signed = tables.keep(signed.withColumn("_salt", F.pmod(F.xxhash64("conv"), F.lit(64)).cast("int")), "signatures")
    # One signature may be that of a third of all conversations: each is there once a salt, and solved once in its task.
    paths = signed.select("signature", "_salt").distinct().repartitionByRange("signature").sortWithinPartitions("signature", "_salt")
    solved = paths.mapInArrow(_solved, SOLVED)
    return tables.keep(signed.join(solved, ["signature", "_salt"]).drop("signature", "_salt"), "audits")


_REPAIRED = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]


def _repaired(id_type: pa.DataType):
    schema = [("conv", id_type), *_REPAIRED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each conversation's audit comes first, then its turns in order."""
        out: list[tuple] = []
        audit, at, state, place, size = "", 0, 0, 0, 0
        now = None

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state, size
            out.append((now, place, edit, role, text))
            place += 1
            size += len(text)
            state = NEXT[role[0]][state]

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", ROLE_AT[state], "")
                at += 1

        for conv, first, edits, role, text in _rows(batches):
            if first:
                insertions()
                now, audit, at, state, place = conv, edits or "", 0, 0, 0
                continue
            insertions()
            edit = audit[at]
            at += 1
            if edit == "K":
                put("K", role, text)
            elif edit == "R":
                put("R", ROLE_AT[state], text)
            if len(out) >= 1_000 or size > 4_000_000:
                yield record_batch(schema, out)
                out, size = [], 0
        insertions()
        if out:
            yield record_batch(schema, out)

    return run


def repaired_turns(turns: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the turns that the audits of ``audits`` leave, in order; K kept, R with another role, I inserted.

    Texts are shuffled once, by conversation, and streamed, so a conversation of any length is held turn by turn; all turns
    of one go through one task. Rows of a conversation come together and in order.
    """
    small_batches()
    kind = dict(found.dtypes)["conv"]
    id_type = pa.int64() if kind == "bigint" else pa.string()
    rows = _turns(turns, conv, turn, role, text).withColumn("conv", F.col("conv").cast(kind))
    nothing = F.lit(None)
    heads = found.select("conv", F.lit(True).alias("first"), "audit", nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), nothing.cast("string").alias("tie"))
    bodies = rows.select("conv", F.lit(False).alias("first"), nothing.cast("string").alias("audit"), "turn", "role", "text", "tie")
    dealt = heads.union(bodies).repartition("conv").sortWithinPartitions("conv", F.col("first").desc(), *in_order())
    return dealt.select("conv", "first", "audit", "role", "text").mapInArrow(_repaired(id_type), f"conv {kind}, place long, edit string, role string, text string")


def _digests(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each conversation's lines; its rows come together and in order."""
        schema = [("conv", id_type), ("repaired_sha256", pa.string())]
        now, sha, out = None, None, []
        for conv, place, role, text in _rows(batches):
            if place == 0:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(role.encode() + b":" + text.encode())
            if len(out) >= 2_000:
                yield record_batch(schema, out)
                out = []
        if sha is not None:
            out.append((now, sha.hexdigest()))
        if out:
            yield record_batch(schema, out)

    return run


def damaged(turns: DataFrame) -> DataFrame:
    """A fifth to a quarter of all turns damaged, the same ones on every run: dropped, emptied, without sentence ends, doubled, given to the user.

    A null role, text, id or number counts as one space.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times: Column = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every damaged conversation.

    A conversation that lost all its turns has zeros, no edits and the digest of an empty string.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(turns)
    found = audits(rows)
    lines = repaired_turns(rows, found).select("conv", "place", "role", "text")
    digests = lines.mapInArrow(_digests(pa.int64()), "conv long, repaired_sha256 string")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv")), "left")
    digests = digests.withColumnRenamed("conv", "digest_of")
    out = out.join(digests, F.col("id").eqNullSafe(F.col("digest_of")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
