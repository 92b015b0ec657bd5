"""Operators on conversations against plain versions, on small tables with odd rows and on whole given tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import conversation_repair, conversation_trie
from larder.llm.common import salted_lookup

SMALL = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth long, node string, _salt2 long"
WORD = re.compile(r"[^\x20\x09-\x0D]")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def odd_rows():
    """Unique (conversation, turn): what to do with equal numbers is tested by itself."""
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Really?", "cut off", "", " \n", "Yes.", "a.b", "end. \t", "é.", "long " * 3000 + "."]
    out = []
    for conv in [*range(-7, 120), 10**12, 10**12 + 3]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 12, 40])):
            role = rng.choice(["system" if turn == 0 else "user", "user", "assistant", "assistant", "tool", "ulysses", "", None])
            out.append((conv, turn * rng.choice([1, 1, 1, 3]) * 50 + turn, role, rng.choice([*texts, None])))
    for conv in range(200, 230):  # copies, and a shared first turn
        out += [(conv, None, "system", "Same."), (conv, 1, "user", "Hi."), (conv, 2, "assistant", "Hello.")]
    out += [(300, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(700)]
    out += [(None, 1, "user", "No id."), (None, 2, "assistant", "Neither."), (None, None, None, None)]
    return [(*r, "x", 5, "n", 9) for r in out]


def plain_repair(rows):
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by suffix dynamic programming on whole strings."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, faults = set(), []
        for _, role, text in turns:
            last = WORD.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        moves = {"0s": 1, "0u": 2, "1u": 2, "3u": 2, "2a": 3}

        @lru_cache(None)
        def best(i, state, added, turns=tuple(turns), faults=tuple(faults)):
            """(cost, edits, repaired lines) of what is left; two insertions in a row at most are ever worth it."""
            found = []
            if i == len(turns) and state in (0, 3):
                found.append((0, "", ()))
            for name in ("user", "assistant"):
                to = moves.get(f"{state}{name[0]}")
                if to and added < 3:
                    c, e, lines = best(i, to, added + 1)
                    found.append((c + 2, "I" + e, (f"{name}:", *lines)))
            if i < len(turns):
                _, role, text = turns[i]
                c, e, lines = best(i + 1, state, 0)
                found.append((c + 3, "D" + e, lines))
                if faults[i] not in ("blank", "duplicate"):
                    extra = faults[i] == "truncated"
                    for edit, name, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                        to = moves.get(f"{state}{name[:1]}")
                        if to:
                            c, e, lines = best(i + 1, to, 0)
                            found.append((c + cost + extra, edit + e, (f"{name}:{text}", *lines)))
            return min(found) if found else (10**9, "", ())

        for i in range(len(turns), -1, -50):  # keeps recursion shallow
            for state in range(4):
                best(i, state, 0)
        cost, audit, lines = best(0, 0, 0)
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [(t[1] + "-")[0] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        n = Counter(faults)
        yield (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(lines)))


def write(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, odd_rows(), tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, [], tmp_path_factory.mktemp("empty"))


def four(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "empty", "given"])
def test_conversation_repair(spark, request, which):
    folder = SMALL if which == "given" else request.getfixturevalue(which)
    got = Counter(tuple(r) for r in conversation_repair.op11_conversation_repair(spark, folder).collect())
    assert got == Counter(plain_repair(four(spark, folder)))
    assert which == "empty" or len({r[7] for r in got}) > 5


def test_repaired_turns_fit_the_grammar(spark, odd):
    turns = spark.read.parquet(f"{odd}/conversations.parquet")
    found = conversation_repair.audits(turns)
    lines = conversation_repair.repaired_turns(turns, found).orderBy("conv", "place").collect()
    roles = defaultdict(str)
    for r in lines:
        roles[r["conv"]] += r["role"][0]
    assert lines and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())
    assert {r["edit"] for r in lines} == {"K", "R", "I"}


def test_turns_with_equal_numbers_and_repeated_rows(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 1, "assistant", "Ho."), ("a", 1, "user", "Hi."), ("b", None, "user", "x"), ("b", None, "user", "x")]
    found = {r["conv"]: r for r in conversation_repair.audits(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    # assistant, user, user by role: the assistant's turn goes or gets company, one user's is a repetition.
    assert (found["a"]["duplicate"], found["a"]["gaps"], found["b"]["duplicate"], found["b"]["truncated"]) == (1, 0, 1, 1)


def test_layers_are_shared_along_the_trie():
    trie = conversation_repair.Trie()
    letters = [conversation_repair.letter(r, f) for r in ("user", "assistant") for f in (0, 3)]
    rng = random.Random(3)
    signatures = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(400)})
    answers = [trie.answer(s) for s in signatures]
    assert answers == [conversation_repair.Trie().answer(s) for s in signatures]
    prefixes = {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    assert trie.steps == len(prefixes) < sum(map(len, signatures))


def plain_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        lender = c - (abs(c) % 5) * (1 if c > 0 else -1)
        paths[c] = tuple(turns.get(lender, [])[:h] + own[h:])
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[: d - 1]].add(p[:d])
        ends[p].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, ())
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in kids)
    for node, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        yield (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, ())), leaves[node], saved[node], sha(ids))


@pytest.mark.parametrize("which", ["odd", "empty", "given"])
def test_conversation_trie(spark, request, which):
    folder = SMALL if which == "given" else request.getfixturevalue(which)
    got = Counter(tuple(r) for r in conversation_trie.op13_conversation_trie(spark, folder).collect())
    assert got == Counter(plain_trie(four(spark, folder)))
    assert which == "empty" or max(r[1] for r in got) > 6


def test_trie_of_conversations_as_they_are(spark, odd):
    got = Counter(tuple(r) for r in conversation_trie.prefix_trie(spark.read.parquet(f"{odd}/conversations.parquet")).collect())
    assert got == Counter(plain_trie(four(spark, odd), rebuild=False)) and max(r[1] for r in got) == 700


def test_ids_of_a_node_in_several_pieces(monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 20)
    nodes = [(bytes([k]), c) for k in range(3) for c in range(-20, 30 * k)]
    schema = [("node", pa.binary()), ("conv", pa.int64())]
    pieces = [r for b in conversation_trie._joined_ids(conversation_trie.record_batch(schema, nodes[k : k + 7]) for k in range(0, len(nodes), 7)) for r in b.to_pylist()]
    assert len(pieces) > 12
    rows = [(r["node"], r["ids"]) for r in pieces]
    schema = [("node", pa.binary()), ("ids", pa.string())]
    got = [tuple(r.values()) for b in conversation_trie._hashed_ids(conversation_trie.record_batch(schema, rows[k : k + 4]) for k in range(0, len(rows), 4)) for r in b.to_pylist()]
    assert got == [(bytes([k]), sha(",".join(map(str, range(-20, 30 * k))))) for k in range(3)]


def test_salted_lookup(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    got = sorted(tuple(r) for r in salted_lookup(left, right, ["k"], F.col("id"), 8).select("id", "k", "v").collect())
    assert got == [(n, k, 3 * k) for n in range(1000) if (k := 0 if n < 900 else n) % 2 == 0]
