"""Related projects against a plain version of get_related_metapackages (create_schema_functions.sql:117-163)."""

import math
import random
from collections import defaultdict

from larder.plans import links


def plain_related(seed, relations, most):
    at, on = defaultdict(list), defaultdict(list)
    for e, u, w in relations:
        at[e].append((u, w))
        on[u].append(e)
    related, rounds = {seed: 1.0}, 0
    while True:
        rounds += 1
        part, incoming = defaultdict(float), defaultdict(int)
        for e, rank in related.items():
            for u, w in at[e]:
                part[u] += rank / len(related) / len(at[e]) * w
                incoming[u] += 1
        came = defaultdict(float)
        for u, p in part.items():
            if len(on[u]) != incoming[u]:
                for e in on[u]:
                    came[e] += p / (len(on[u]) - incoming[u])
        new = {e: max(related.get(e, 0.0), came.get(e, 0.0)) for e in {*related, *came}}
        new = dict(sorted(new.items(), key=lambda x: (-round(math.log2(x[1]), 9), x[0]))[:most])
        grows = sum(new.values()) > sum(related.values())
        related = new
        if not grows:
            return {e: max(0.0, 100 + 10 * math.log10(r)) for e, r in related.items()}, rounds


def against_plain(spark, relations, seeds, most):
    table = spark.createDataFrame(relations, "effname string, urlhash long, weight double")
    got = defaultdict(dict)
    for r in links.related(spark.createDataFrame([(s,) for s in seeds], "effname string"), table, most).collect():
        got[r["seed"]][r["effname"]] = r["score"]
    rounds = 0
    for s in seeds:
        expected, n = plain_related(s, relations, most)
        rounds = max(rounds, n)
        assert got[s].keys() == expected.keys()
        assert all(abs(got[s][e] - expected[e]) < 1e-6 for e in expected)
    return rounds


def test_long_chain(spark):
    chain = [(f"c{k:02}", u, 1.0) for k in range(14) for u in (k, k + 1)]
    assert against_plain(spark, chain, ["c00", "c07", "lonely"], 50) > 8


def test_hubs_and_limits(spark):
    rng = random.Random(4)
    relations = [(f"e{k}", u, rng.choice([0.25, 0.5, 1.0])) for k in range(60) for u in rng.sample(range(7), rng.randint(1, 3))]
    against_plain(spark, relations, ["e0", "e7", "e31", "e59"], 5)
