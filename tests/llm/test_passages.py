"""Passage dedup against a plain version, on small tables with odd rows and on a whole given table."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larder.llm import repeated_passages as rp

SCHEMA = "doc_id long, text string, rank long, k1 string, row string, spans long"


def plain(rows):
    first: dict[tuple, float] = {}
    split = [(r[0], float("inf") if r[0] is None else r[0], [w for w in (r[1] or "").encode().split()]) for r in rows]
    for _, rank, words in split:
        for n in range(len(words) - 49):
            key = tuple(words[n : n + 50])
            first[key] = min(first.get(key, rank), rank)
    for doc_id, rank, words in split:
        gone = set()
        for n in range(len(words) - 49):
            if first[tuple(words[n : n + 50])] < rank:
                gone.update(range(n, n + 50))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        yield (doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())


def odd_rows():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, line = prose(60), prose(13)
    texts = [None, "", " \n\x0b", "one", " ".join(prose(49)), " ".join(prose(50)), "x " * 500, "x " * 300, "a b " * 200]
    texts += [" ".join(prose(rng.randint(0, 200)) + passage + prose(rng.randint(0, 200))) for _ in range(40)]
    texts += ["\n".join(prose(30) + passage[k:] + prose(30)) for k in (5, 10, 11, 12)]  # 50 words and a little less of it
    texts += [" ".join(prose(20) + line + prose(20) + line + prose(20)) for _ in range(40)]  # shorter than a window
    base = prose(400)
    for _ in range(20):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(400)] = rng.choice(vocab)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 3 + ["\t".join(base)] + [" ".join(prose(20) + prose(60) * 1 + passage * 3)]
    texts += [" ".join(prose(3_000) + base + prose(2_000)), "日本語 x y " * 60, "日本語 x y " * 70]
    rng.shuffle(texts)
    out = list(enumerate(texts))
    out += [(None, " ".join(base)), (None, " ".join(base)), (None, None), (3, " ".join(passage)), (3, " ".join(passage)), (-5, " ".join(passage[:55] + prose(9)))]
    return [(i, t, 1, "k", "r", 2) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("group", [rp.GROUP, 10, 1])
def test_passages(spark, docs, monkeypatch, group):
    monkeypatch.setattr(rp, "GROUP", group)
    got = Counter(tuple(r) for r in rp.remove_passages(docs).collect())
    assert got == Counter(plain(odd_rows()))
    assert sum(r[2] > 0 for r in got) > 50


def test_grams_do_not_depend_on_blocks(monkeypatch):
    words = np.random.default_rng(1).integers(0, 40, 5_000).astype(np.uint64)

    def of_windows(size):
        return [(g, at - n) for g, at, lo, hi in zip(*rp.anchored(words, size)) for n in range(lo, hi + 1)]

    for size in rp.GRAMS[:-1]:
        whole = of_windows(size)
        monkeypatch.setattr(rp, "BLOCK", 64)
        assert of_windows(size) == whole and len(whole) == 5_000 - 49
        monkeypatch.undo()


def test_trees_hand_over_whole_groups(monkeypatch):
    monkeypatch.setattr(rp, "TOGETHER", 3)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 9, 90).astype(np.uint64)
    spans = [(key, n, 0, rank, 7, base[n % 5 : n % 5 + 60].tobytes(), key, 0) for key in range(4) for n, rank in enumerate(rng.integers(0, 30, 12).tolist())]
    batches = [rp.record_batch(rp._WORK, spans[k : k + 5]) for k in range(0, len(spans), 5)]
    got = {(r["g"], r["s1"], n) for b in rp._trees(iter(batches)) for r in b.to_pylist() for n in range(r["a"] - 7, r["b"] - 6)}
    ranks: dict = {}
    for g, _, _, rank, _, raw, _, _ in spans:
        for n in range(11):
            ranks.setdefault((g, raw[8 * n : 8 * n + 400]), set()).add(rank)
    wanted = {(s[0], s[1], n) for s in spans for n in range(11) if min(ranks[s[0], s[5][8 * n : 8 * n + 400]]) < s[3]}
    assert got == wanted and wanted


def test_empty_table(spark):
    out = rp.remove_passages(spark.createDataFrame([], SCHEMA), with_text=False)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.collect() == []


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in rp.op12_passage_dedup(spark, "/root/testdata/sf0.01").collect())
    assert got == Counter(r[:4] for r in plain(rows)) and any(r[2] for r in got)
