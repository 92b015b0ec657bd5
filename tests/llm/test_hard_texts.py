"""Very long and repetitive texts, clashing column names, and plain versions of single steps."""

import random
from collections import Counter
from math import exp, log

import numpy as np
import pytest

from larder.llm import decontaminate, language_id, near_duplicates, secret_scan, token_lengths
from larder.llm.common import Tables

MILLION = 1_000_000
LONG = {
    "spaces": " " * MILLION + "a",
    "feeds": "b" + "\n" * MILLION,
    "dashes": "a" + "-" * MILLION + "1b",
    "one word": "word " * 200_000,
    "glued": "a-----1" * 140_000,
    "keys": "kT9fQ2xL7vB4nM8zR3wY6cJ1/" * 20_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts(name):
    text = LONG[name]
    base, spans = secret_scan.all_spans(text)
    assert base == [] and (len(spans) > 0) == (name == "keys")
    assert token_lengths.n_tokens(token_lengths.encoding(token_lengths.default_ranks()), text) > 0
    index = decontaminate.Index([(1, "-" * 200), (2, "word " * 50), (3, "a-----1" * 30), (4, "=+")])
    assert {i for i, *_ in index.find(text)} == {"dashes": {1}, "one word": {2}, "glued": {3}}.get(name, set())


@pytest.mark.parametrize("text", [" " * 20_000 + "a", "b" + " " * 20_000 + "1", "b\n" + "\n" * 20_000 + "1 " + "\t" * 11_000, " " * 15_000, "x" + " " * 12_000 + "\ny" + " " * 9_999 + "z", "a" + " \n　" * 5_000 + "'s", "a" + "\x1c" * 12_000 + "b", "no runs  here"])
def test_white_space_counts(text):
    encoder = token_lengths.encoding(token_lengths.default_ranks())
    assert token_lengths.n_tokens(encoder, text) == len(encoder.encode_ordinary(text))


def test_context_limits(spark):
    n = [0, 3, 3, 7, 20, 20, 50]
    hist = spark.createDataFrame(list(Counter(n).items()), "n_tokens long, n_docs long")
    summed = token_lengths.limits(hist)
    wanted = [-0, 1, 3, 6, 7, 49, 50, 99]
    expected = [(x, sum(v > x for v in n), sum(min(v, x) for v in n), sum(max(0, v - x) for v in n)) for x in wanted]
    assert sorted(tuple(r) for r in token_lengths.at_limits(summed, wanted).collect()) == expected
    quantiles = [0.0, 0.3, 0.5, 6 / 7, 1.0]
    expected = [(q, min(x for x in n if sum(v <= x for v in n) >= q * len(n) - 1e-9)) for q in quantiles]
    assert [tuple(r) for r in token_lengths.lengths_at(summed, quantiles).collect()] == expected
    assert [tuple(r) for r in token_lengths.at_limits(summed.limit(0), [5]).collect()] == [(5, 0, 0, 0)]


def test_allow_list():
    kind = lambda text: [(a, b) for a, _, b in secret_scan.entropy_spans(text)]
    secret = "kT9fQ2xL7vB4nM8zR3wY6cJ1"
    assert kind(f"x sample_key={secret} y") == [(13, 37)]
    assert kind(f"/usr/share/{secret}") == [(11, 35)]
    assert kind("see xkqzvbnmwrtplkjhgfds") == [(4, 24)]
    for clean in ("/usr/local/lib/python3/site-packages/numpy/core", "550e8400-e29b-41d4-a716-446655440000", "getElementsByTagNameFromDocument", "Donaudampfschifffahrtsgesellschaft", "A" * 60, "2024-01-02/2024-03-04_12-30", "0123456789abcdef" * 3, "abcdef-ghijkl-mnopqr-stuvwx-123456"):
        assert kind(clean) == []
    assert secret_scan.redact_text(f"my_key={secret} end") == "my_key=[SECRET] end"


def test_spans_against_windows():
    """Every entropy span begins and ends inside a candidate, and every hot window of an unexplained piece lies in one."""
    from math import log2

    rng = random.Random(4)
    for _ in range(60):
        piece = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rng.randint(20, 50)))
        text = f"words {piece} words"
        spans = secret_scan.entropy_spans(text)
        kind = 3 if all(c in "0123456789abcdefABCDEF" for c in piece) else 4
        least = secret_scan.CLASSES[kind - 3][2]
        hot = set()
        for i in range(len(piece) - secret_scan.WINDOW + 1):
            c = Counter(piece[i : i + secret_scan.WINDOW])
            if -sum(v / secret_scan.WINDOW * log2(v / secret_scan.WINDOW) for v in c.values()) >= least - 1e-9:
                hot |= set(range(6 + i, 6 + i + secret_scan.WINDOW))
        if secret_scan.explained(piece):
            hot = set()
        assert {p for a, _, b in spans for p in range(a, b)} == hot


def test_split_search_equals_whole_search(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(20)]
    index = decontaminate.Index(items)
    for _ in range(4):
        parts = []
        for _ in range(40):
            parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(5, 80))))
            item, at = rng.choice(items)[1], rng.randrange(60)
            parts.append(item[:at] + "zz"[: rng.randint(0, 2)] + item[at:])
        text = " ".join(parts)
        monkeypatch.setattr(decontaminate, "MOST_SHARED", 10**9)
        whole = index.find(text)
        monkeypatch.setattr(decontaminate, "MOST_SHARED", 200)
        assert index.find(text) == whole and whole


@pytest.mark.parametrize("unit", ["a", "ab", "klm ", "the quick brown fox jumps nows ", "-=- " * 9])
def test_repeats_are_found_on_both_sides_of_the_switch(monkeypatch, unit):
    """What repeats is searched over a few periods beyond the switch and as it stands below it."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["kite", "lamp", "moss", "nut"]) for _ in range(n))
    item = (unit * 40)[: max(30, len(unit) - 1)].strip()
    index = decontaminate.Index([(1, item), (2, prose(12)), (3, (unit * 90)[:87].strip() + "x")])
    for text in (prose(9) + " " + unit * 400 + prose(9), unit * 300 + "Z " + unit * 301, prose(3) + " " + unit * 500 + "x " + prose(4) + unit * 300):
        monkeypatch.setattr(decontaminate, "MOST_SHARED", 10**9)
        whole = index.find(text)
        monkeypatch.setattr(decontaminate, "MOST_SHARED", 100)
        parts = index.find(text)
        monkeypatch.undo()
        assert whole and [f[0] for f in parts] == [f[0] for f in whole]
        assert [f for f in parts if f[3] == 0] == [f for f in whole if f[3] == 0]
        # Which of several alignments with edits is reported depends on the text around; all lie within the edits allowed.
        budget = decontaminate.edit_budget(87)
        assert all(abs(p - w) <= budget for x, y in zip(parts, whole) for p, w in zip(x[1:], y[1:]))


def test_every_repeat_is_a_finding():
    index = decontaminate.Index([(1, "the quick brown fox jumps nows")])
    for n in (1_000, 60_000):
        assert len(index.find("the quick brown fox jumps nows " * n)) == n


def test_many_items_with_one_gram(monkeypatch):
    """Shared places of one text and many items are looked at a part of the benchmark at a time."""
    rng = random.Random(6)
    noise = lambda: "".join(rng.choice("klmnopqrstuvw ") for _ in range(40)).strip()
    items = [(k, f"{noise()} all terms and conditions apply {noise()}") for k in range(500)]
    index = decontaminate.Index(items)
    text = "of these all terms and conditions apply " * 3 + items[17][1] + " and all terms and conditions apply"
    whole = index.find(text)
    monkeypatch.setattr(decontaminate, "MOST_SHARED", 1_000)
    assert index.find(text) == whole and [(f[0], f[3]) for f in whole] == [(17, 0)]


def test_one_edit_in_short_items():
    rng = random.Random(8)
    for size in range(16, 30):
        item = "".join(rng.choice("klmnopqrstuvw") for _ in range(size))
        index = decontaminate.Index([(5, item)])
        assert index.find(f"abc {item} def")
        for k in range(1, size - 1):
            edited = item[:k] + "X" + item[k + 1 :]
            assert bool(index.find(f"abc {edited} def")) == (size >= decontaminate.SHORTEST_ITEM)


def plain_edits(pattern: str, text: str) -> int:
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        above, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d))
    return min(row)


def test_search_against_edit_distance():
    """A text is reported exactly if a segment of the item occurs in it within the segment's edits."""
    rng = random.Random(12)
    item = "".join(rng.choice("abcdefgh ") for _ in range(90)).replace("  ", "xy").strip()
    index = decontaminate.Index([(7, item)])
    segments = [(index.codes[a:z].astype("<u4").tobytes().decode("utf-32-le"), int(e)) for (_, a, z), e in zip(index.segments, index.budget)]
    seen = Counter()
    for _ in range(120):
        start = rng.randrange(len(item))
        part = list(item[start : start + rng.randint(20, 90)])
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(part))
            part[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        text = "pre " + "".join(part) + " post"
        text = " ".join(text.split())
        expected = any(plain_edits(s, text) <= e for s, e in segments)
        assert bool(index.find(text)) == expected
        seen[expected] += 1
    assert min(seen.values()) > 10


def test_language_model_against_plain_version():
    settings = language_id.Settings(orders=(1, 2), bits=9, epochs=2, calibration=3)
    rng = random.Random(2)
    make = {"a": "abcde ", "b": "cdefg ", "c": "fghij "}
    samples = [("".join(rng.choice(make[x]) for _ in range(30)), x) for _ in range(8) for x in "abc"]
    idf = np.linspace(0.5, 2, settings.buckets)
    model = language_id.train(samples, idf, settings)

    def vector(text):
        bucket, _ = language_id.features([text], settings)
        assert len(bucket) == 2 * len(text) + 3  # one space before and after; single letters and pairs
        return {int(k): v / len(bucket) * idf[k] for k, v in Counter(bucket.tolist()).items()} | {settings.buckets: 0.05}

    fit, held = language_id.split(samples, settings)
    assert Counter(x for _, x in held) == {"a": 2, "b": 2, "c": 2} and len(fit) == 18
    z, n = Counter(), Counter()

    def weight(i, y):
        if abs(z[i, y]) <= settings.l1:
            return 0.0
        sign = 1 if z[i, y] > 0 else -1
        return (sign * settings.l1 - z[i, y]) / ((settings.beta + n[i, y] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for text, lang in fit:
            x = vector(text)
            w = {(i, y): weight(i, y) for i in x for y in range(3)}
            score = [sum(x[i] * w[i, y] for i in x) for y in range(3)]
            total = sum(map(exp, score))
            for y in range(3):
                p = exp(score[y]) / total - ("abc"[y] == lang)
                for i in x:
                    g = x[i] * p * language_id.SCALE
                    z[i, y] += g - ((n[i, y] + g * g) ** 0.5 - n[i, y] ** 0.5) / settings.alpha * w[i, y]
                    n[i, y] += g * g
    plain = np.array([[weight(i, y) for y in range(3)] for i in range(settings.buckets)])
    assert np.allclose(model.weights, plain, atol=1e-9)

    logits = model.logits([t for t, _ in held])
    truth = ["abc".index(x) for _, x in held]
    loss = lambda t: -sum(log(max(1e-12, exp(r[y] / t) / sum(exp(v / t) for v in r))) for r, y in zip(logits, truth))
    assert loss(model.temperature) <= min(loss(exp(k / 10)) for k in range(-39, 40)) + 1e-3
    lang, score = model.predict(["abcab", "ghij"])
    assert lang == ["a", "c"] and all(0 <= s <= 1 for s in score)


def test_language_sample_is_bounded(spark):
    settings = language_id.Settings(sample=5, text_chars=50, sample_chars=400)
    rows = [(k, ("x" if k % 2 else "yz") * (k * 7 % 300), "pq"[k % 2], 1, "n") for k in range(300)] + [(7, "x" * 49, "q", 1, "n")] * 40
    docs = spark.createDataFrame(rows, "_id long, _text string, _lang string, _order long, n string")
    found = language_id.sample(docs, {"p": 150, "q": 190}, settings)
    assert Counter(x for _, x in found) == {"p": 5, "q": 5} or sum(len(t) for t, _ in found) > 400 - 2 * 50
    assert all(len(t) <= 50 for t, _ in found) and sum(len(t) for t, _ in found) <= 400


def test_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four five six", "en", "a", 1, 2, "x", True, "y"), (2, "one two three four five six", "en", "b", 1, 2, "x", True, "y"), (None, None, None, "c", None, None, None, None, None)],
        "doc_id long, text string, lang string, row string, _key long, _row long, key string, worded boolean, _language string",
    )
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == ["a", "c"]
    known = language_id.keep_identified(docs, least_score=0.0)
    assert known.columns == docs.columns
    assert secret_scan.redact(docs).columns == docs.columns


def test_look_alikes_meet_over_rare_shingles(spark):
    """Buckets of many texts that share most of their words but are no near duplicates, and some pairs that are."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    frame = [word() for _ in range(100)]
    texts = []
    for k in range(60):
        mine = list(frame)
        at = rng.randrange(0, 70)
        mine[at : at + 25] = [word() for _ in range(25)]
        texts.append(mine)
        if k % 6 == 0:
            twin = list(mine)
            twin[rng.randrange(100)] = word()
            texts.append(twin)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(96)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = list(range(len(sets)))
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert found == dict(enumerate(least))


def test_tables_are_removed(spark):
    import glob

    tables = Tables(spark)
    a = tables.keep(spark.range(5), "a")
    b = tables.keep(a.groupBy().count(), "b")
    assert len(glob.glob(tables.folder + "/*")) == 2
    tables.drop_all_but(b)
    assert [x.rpartition("-")[2] for x in glob.glob(tables.folder + "/*")] == ["b.parquet"] and b.first()["count"] == 5
    tables.remove()
    assert not glob.glob(tables.folder + "*")


def test_long_ranges_of_equal_rows(spark, monkeypatch):
    from larder.llm import feistel_shards

    monkeypatch.setattr(feistel_shards, "RANGE", 7)
    rows = [(1, "same")] * 50 + [(None, None)] * 15 + [(k, f"text {k}") for k in range(20)]
    out = feistel_shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    places = sorted((r["slot"], r["shard"]) for r in out)
    assert places == [divmod(k, 6) for k in range(len(rows))]
    assert [feistel_shards.bucket_digits(n) for n in (0, 4096 * 10**6, 10**11, 10**15)] == [3, 3, 5, 5]


def test_license_regions_against_plain_version(spark):
    """Labels and scores of whole texts, with words put in, left out and changed, against a plain count of votes."""
    from larder.llm import license_scan, license_texts

    rng = random.Random(3)
    table = [("mine", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("other", "one two three four five six seven eight"), ("tiny", "a b"), (None, "x y z"), ("mine", None)]
    texts = []
    for _ in range(60):
        words = [rng.choice("alpha beta one two filler words here".split()) for _ in range(rng.randint(0, 8))]
        for _, text in rng.sample(table[:2], rng.randint(0, 2)):
            part = text.split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(part))
                part[at : at + rng.randint(0, 1)] = ["extra"] * rng.randint(0, 2)
            words += part + [rng.choice(["filler", "words"]) for _ in range(rng.randint(0, 15))]
        texts.append(" ".join(words))

    def plain(text):
        words, found = license_scan.words_of(text), []
        for label, template in table[:2]:
            parts = template.split()
            votes = sorted({(p - t, t) for p in range(len(words) - 2) for t in range(len(parts) - 2) if words[p : p + 3] == parts[t : t + 3]})
            regions = []
            for d, t in votes:
                if regions and d - regions[-1][-1][0] <= license_scan.NEAR:
                    regions[-1].append((d, t))
                else:
                    regions.append([(d, t)])
            for r in regions:
                share = len({x for _, t in r for x in (t, t + 1, t + 2)}) / len(parts)
                span = max(d + t for d, t in r) + 2 - min(d + t for d, t in r) + 1
                if share >= license_scan.LEAST_COVERED and span <= max(len(parts) * license_scan.MOST_STRETCH, len(parts) + license_scan.NEAR):
                    found.append((label, share))
        return ",".join(sorted({x for x, _ in found})), max((s for _, s in found), default=0.0)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(table, "label string, text string")
    out = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.scan(docs, templates=known).collect()}
    expected = {k: (a, round(s, 9)) for k, (a, s) in ((k, plain(t)) for k, t in enumerate(texts))}
    assert out == expected and len({a for a, _ in expected.values()}) > 2
    whole = spark.createDataFrame([(k, f"Copyright (c) 2020 Somebody\n\n{t}\n") for k, (_, t) in enumerate(license_texts.WHOLE)], "doc_id long, text string")
    out = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(whole).collect()}
    assert all(label in out[k] for k, (label, _) in enumerate(license_texts.WHOLE))


def test_verdict_against_plain_repeats():
    from larder.llm import repetition

    rng = random.Random(5)
    texts = ["", "a", "a b c d e f " * 30]
    for _ in range(25):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("0123456789") for _ in range(rng.randint(0, 70))]
        if words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(3, 20)]
        texts.append(" ".join(words))
    for text, row in zip(texts, repetition.measure(texts)):
        words = text.split()
        n = len(words)
        longest, covered = 0, set()
        for a in range(n):
            best = 0
            for b in range(n):
                k = 0
                while a != b and a + k < n and b + k < n and words[a + k] == words[b + k]:
                    k += 1
                best = max(best, k)
            longest = max(longest, best)
            if best >= repetition.MIN_REPEAT:
                covered |= set(range(a, a + best))
        failed, kept, fraction, found = row[5:]
        assert (found, round(fraction, 9)) == (longest, round(len(covered) / n if n else 0.0, 9))
        assert kept == (not failed and fraction <= repetition.MOST_COVERED and longest <= repetition.LONGEST_REPEAT)


def test_repeats_over_the_seam_of_blocks(spark):
    """A passage that lies over the border of two blocks of windows, and long periodic and random texts."""
    from larder.llm import repeated_bytes
    from test_operators import plain_repeats, same

    rng = random.Random(7)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = noise(420)
    long = list(noise(repeated_bytes.BLOCK + 90_000))
    at = repeated_bytes.BLOCK - 210
    long[at : at + 420] = passage
    long = "".join(long)
    texts = [long, "x" + passage + noise(500), noise(60_000) + long[1000:1300], "abc" * 400]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    expected = plain_repeats([t.encode() for t in texts], repeated_bytes.WINDOW)
    assert expected[0][1] == 420 + 300 and expected[0][2] == 2
    same(repeated_bytes.remove_repeats(docs, with_bytes=False), [(k, *x) for k, x in enumerate(expected)])
