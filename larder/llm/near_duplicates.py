"""MinHash near-dedup (operator 9) with sequential Bayesian verification.

Documents are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.75.

1. Equal texts are one class. Each class gets a MinHash signature and band keys.
2. In each bucket of equal band keys, every member is paired with one leader: as many pairs as members.
3. Pairs are compared by their signatures, a batch of hashes at a time; a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls under ``MISS``.
4. Survivors are confirmed on their full shingle sets, and confirmed links joined into components.
5. Members of one bucket that are still in different components have not all met. Shingles that only one of
   these members has bound what it can share with any other, which settles most members alone. The rest are
   first paired with the member of their bucket that has fewest such shingles; then those outside the bucket's
   largest component meet the members of other components over rare shingles that two sets above the threshold
   must share, and only pairs that pass a look at longer one-bit signatures, by the same posterior, go on to
   step 4. Afterwards every pair that shares a bucket was compared, is ruled out or is connected, so no link
   between candidates is lost, and a group of many copies of each other never expands into its pairs.

Between steps tables are written to the shared folder, so that no step depends on a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import Tables, documents, give_back, per_text, small_batches, whole_row

SHINGLE = 5
#: A text without this has no words.
WORD = r"[^\x20\x09-\x0D]"
#: 100 * intersection >= PERCENT * union links two documents.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the posterior probability of a link below which a pair is dropped.
BATCH, MISS = 16, 1e-6
#: Hashes of which one bit each is kept for the first look at a pair.
BITS = 1024

_rng = np.random.default_rng(20240229)
FLIPS = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
FACTORS = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
BIT_FLIPS = _rng.integers(0, 2**64, BITS, dtype=np.uint64)[:, None]
BIT_FACTORS = _rng.integers(0, 2**64, BITS, dtype=np.uint64)[:, None] | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a task keeps; beyond it the table starts anew, which changes no result.
CACHED_WORDS = 50_000
#: Characters of texts that are worked on together.
CHUNK = 300_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of 64-bit shingle hashes of texts."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingle hashes of each text in ascending order, one text after the other, and their number."""
        import xxhash

        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known = self.words
        split = [t.encode().lower().split() for t in texts]  # bytes: A-Z only, and the six white-space characters
        for w in set().union(*split) - known.keys():
            known[w] = xxhash.xxh3_64_intdigest(w)
        n = np.array([len(w) for w in split], np.int64)
        flat = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(n.sum()))
        owner = np.repeat(np.arange(len(texts)), n)
        m = len(flat) - SHINGLE + 1
        parts, owners = [], []
        if m > 0:
            h = flat[:m].copy()
            for k in range(1, SHINGLE):
                h = h * STEP + flat[k : k + m]
            whole = owner[:m] == owner[SHINGLE - 1 :]
            parts.append(mixed(h[whole]))
            owners.append(owner[:m][whole])
        short = [k for k, ws in enumerate(split) if 0 < len(ws) < SHINGLE]
        if short:  # the whole sequence is the one shingle
            parts.append(np.array([xxhash.xxh3_64_intdigest(b"\n".join(split[k]), seed=len(split[k])) for k in short], np.uint64))
            owners.append(np.array(short, np.int64))
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        who = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((h, who))
        h, who = h[order], who[order]
        if len(h):
            first = np.append(True, (h[1:] != h[:-1]) | (who[1:] != who[:-1]))
            h, who = h[first], who[first]
        return h, np.bincount(who, minlength=len(texts))


def bits_of(h: np.ndarray) -> np.ndarray:
    """One bit of each of BITS minima over a set of shingle hashes, packed into 64-bit numbers."""
    some = max(1, min(BITS, 500_000 // len(h)))
    least = np.concatenate([((h ^ BIT_FLIPS[k : k + some]) * BIT_FACTORS[k : k + some]).min(1) for k in range(0, BITS, some)])
    return np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8")


def signatures(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and 16 bits of each minimum (texts x HASHES) of texts with a shingle at least."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    least = np.stack([np.minimum.reduceat((h ^ x) * a, starts) for x, a in zip(FLIPS, FACTORS)], 1)
    keys = np.repeat((np.arange(BANDS, dtype=np.uint64) * STEP)[None], len(sizes), 0)
    for r in range(ROWS):
        keys = mixed(keys * STEP + least[:, r::ROWS])
    return keys.view(np.int64), (mixed(least) & np.uint64(0xFFFF)).astype("<u2")


SIGNED = T.StructType([T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def _sign():
    shingler = Shingler()

    def work(texts: list[str]) -> list[tuple]:
        h, n = shingler.sets(texts)
        some = np.flatnonzero(n)
        rows: list[tuple] = [(0, [], b"")] * len(texts)
        if len(some):
            bands, sig = signatures(h, n[some])
            for k, b, s in zip(some.tolist(), bands, sig):
                rows[k] = (int(n[k]), b, s.tobytes())
        return rows

    return work


def fewest_equal(n: int, share: float, miss: float = MISS) -> int:
    """The fewest equal hashes of n with which hashes may still be equal with probability ``share``.

    With a uniform prior and m of n hashes equal that probability has a Beta(m + 1, n - m + 1) posterior.
    """
    grid = np.linspace(share, 1, 2001)[:-1]
    for m in range(n + 1):
        log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
        if float(np.exp(log).sum() * (grid[1] - grid[0])) >= miss:
            break
    return m


def least_matches() -> list[int]:
    """For each number of batches, the fewest equal hashes with which a pair may still reach the threshold."""
    return [fewest_equal(n, PERCENT / 100) for n in range(BATCH, HASHES + 1, BATCH)]


def look_alike(x: str, y: str) -> Column:
    """Whether the bits of two sets agree in enough places; unequal hashes agree in every other bit."""
    odd = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(BITS // 64)]
    return reduce(lambda a, b: a + b, odd) <= BITS - fewest_equal(BITS, (1 + PERCENT / 100) / 2)


SKETCHED = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])


def _sketch():
    shingler = Shingler()

    def work(texts: list[str]) -> list[tuple]:
        h, n = shingler.sets(texts)
        return [(x.view(np.int64), bits_of(x)) if len(x) else ([], []) for x in np.split(h, np.cumsum(n)[:-1])]

    return work


@F.pandas_udf(T.BooleanType())
def may_be_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the signatures of each pair pass every batch."""
    bounds = least_matches()
    alive = np.ones(len(a), bool)
    if len(a):
        x = np.frombuffer(b"".join(a), "<u2").reshape(len(a), HASHES)
        y = np.frombuffer(b"".join(b), "<u2").reshape(len(a), HASHES)
        equal = np.zeros(len(a), np.int64)
        for k, least in enumerate(bounds):
            at = np.flatnonzero(alive)
            batch = slice(k * BATCH, (k + 1) * BATCH)
            equal[at] += (x[at, batch] == y[at, batch]).sum(1)
            alive[at] = equal[at] >= least
    return pd.Series(alive)


@F.pandas_udf(T.BooleanType())
def are_similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether the full shingle sets of each pair of texts reach the threshold."""
    shingler = Shingler()
    for a, b in batches:
        held: dict[str, np.ndarray] = {}
        held_chars = 0

        def one(text: str) -> np.ndarray:
            nonlocal held_chars
            if text not in held:
                held_chars += len(text)
                if held_chars > 2_000_000:
                    held.clear()
                    held_chars = 0
                held[text] = shingler.sets([text])[0]
            return held[text]

        out = []
        for x, y in zip(a, b):
            p, q = one(x), one(y)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * shared >= PERCENT * (len(p) + len(q) - shared) and shared > 0)
        yield pd.Series(out, dtype=bool)
    shingler = None
    give_back()


def row_key(id_: Column, text_key: Column) -> Column:
    """A digest of id and text: copies of a text have different ones, unless the whole row repeats."""
    return F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), text_key).cast("binary"))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


class NearDuplicates:
    """One run over a table. Tables that later steps do not read are deleted on the way; the result stays."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        small_batches()
        self.tables = Tables(docs.sparkSession)
        self.keep, self.drop = self.tables.keep, self.tables.drop
        key = text_key(F.col(text_col))
        self.rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), row_key(F.col(id_col), key).alias("row"), F.col(text_col).alias("text"))

    def classes(self) -> DataFrame:
        """(node, key, id, n, bands, sig): one row for each distinct text, numbered as it is written."""
        signed = self.rows.select("id", "key", per_text(_sign, SIGNED, CHUNK)(F.col("text")).alias("s")).select("id", "key", "s.*")
        one = signed.groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in SIGNED.fieldNames()])
        return self.keep(one.withColumn("node", F.monotonically_increasing_id()), "classes")

    def first_texts(self, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, text) of some classes. Rows meet by digests of id and text, so the copies of a text do not meet."""
        wanted = nodes.join(classes, "node").select("node", row_key(F.col("id"), F.col("key")).alias("row"))
        return self.keep(self.rows.select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("node", "text"), "texts")

    def likely(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those whose sizes and signatures allow a link."""
        signed = classes.select("node", "n", "sig")
        for side in "ab":
            pairs = pairs.join(signed.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        sizes = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
        return self.keep(pairs.filter(sizes).filter(may_be_similar("sig_a", "sig_b")).select("a", "b"), "likely")

    def confirmed(self, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (a, b) those that are links."""
        for side in "ab":
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
        return self.keep(pairs.filter(are_similar("text_a", "text_b")).select("a", "b"), f"links-{name}")

    def components(self, links: DataFrame) -> DataFrame:
        """(node, component): the least node reachable, for nodes with a link.

        Each round every node takes its least neighbour as parent, twice; the links between parents remain.
        """
        edges = links.select("a", "b").union(links.select("b", "a"))
        found = None
        while True:
            near = self.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent")), "parents")
            above = near.select(F.col("a").alias("parent"), F.col("parent").alias("above"))
            parents = near.join(above, "parent", "left").select("a", F.coalesce("above", "parent").alias("parent"))
            last, before = found, edges
            if found is None:
                found = parents.select(F.col("a").alias("node"), F.col("parent").alias("component"))
            else:
                step = parents.select(F.col("a").alias("component"), "parent")
                found = found.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            found = self.keep(found, "components")
            for side in "ab":
                edges = edges.join(parents.select(F.col("a").alias(side), F.col("parent").alias(f"p_{side}")), side, "left")
            edges = edges.select(F.coalesce("p_a", "a").alias("a"), F.coalesce("p_b", "b").alias("b")).filter("a <> b").distinct()
            edges = self.keep(edges, "edges")
            self.drop(near, last, before)
            if edges.isEmpty():
                self.drop(edges)
                return found

    @staticmethod
    def mixed(members: DataFrame, component: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with their component and their bucket's largest."""
        placed = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        several = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket", "main")
        return placed.join(several, "bucket")

    @staticmethod
    def hub_pairs(placed: DataFrame, sketches: DataFrame) -> DataFrame:
        """Each bucket's member with the least share of shingles of its own, paired with the other members."""
        hubs = placed.groupBy("bucket").agg(F.max_by(F.struct("node", "component", "bits"), F.struct(F.col("most") / F.col("n"), "node")).alias("hub"))
        met = placed.join(hubs.select("bucket", F.col("hub.node").alias("h_node"), F.col("hub.component").alias("h_component"), F.col("hub.bits").alias("h_bits")), "bucket")
        met = met.filter((F.col("component") != F.col("h_component")) & look_alike("bits", "h_bits"))
        return met.select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b")).distinct()

    @staticmethod
    def rest_pairs(placed: DataFrame, sketches: DataFrame) -> DataFrame:
        """Members of different components of a bucket that share a rare shingle, at least one of them a stray (outside
        its bucket's largest component).

        With the shingles of each member in one order, rarest first, two sets that reach the threshold share one
        of the first of the smaller set and one of the first of the larger; how many is a matter of size. Pairs
        come from those shingles only, so a bucket of many look-alikes is not looked at in all pairs.
        """
        t = PERCENT / 100
        member = placed.groupBy("node").agg(F.first("component").alias("component"), F.bool_or(F.col("component") != F.col("main")).alias("stray"), F.array_sort(F.collect_set("bucket")).alias("buckets"))
        tokens = sketches.join(member.select("node"), "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
        several = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        ordered = tokens.join(several, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("k", "shingle"))).alias("s"))  # as many as a text has shingles
        n, own = F.col("n"), F.col("n") - F.size("s")
        probe = n - F.ceil(n * t - 1e-9) + 1 - own
        index = n - F.ceil(n * (2 * t / (1 + t)) - 1e-9) + 1 - own
        first = ordered.filter(probe > 0).select("node", "n", index.alias("index"), F.size("s").alias("rest"), F.posexplode(F.slice("s", F.lit(1), probe.cast("int"))).alias("at", "s"))
        entries = first.join(member.select("node", "component", "stray"), "node").select(F.col("s.shingle").alias("shingle"), "node", "n", "component", "stray", (F.col("at") < F.col("index")).alias("index"), (F.col("rest") - F.col("at")).alias("rest"))
        side = lambda x, rows: rows.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "component", "stray", "index", "rest")])
        smaller = F.struct("x_n", "x_node") < F.struct("y_n", "y_node")
        roles = F.when(smaller, F.col("x_index")).otherwise(F.col("y_index"))
        once = ~F.col("y_stray") | (F.col("x_node") < F.col("y_node"))
        # What follows the first shared shingle in both orders is all that they can share.
        shared = F.least("x_rest", "y_rest")
        within = 100 * shared >= PERCENT * (F.col("x_n") + F.col("y_n") - shared)
        met = side("x", entries.filter("stray")).join(side("y", entries), "shingle").filter((F.col("x_component") != F.col("y_component")) & roles & once & within)
        pairs = met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
        looks = member.join(sketches, "node").select("node", "buckets", "bits")
        for x in "ab":
            pairs = pairs.join(looks.select(*[F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in ("node", "buckets", "bits")]), x)
        return pairs.filter(F.arrays_overlap("a_buckets", "b_buckets") & look_alike("a_bits", "b_bits")).select("a", "b")

    def open_members(self, placed: DataFrame, sketches: DataFrame) -> DataFrame:
        """Members of buckets with several components that may still have a link there.

        A member of n shingles, u of which no other member has, shares at most n - u (``most``) with any of them.
        """
        shingles = sketches.select("node", F.explode("shingles").alias("shingle"))
        own = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
        known = sketches.select("node", F.size("shingles").cast("long").alias("n"), "bits").join(own, "node", "left").withColumn("most", F.col("n") - F.coalesce("u", F.lit(0)))
        return placed.join(known.filter(100 * F.col("most") >= PERCENT * F.col("n")).drop("u"), "node")

    def run(self) -> DataFrame:
        """(node, key, id, n, component, component_id, first) of every class: id is its least, first says whether it holds
        the row that stands for its component. Written; all other tables are gone."""
        classes = self.classes()
        buckets = classes.filter("n > 0").select("node", F.explode("bands").alias("bucket"))
        shared = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("bucket", "leader")
        members = self.keep(buckets.join(shared, "bucket"), "members")
        pairs = self.keep(members.filter("leader < node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs-leader")
        texts = self.first_texts(members.select("node").distinct(), classes)
        likely = self.likely(pairs, classes)
        links = self.confirmed(likely, texts, "leader")
        self.drop(likely)
        component = self.components(links)

        unsettled = self.keep(self.mixed(members, component).select("bucket", "node"), "unsettled")
        self.drop(members)
        sketched = texts.join(unsettled.select("node").distinct(), "node").select("node", per_text(_sketch, SKETCHED, CHUNK)(F.col("text")).alias("s"))
        sketches = self.keep(sketched.select("node", "s.*"), "sketches")
        unsettled = self.keep(self.open_members(unsettled, sketches), "open")
        for name, more in (("hub", self.hub_pairs), ("rest", self.rest_pairs)):
            placed = self.keep(self.mixed(unsettled, component), f"placed-{name}")
            pairs = self.keep(more(placed, sketches).join(pairs, ["a", "b"], "left_anti"), f"pairs-{name}")
            self.drop(placed)
            found = self.confirmed(pairs, texts, name)
            if not found.isEmpty():
                links = links.union(found)
                component = self.components(links)

        grouped = classes.join(component, "node", "left").select("key", "n", "id", F.coalesce("component", "node").alias("component"))
        least = grouped.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "key")).alias("least"))
        result = grouped.join(least, "component").select("key", "id", "n", "component", F.col("least.id").alias("component_id"), (F.col("least.key") == F.col("key")).alias("first"))
        result = self.keep(result, "result")
        self.tables.drop_all_but(result)
        return result

    def labelled(self) -> DataFrame:
        """(id, n_shingles, component_id) of every row. Only digests and ids travel; Spark's adaptive join splits a text with very many copies."""
        result = self.run()
        return self.rows.select("id", "key").join(result.select("key", F.col("n").alias("n_shingles"), "component_id"), "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    component_id is the smallest id reachable over links. A text that is null, empty or without words is linked
    with nothing: rows of that kind are components of their own, with their own id. Very long texts are one set
    of shingles like any other; memory follows the longest text. Rows with a null id take part; their component
    has the smallest known id, or null. kept is whether the row's id is its component's; repeated rows agree.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    out = NearDuplicates(docs, id_col, text_col).labelled()
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the smallest id.

    Rows whose text has no words (null and empty ones too) all stay. Of rows with the same id and text, one
    stays; of a group without ids, one with the least digest of its text. Columns of any name pass through. An empty table gives no rows.

    Who stays is decided on ids and digests; then the rows travel once, to meet the digests of those that stay.
    """
    run = NearDuplicates(docs, id_col, text_col)
    first = run.run().filter("first and n > 0").select(row_key(F.col("id"), F.col("key")).alias("row"))
    rows = docs.select(whole_row(docs).alias("all"), F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)).alias("worded"), row_key(F.col(id_col), text_key(F.col(text_col))).alias("row"))
    worded = rows.filter("worded").drop("worded").join(first, "row").dropDuplicates(["row"])
    return rows.filter("not worded").select("all.*").unionByName(worded.select("all.*"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every whole text of documents."""
    return near_duplicates(documents(spark, sf_dir))
