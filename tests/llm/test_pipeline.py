"""Each stage of the corpus pipeline against a plain version, on the whole small table; and what a run leaves behind."""

import glob
import hashlib

import corpus_pipeline
from larder.llm import decontaminate, language_id, secret_scan, sentencepiece_codec
from test_operators import plain_components

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_plain_versions(spark):
    import sentencepiece

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", None, None), (900_002, "", None, "s", 0), (None, " \n", "en", "s", 2), (900_003, "password = 'hunter22' " * 3, "en", "s", 5), (900_003, "password = 'hunter22' " * 3, "en", "s", 5)], docs.schema)
    docs = docs.union(odd)

    model = language_id.fit(docs)
    kept = []
    for r in docs.collect():
        lang, score = model.predict([r["text"] or ""])
        if language_id.has_letter(r["text"] or "") and score[0] >= 0.5 and lang[0] != "und":
            kept.append(tuple(r))
    out = stages["language"](spark, docs, SMALL)
    assert out.columns == docs.columns and rows_of(out) == sorted(kept, key=str)

    # Documents without words do not come this far; they are put in again to see that they stay.
    docs = out.union(odd.filter("text is null or trim(text) in ('', '\\n')"))
    items = docs.collect()
    component = plain_components([(r["doc_id"], r["text"]) for r in items])
    wanted, seen = [], set()
    for r, (doc_id, size, least) in zip(items, component):
        if size == 0 or (doc_id == least and (least, r["text"]) not in seen):
            seen.add((least, r["text"]) if size else id(r))
            wanted.append(tuple(r))
    out = stages["near_duplicates"](spark, docs, SMALL)
    assert out.columns == docs.columns and rows_of(out) == sorted(wanted, key=str)

    docs = out
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    index = decontaminate.Index([x for x in bench if x[1]])
    wanted = [tuple(r) for r in docs.collect() if not index.find(r["text"] or "")]
    out = stages["decontaminate"](spark, docs, SMALL)
    assert rows_of(out) == sorted(wanted, key=str) and len(wanted) < docs.count()

    docs, wanted = out, []
    for r in docs.collect():
        text = r["text"] and secret_scan.redact_text(r["text"])
        wanted.append((r["doc_id"], text, r["lang"], r["source"], len(text or "")))
    out = stages["secrets"](spark, docs, SMALL)
    assert rows_of(out.select("doc_id", "text", "lang", "source", "n_chars")) == sorted(wanted, key=str)
    assert any("[SECRET]" in (w[1] or "") for w in wanted)

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for r in out.collect():
        ids = sp.encode(r["text"] or "")
        wanted.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert rows_of(stages["tokenize"](spark, out, SMALL)) == sorted(wanted, key=str)


def test_a_run_leaves_its_result_only(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(folder + "/larder-*"))
    out = corpus_pipeline.run(spark, SMALL)
    left = set(glob.glob(folder + "/larder-*")) - before
    assert len(left) == 1 and [x.rpartition("/")[2] for x in glob.glob(left.pop() + "/*")] == ["4-tokenize.parquet"]
    assert {"doc_id", "n_tokens"} <= set(out.columns) and 0 < out.count() <= spark.read.parquet(f"{SMALL}/documents.parquet").count()
