import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm import brute
from tideway.llm import packing, secrets

SF = "/root/testdata/sf0.001"


def plain_run(docs, items):
    """The lengths of run()'s pieces by (doc_id, piece), for rows of unique doc_ids; only the forest's verdicts come from the library."""
    kept = sorted((d, t) for d, t in docs if brute.accepted(t))
    root = brute.groups([t for _, t in kept])
    kept = [kept[n] for n in range(len(kept)) if root[n] == n]
    clean = {r[0] for r in brute.contamination(kept, items) if not r[5]}
    forest, encode = secrets.trained(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, t in kept:
        if d in clean:
            spans = [(a, b) for a, b, s in secrets._score_batch([t], forest)[0] if s >= 0.5]
            for a, b in reversed(spans):
                t = t[:a] + "[SECRET]" + t[b:]
            out.append((d, t))
    cut = brute.pieces(out, lambda t: encode.encode(t, add_special_tokens=False).ids, packing.CAPACITY)
    return {k: v[1] for k, v in cut.items()}


def test_stages_follow_each_other(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_run([(r.doc_id, r.text) for r in docs.collect()], items.collect())
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert {(r.doc_id, r.piece): r.length for r in out.itertuples()} == want
    assert out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert out.sequence_id.nunique() <= 1.02 * sum(want.values()) / packing.CAPACITY + 1


def test_odd_tables(spark, tmp_path):
    text = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions behind the old stone bridge at midnight"
    rows = [(None, text, "en"), (1, text, "en"), (1, re.sub("fox", "cat", text).replace("bridge", "mill and the long dark river that nobody dares to cross"), "en"), (2, None, None), (3, "", ""), (4, "few words", "x"), (5, text * 3000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    for name, docs, items in (("full", df, [(1, "something else"), (None, None)]), ("empty", df.limit(0), [])):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # both texts of doc_id 1 stay, its copy without an id goes; the others fail the quality rules
        assert sorted((r.doc_id, r.piece) for r in out) == ([] if name == "empty" else [(1, 0), (1, 0)])
