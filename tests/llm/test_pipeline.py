import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from assay.llm import mixing, quality
from tests.llm import data
from tests.llm.test_jaccard import brute


def test_every_stage_against_brute_force(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    seen = [r[:5] for r in data.rows()] + [(500 + i, data.changed(data.text(80 + i % 7, 120), i, i % 4), "en", f"src{i % 4}", 1) for i in range(40)]
    docs = spark.createDataFrame(seen, schema)
    rows = [r for r in dict.fromkeys(seen) if quality.figures([(r[1] or "").encode()])[6][0]]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "similar_dedup", "source_mix", "piece_ids"]

    def after(name, docs):
        out = stages[name](spark, docs, "unused")
        assert out.columns == docs.columns
        return spark.createDataFrame(out.collect(), schema)  # as written and read again

    docs = after("quality_rules", docs)
    assert {tuple(r) for r in docs.collect()} == set(rows)

    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1]), r)
    docs = after("exact_dedup", docs)
    assert sorted(map(str, (tuple(r) for r in docs.collect()))) == sorted(map(str, first.values()))

    stay = {c for i, _, c in brute([(r[0], r[1]) for r in first.values()])}
    rows = [r for r in first.values() if r[0] is None or str(r[0]) in stay]
    docs = after("similar_dedup", docs)
    assert sorted(map(str, (tuple(r) for r in docs.collect()))) == sorted(map(str, rows))

    chosen = {r.doc_id for r in mixing.selection(docs, share=corpus_pipeline.SHARE, epochs=1).collect()}
    docs = after("source_mix", docs)
    assert {r.doc_id for r in docs.collect()} == chosen and len(chosen) < len(rows)

    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r.doc_id: list(r.ids) for r in stages["piece_ids"](spark, docs, "unused").collect()}
    assert ids == {r.doc_id: theirs.encode(r.text) for r in docs.collect()}


def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r.parity for r in out)
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 0")
    assert corpus_pipeline.quality_rules(spark, texts, "").collect() == []
