import numpy as np

import corpus_pipeline
from entroflow.llm import language, quality

from .brute import near_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranking = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = [r for r in docs.collect() if ranking.score(np.array([quality.features(r.text)]))[0] >= quality.CUT]
    texts = language.train(spark.createDataFrame(good, SCHEMA))
    p = language.Parser(texts)
    good = [r for r in good if p.predict([r.text])[0] != ["und"]]
    best = {}
    for r in good:
        key = "".join(r.text.split())
        if key not in best or (-len(r.text), r.doc_id) < best[key][:2]:
            best[key] = (-len(r.text), r.doc_id, r.text)
    left = {i: t for _, i, t in best.values()}
    return {i for i, c in near_components(left, 5).items() if i == c}


def test_same_documents_as_brute_force(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == brute(spark, sf_dir)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096


def test_stages_keep_columns_and_survive_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "Plain words here.", "en", "s", 17), (3, "Plain words here.", "en", "s", 17)], SCHEMA)
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == frame.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()


def test_language_stage_drops_only_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "zzqx wvvk junk qqq"), (2, "日本語の文章"), (3, "12 34 !?"), (4, ""), (5, None)], "doc_id long, text string")
    texts = {"en": b"the cat and the dog went home", "de": b"der hund und die katze gingen heim"}
    assert sorted(r.doc_id for r in language.keep_known(docs, texts).collect()) == [1, 2]


def test_exact_stage_keeps_one_row_of_each_text(spark, sf_dir):
    rows = [(3, "a b", "en"), (3, "a  b", "en"), (3, "other", "en"), (9, "othe r", "en"), (9, "o t h e r", "en"), (None, "x", "en"), (None, "x", "en"), (5, None, "en"), (6, " ", "en"), (7, "single", "en"), (8, "long " * 100_000, "en"), (8, "long " * 100_000, "en")]
    docs = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "doc_id long, text string, lang string, kept string, length int, group boolean")
    out = corpus_pipeline.without_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text and r.text[:9]) for r in out.collect()), key=str)
    assert got == sorted([(3, "a  b"), (9, "o t h e r"), (None, "x"), (6, " "), (7, "single"), (8, "long long")], key=str)
    near = corpus_pipeline.without_near_copies(spark, out, sf_dir)
    assert near.columns == docs.columns and near.count() == 6
