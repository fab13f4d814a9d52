"""Odd rows go through every operator and every stage with a defined result."""

import public_tokenizers
import pytest

import corpus_pipeline
from reckoner.llm import crf, embeddings, jaccard, media_ts, packing, pieces, pii, quality, substring, token_files, toxicity
from reckoner.llm.common import saved


def tokens(spark, df, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(df, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_metadata(spark, folder)


OPERATORS = {
    "pii": lambda s, d, lab, t: (lambda c: pii.redact(pii.classify(c, pii.fit(c))))(saved(pii.candidates(d), "t")),
    "media": lambda s, d, lab, t: media_ts.features(media_ts.store(d)),
    "toxicity": lambda s, d, lab, t: toxicity.score(d, toxicity.fit(d, lab, ~crf.held_out(4, 2))),
    "quality": lambda s, d, lab, t: quality.score(d, quality.fit(d, lab, quality.training_rows())),
    "substring": lambda s, d, lab, t: substring.remove_repeats(d),
    "jaccard": lambda s, d, lab, t: jaccard.join(d),
    "pieces": lambda s, d, lab, t: pieces.decode(pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")), public_tokenizers.path("piece_bpe_32k.model")),
    "tokens": lambda s, d, lab, t: tokens(s, d, t),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_stay(name, spark, odd, labels, tmp_path):
    rows = OPERATORS[name](spark, odd, labels, tmp_path).collect()
    assert len(rows) == odd.count()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, spark, odd, labels, tmp_path):
    assert OPERATORS[name](spark, odd.limit(0), labels, tmp_path).count() == 0


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.pack_documents(odd.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pieces_give_the_text_back(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sorted((str(r.doc_id), r.text) for r in pieces.decode(pieces.encode(odd, path), path).collect())
    assert got == sorted((str(r.doc_id), r.text or "") for r in odd.collect())


def test_repeated_rows_lose_their_passage(spark, odd):
    rows = substring.remove_repeats(odd).where("doc_id = 5 OR doc_id IS NULL AND n_words > 0").collect()
    assert [r.n_words - r.n_removed for r in rows] == [0, 0, 0]


def test_no_labels(spark, odd, labels):
    none = labels.limit(0)
    for module, rows in ((toxicity, ~crf.held_out(4, 2)), (quality, quality.training_rows())):
        assert {r.score for r in module.score(odd, module.fit(odd, none, rows)).collect()} == {0.5}


def test_stages(spark, odd, labels, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    before = df.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = saved(stage(spark, df, sf), name)
        if k < 4:
            assert made.columns == list(corpus_pipeline.COLUMNS)
            assert made.count() <= before
            assert (made.count() < before) == (k < 2)
            df, before = made, made.count()
    assert made.select("doc_id").distinct().count() == before


def test_stages_of_odd_rows(spark, odd, sf):
    df = odd.withColumn("source", odd.lang).withColumn("n_chars", odd.doc_id)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, sf).count() > 0, name
        assert stage(spark, df.limit(0), sf).count() == 0, name


def test_stages_hand_small_batches_to_python(spark, monkeypatch):
    from reckoner.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for held, then in (("10000", common.BATCH), ("0", common.BATCH), ("70", 70)):
            spark.conf.set(name, held)
            corpus_pipeline.drop_repeated_passages(spark, docs, "")
            assert int(spark.conf.get(name)) == then
    finally:
        spark.conf.set(name, usual)
