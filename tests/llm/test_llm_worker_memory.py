"""Workers outlive a stage: what one stage caches must not stand beside the memory of the next."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from trajecta.llm import tokens
from trajecta.llm.common import frugal
from trajecta.llm.packing import pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def encoders():
    before = dict(tokens._ENCODERS)
    tokens._ENCODERS.clear()
    yield tokens._ENCODERS
    tokens._ENCODERS.clear()
    tokens._ENCODERS.update(before)


def test_a_stage_that_does_not_encode_drops_the_encoders_of_the_one_before(encoders):
    run = lambda batches: ((b, len(encoders)) for b in batches)
    tokens.encoder(PATH, 100)
    assert list(frugal(run, encodes=True)([1, 2])) == [(1, 1), (2, 1)]
    assert list(frugal(run)([1, 2])) == [(1, 0), (2, 0)]


def test_packing_gives_the_same_rows_whatever_a_worker_caches(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 6))) for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (None, "a text"), (7, rows[7][1])], "doc_id long, text string")
    found = [sorted(map(str, pack_documents(docs, PATH, 64, 0, cache_pieces=n).drop("sequence_id", "offset").collect())) for n in (50, 900_000)]
    assert found[0] == found[1] and len(found[0]) > len(rows)


def test_the_pipeline_caches_fewer_pieces_than_the_operator(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda docs, *args, **more: asked.update(more) or docs)
    corpus_pipeline.packing(spark, spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")
    assert asked["cache_pieces"] <= 300_000


def test_texts_of_known_pieces_take_one_lookup_a_piece_and_give_the_ids_of_whole_texts(encoders, monkeypatch):
    enc, texts = tokens.encoder(PATH, 1000), ["a stone, a river\nand a stone", "stone  twice spaced", "", None, "a river"]
    first = enc.encode_many(texts)
    monkeypatch.setattr(enc, "_add", lambda keys: pytest.fail("nothing is new"))
    for text, once, again in zip(texts, first, enc.encode_many(texts), strict=True):
        assert once.tolist() == again.tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids
