"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_near import brute_near
from test_repeats import brute_words
from tokenizers import Tokenizer

from tidemark.llm import pseudonyms


def test_pipeline_by_stages(spark, sf):
    start = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34 !!", None, None, 8)], start.schema)
    docs = start.unionByName(odd)
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    kept = spark.createDataFrame(stages["language_id"](spark, docs, sf).collect(), docs.schema)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in before if r["doc_id"] < 10**6}

    one = spark.createDataFrame(stages["near_duplicates"](spark, kept, sf).collect(), docs.schema)
    _, component = brute_near([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert {r["doc_id"] for r in one.collect()} == {d for d, c in component.items() if d == c}

    cut = spark.createDataFrame(stages["substring_dedup"](spark, one, sf).collect(), docs.schema)
    want = brute_words([(r["doc_id"], r["text"]) for r in one.collect()], 20)
    assert cut.columns == docs.columns and cut.count() == one.count()
    for r in cut.collect():
        assert b" ".join(r["text"].encode().split()) == want[r["doc_id"]][3] and r["n_chars"] == len(r["text"])

    hidden = spark.createDataFrame(stages["pseudonyms"](spark, cut, sf).collect(), docs.schema)
    feistel, texts = pseudonyms.Feistel("documents"), {r["doc_id"]: r["text"] for r in cut.collect()}
    assert hidden.count() == len(texts)
    assert all(r["text"] == pseudonyms.replace(texts[r["doc_id"]], feistel)[0] for r in hidden.collect())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in hidden.collect())
    packed = stages["packing"](spark, hidden, sf)
    assert packed.agg(F.sum("length")).first()[0] == tokens
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == packed.columns and whole.agg(F.sum("length")).first()[0] == tokens
    assert np.all([c in whole.columns for c in ("doc_id", "sequence_id", "offset", "ids_crc32")])


def test_noise_and_unlearned_languages_go(spark):
    """Long noise and a language that no label names are rejected; every document of the table with a letter stays, short ones with a token too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = np.random.default_rng(3)
    russian = " ".join("".join(chr(0x430 + k) for k in draw.integers(0, 32, 6)) for _ in range(500))
    noise = "".join(chr(33 + k) for k in draw.integers(0, 93, 4000))
    odd = spark.createDataFrame([(10**6, russian, None, "s", 0), (10**6 + 1, noise, None, "s", 0),
                                 (10**6 + 2, 'the token = "6cfd1f1f244d4c4c327ecfd8fd9898497c475388" in.', None, "s", 0)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(odd), "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()} | {10**6 + 2}
