"""The pipeline's stages as a whole: what each keeps, on given tables with nulls, empty texts, repeats and no rows at all."""

from __future__ import annotations

import hashlib
import os
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingdelta.llm import bpe, decontaminate, pii, quality, simhash
from filingdelta.llm.common import prepare, written

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest documents and odd rows beside them, in a folder of their own."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    given = prepare(spark).read.parquet(f"{SMALL}/documents.parquet").select(*COLUMNS)
    long = given.orderBy(F.desc("n_chars")).limit(3).collect()
    odd = [(9001, None, "en", None, None), (9002, "", None, "web", 0), (9003, long[0].text, "en", "web", None), (9004, long[1].text, None, None, 5), (9004, long[1].text, None, None, 6),
           (None, long[2].text, "en", "web", 1), (None, None, None, None, None)]
    given.unionByName(spark.createDataFrame(odd, given.schema)).repartition(4).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "personal_data", "bpe_encoding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, tables), name)
        if name != "bpe_encoding":
            assert sorted(docs.columns) == sorted(COLUMNS), name
    rows = lambda df: sorted(map(repr, df.select(*COLUMNS).collect()))
    # Quality: the rows that the rules keep, as they are.
    judged = quality.judge(seen["quality_rules"]).groupBy("doc_id", "kept").count().collect()
    assert seen["simhash_dedup"].count() == sum(r["count"] for r in judged if r.kept) and not seen["simhash_dedup"].where("text IS NULL OR text = ''").count()
    # Dedup: one row of each component, the copies planted above are gone.
    found = simhash.near_duplicates(seen["simhash_dedup"]).select("component_id").distinct().collect()
    left = [r.doc_id for r in seen["decontamination"].collect()]
    assert len(left) == len(found) and len(set(left)) == len(left) and not {9003, 9004, None} & set(left)
    assert set(rows(seen["decontamination"])) <= set(rows(seen["simhash_dedup"]))
    # Decontamination: rows that test windows do not cover.
    benchmark = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert rows(seen["personal_data"]) == rows(decontaminate.clean_rows(spark, seen["decontamination"], benchmark))
    # Personal data: all rows stay, only texts change, and no certain span is left.
    before, after = ({r.doc_id: r for r in seen[n].collect()} for n in ("personal_data", "bpe_encoding"))
    assert before.keys() == after.keys() and all(before[i].lang == after[i].lang for i in before)
    assert not any(s.base for r in pii.find_personal_data(seen["bpe_encoding"]).collect() for s in r.spans)
    # Encoding: the library's ids of every text that came so far.
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    for r in docs.collect():
        ids = library.encode(after[r.doc_id].text, add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest()
    assert 0 < docs.count() == len(after) < seen["quality_rules"].count()


def test_one_python_worker_a_task(spark, tables):
    """Encoding and decoding do not hold their vocabularies side by side; the caches of an encoder are bounded well below a worker's memory."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plan = corpus_pipeline.token_ids(spark, docs, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    data = bpe.read_vocabulary(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    assert not hasattr(bpe.loaded(data, bpe.Tokens), "merges") and bpe.loaded(data, bpe.Tokens).bytes_of == bpe.loaded(data).bytes_of
    tracemalloc.start()
    encoder = bpe.Encoder(bpe.loaded(data))
    before, _ = tracemalloc.get_traced_memory()
    for k in range(0, 900_000, 1000):
        encoder.ids_bytes(" ".join(f"{n:x}" for n in range(k, k + 1000)).translate(dict(zip(map(ord, "0123456789"), "ghijklmnop"))))
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held < 100 << 20


def test_no_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, tables), name)
        assert docs.count() == 0, name
