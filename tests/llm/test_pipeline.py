import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import byte_bpe, mixing, quality
from tests.conftest import DATA

from . import plain

P = pytest.importorskip("public_tokenizers")


def test_pipeline_against_plain(spark, duck, sample):
    tiktoken = pytest.importorskip("tiktoken")
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality.JUDGED_SQL}) WHERE kept").fetchall()}
    docs = [(i, t, s) for i, t, s in zip(sample.doc_id, sample.text, sample.source, strict=True) if i in kept]
    groups = plain.components([d[0] for d in docs], [d[1] for d in docs])
    docs = [d for d, (i, _, least) in zip(docs, groups, strict=True) if i == least]
    _, later = plain.repeated([d[0] for d in docs], [d[1] for d in docs])
    texts = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), DATA).collect()}
    for i, t, _ in docs:
        assert plain.words(texts[i], fold=False) == [w for n, w in enumerate(plain.words(t, fold=False)) if n not in later.get(i, ())]
    keys = {r.doc_id: r.key for r in spark.createDataFrame([(d[0],) for d in docs], "doc_id long").withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - mixing.BITS * mixing.LEVELS)).collect()}
    copies = plain.mix([(keys[i], s, len(plain.words(texts[i]))) for i, _, s in docs])
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for (i, _, _), n in zip(docs, copies, strict=True):
        ids = np.array(enc.encode_ordinary(texts[i]), dtype="<u4")
        want += [(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())] * n
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(want)


def test_stages_keep_the_columns(spark, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, DATA).columns == docs.columns
        assert corpus_pipeline.byte_level_bpe(spark, docs, DATA).count() == docs.count()
        assert corpus_pipeline.quality_rules(spark, docs, DATA).count() <= docs.count()
        assert corpus_pipeline.ngram_join(spark, docs, DATA).count() <= docs.count()
        assert corpus_pipeline.suffix_dedup(spark, docs, DATA).count() == docs.count()


def test_near_duplicates_leave_one_of_a_group(spark, edge):
    left = [r.doc_id for r in corpus_pipeline.ngram_join(spark, edge, DATA).collect()]
    assert sorted(x for x in left if x is not None) == [1, 2, 3, 4, 6, 8, 9] and left.count(None) == 2
