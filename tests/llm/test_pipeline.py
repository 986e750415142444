"""The pipeline's stages against plain versions of what they do."""

import hashlib

import corpus_pipeline
import tiktoken
from rowloom.llm import line_frequency, poisson_mix, prefix_bpe

import public_tokenizers

from .test_operators import survivors

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "source_mixture", "token_ids"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(spark.createDataFrame(stage(spark, steps[-1], SF).collect(), docs.schema))
        assert steps[-1].columns == docs.columns
    rules = {r.doc_id: r.kept for r in line_frequency.op5_line_frequency(docs).collect()}
    first = {r.doc_id: r for r in steps[1].collect()}
    assert set(first) == {i for i, kept in rules.items() if kept}
    assert all(r.n_chars == len(r.text) for r in first.values())

    assert sorted(r.doc_id for r in steps[2].collect()) == survivors({i: r.text for i, r in first.items()})

    copies = sorted(r.doc_id for r in poisson_mix.mixed(steps[2]).collect())
    assert sorted(r.doc_id for r in steps[3].collect()) == copies

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(prefix_bpe.default_vocabulary()[0]), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, steps[3], SF).collect()
    want = sorted((r.doc_id, hashlib.sha256(" ".join(map(str, library.encode_ordinary(r.text))).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in steps[3].collect())
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in last) == want
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in last)
    assert corpus_pipeline.ORACLE_SQL is None and set(corpus_pipeline.queries()) == {"pipeline"}
