import corpus_pipeline
import tiktoken
import public_tokenizers
from test_lineruns import brute as brute_lines
from test_minmax import brute as brute_near
from test_seeds import contaminated

from lumenmatch.llm import bpe, rules


def test_stages_on_hostile_rows(spark, hostile, nothing, sf):
    for docs in (hostile, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keep = {r["doc_id"] for r in rules.weak_quality(docs).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in keep]
    rows = [(i, t) for i, t, *_ in brute_lines(rows)]
    first = {i for i, _, c in brute_near(rows) if i == c}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = [(i, t) for i, t in rows if i in first]
    found = contaminated(dict(rows), items)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in rows if not found[i]}
    assert 0 < len(got) < docs.count()
