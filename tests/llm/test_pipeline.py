"""The pipeline's stages on a small table: columns, decisions, and the whole run."""

import random

import corpus_pipeline

import pytest

import public_tokenizers
from fieldspark.llm import bpe

from .test_operators import frame, prose


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    kinds = {"en": ("an", "ther", "ing"), "es": ("ué", "ión", "ar")}
    rows = [(i, prose(rng, 60, kinds[k]), k, rng.choice("ab")) for i in range(150) for k in [rng.choice(list(kinds))]]
    rows += [(500, rows[0][1], rows[0][2], "a"), (501, "too short", "en", "a"), (502, None, "en", "a")]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns, name
    ids = {r["doc_id"] for r in df.collect()}
    assert not ids & {500, 501, 502} and len(ids) > 50
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == ids and {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_whole_run_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows and ids, ties, a long text, clashing columns: what comes out are ids of texts that went in."""
    import tiktoken

    rng = random.Random(4)
    rows = [(rng.choice([None, i, i % 50]), prose(rng, rng.randint(30, 90)), "en", rng.choice(["a", "a", "b", None])) for i in range(120)]
    rows += [rows[5]] * 4 + [(None, None, None, None), (3, "", "en", "a"), (4, " \n", None, "b"), (900, prose(rng, 5000), "en", "c"), (901, "x" * 2000, "en", "c")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {(i, t) for i, t, *_ in rows}
    assert len(out) > 60 and all((r["doc_id"], enc.decode(list(r["ids"]))) in texts and r["n_tokens"] == len(r["ids"]) for r in out)
    assert {r["doc_id"] for r in out} >= {900} and not any(r["n_tokens"] < 20 for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "too short", "en", "a")] * 3])
def test_run_of_nothing(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
