"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import bpe, mixing, quality
from broadsheet.llm.common import durable
from tests.llm import helpers


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], small), "test"))
    return out


def ids(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_quality_stage(spark, small, steps):
    good = {r["doc_id"] for r in quality.query(spark, small).where("predicted = 1").select("doc_id").collect()}
    assert set(ids(steps[1])) == good and 0 < len(good) < steps[0].count()


def test_line_stage(steps):
    assert ids(steps[2]) == helpers.kept_lines(list(ids(steps[1]).items()))


def test_ngram_stage(steps):
    before = ids(steps[2])
    names = list(before)
    sets = [helpers.shingles(before[i]) for i in names]
    heads = helpers.groups(names, lambda i, j: helpers.near(sets[i], sets[j]))
    assert set(ids(steps[3])) == {i for i in names if heads[i] == i}


def test_mixing_stage(steps):
    sized = steps[3].select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))
    target = {r["source"]: int(r["target"]) for r in mixing.mix_sources(sized).collect()}
    got = {r["source"]: r["n"] for r in steps[4].groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()}
    assert got == target


def test_bpe_stage(steps):
    import hashlib

    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    key = lambda i, x: (i, hashlib.sha256(x).hexdigest())
    want = sorted((*key(r["doc_id"], r["text"].encode()), tuple(e.encode_ordinary(r["text"]))) for r in steps[4].collect())
    assert sorted((r["doc_id"], r["decoded_sha256"], tuple(r["ids"])) for r in steps[5].collect()) == want


def test_run_is_the_stages(spark, small, steps):
    assert corpus_pipeline.run(spark, small).count() == steps[-1].count()


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null ids and texts, empty texts, equal rows, ids with two texts, other columns: what the docstring says."""
    rows = [(i, f"a sentence number {i} with words that make it its own", "en", "s", 1, 0.5) for i in range(30)]
    rows += [(None, "no id here at all but words", None, None, None, None), (7, None, "en", "s", 0, 0.5), (8, "", "en", "s", 0, 0.5), (3, rows[3][1], "en", "s", 1, 0.5), (3, "the same id with quite another text", "en", "s", 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `x.y` double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = durable(stage(spark, now, str(tmp_path)), "odd")
        assert now.columns == docs.columns, name
        if name.startswith("n-gram"):
            kept = now.collect()
            assert sum(r["doc_id"] == 3 for r in kept) == 2 and sum(r["doc_id"] is None for r in kept) == 1 and {7, 8} <= {r["doc_id"] for r in kept}
    last = durable(corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)), "odd")
    assert last.count() == now.count() and last.where("ids is null").isEmpty()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
