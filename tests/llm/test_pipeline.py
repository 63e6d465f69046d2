"""The pipeline's stages, each held against its operator's brute-force rule on its own input."""

import gc

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from parimutuel.llm import bpe, common, decontaminate, lines
from tests.llm.test_dedup import Sets, brute_lines, grams, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(stages):
    first = stages[0][1].columns
    assert all(after.columns == first for _, _, after in stages[:-1])
    assert stages[-1][2].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    known = [r.doc_id for r in before.collect() if r.doc_id in labels]
    assert sum((d in kept) == (labels[d] == 0) for d in known) >= 0.95 * len(known)


def test_line_stage(stages):
    _, before, after = stages[1]
    want, _ = brute_lines({r.doc_id: r.text for r in before.collect()}, words=lines.MANY_WORDS)
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copies_stage(stages):
    _, before, after = stages[2]
    rows = before.collect()
    sets = {r.doc_id: set(grams(words_of(r.text), 5)) for r in rows}
    classes = Sets(sets)
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            c = len(sets[i] & sets[j])
            if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c):
                classes.join(j, i)
    assert {r.doc_id for r in after.collect()} == {min(x for x, c in classes().items() if c == k) for k in set(classes().values())}


def test_decontamination_stage(spark, stages):
    _, before, after = stages[3]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        text = decontaminate.normal(r.text)
        if any(i in text for i in items):
            assert r.doc_id not in kept
        elif r.doc_id not in kept:
            assert any(decontaminate.Pattern.of(i).distance(text)[0] <= int(len(i) * decontaminate.BUDGET) for i in items)


def test_whole_pipeline(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][2].count() == stages[-2][2].count()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, odd, k):
    _, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, odd, SF)
    assert got.count() > 0 and (k == 4 or got.columns == odd.columns)
    assert stage(spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(entry.llm.QUERIES))
def test_queries(spark, name):
    frame = entry.queries()[name](spark, SF)
    got = frame.toPandas()
    assert {"doc_id", "conv_id", "vec_id"} & set(got.columns)
    if name in entry.llm.ORACLE:
        con = duckdb.connect()
        for table in ("documents", "conversations", "embeddings"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.sql(entry.llm.ORACLE[name]).df()
        rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).itertuples(index=False)))
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_shuffle_files_go_with_the_table_they_served(spark):
    import time

    from pyspark.sql import functions as F

    from parimutuel.llm.common import Tables

    def shuffles() -> list[str]:
        files, names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator(), []
        while files.hasNext():
            names.append(files.next().getName())
        return [n for n in names if n.startswith("shuffle_")]

    before = set(shuffles())
    with Tables(spark) as tables:
        stored = tables.store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3))
        until = time.time() + 5
        while set(shuffles()) - before and time.time() < until:
            time.sleep(0.1)
        assert not set(shuffles()) - before
        assert stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_workers_keep_no_encoder_for_other_passes(spark, documents):
    docs = documents([(i, f"a text {i}") for i in range(40)]).coalesce(1)
    encoders = lambda: sum(isinstance(o, bpe.WordBpe) for o in gc.get_objects())
    for _ in range(3):  # until each idle worker has had its turn
        assert bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 40
    left = common.map_texts(docs, lambda ids, texts: [ids, np.full(len(texts), encoders())], "doc_id long, n long")
    for _ in range(8):
        assert left.agg({"n": "max"}).first()[0] == 0
