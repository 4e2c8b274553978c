"""The pipeline's stages against what each must do to its input, and the queries' oracles."""

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from adlens.llm import toxicity
from adlens.llm.common import written
from adlens.llm.queries import llm_oracles, llm_queries
from llm_fixtures import SMOKE
from test_simhash import classes, direct


def test_registered():
    names = list(llm_queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(names) < set(queries()) and "pipeline" in queries() and set(llm_oracles()) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    df = queries()[name](spark, SMOKE)
    cols = sorted(df.columns)
    want = con.execute(oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    flat = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted((flat(r[c] for c in cols) for r in df.collect()), key=repr) == \
        sorted((flat(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMOKE), f"test-{name}")
        kept[name] = docs
    raw = spark.read.parquet(f"{SMOKE}/documents.parquet")
    for name in ("toxicity", "simhash_near_dedup", "curriculum_mixing"):
        assert kept[name].columns == raw.columns
    model = toxicity.train(raw, spark.read.parquet(f"{SMOKE}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.tag(raw, model).filter("predicted = 0").collect()}
    first = kept["toxicity"].collect()
    assert {r["doc_id"] for r in first} == clean
    groups = classes([(r["doc_id"], direct(r["text"])) for r in first])
    second = sorted(r["doc_id"] for r in kept["simhash_near_dedup"].collect())
    assert second == sorted({c for _, _, c in groups})
    third = [r["doc_id"] for r in kept["curriculum_mixing"].collect()]
    assert set(third) <= set(second) and max(map(third.count, set(third))) <= 3
    packed = kept["best_fit_packing"].collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(third)
    assert corpus_pipeline.run(spark, SMOKE).count() == len(packed)


def test_no_text_is_lost_with_repeated_and_missing_ids(spark):
    """Near-duplicates and mixing keep some row of every group, whichever ids the rows have."""
    a, b, c = "alpha beta gamma delta epsilon", "totally other words in here", "a third text that has no id at all"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1),
            (None, a, "en", "s", 1), (3, c + " but longer by some words", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = written(stages["simhash_near_dedup"](spark, docs, SMOKE), "test-kept")
    assert sorted(r["text"] for r in kept.collect()) == sorted({r[1] for r in rows})
    mixed = written(stages["curriculum_mixing"](spark, kept, SMOKE), "test-mixed")
    assert {r["text"] for r in mixed.collect()} == {r[1] for r in rows}
    packed = stages["best_fit_packing"](spark, mixed, SMOKE).collect()
    assert len([r for r in packed if r["piece"] == 0]) == mixed.count()
