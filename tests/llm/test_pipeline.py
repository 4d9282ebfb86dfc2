"""The pipeline's stages, one by one, and its registration."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from eraflow.llm import queries

from .data import docs, empty, sentence, texts

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark):
    import random

    rng = random.Random(1)
    rows = texts() + [(900, "you are an idiot and a moron, total scum. " + sentence(rng, 20))]
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows.append((901, sentence(rng, 30) + " " + bench))
    now = docs(spark, rows)
    columns = now.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, FOLDER), name)
        seen[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
        if name != "mixture":
            assert now.columns == columns
    assert 900 not in seen["toxicity"] and len(seen["toxicity"]) == len(rows) - 1
    assert not {31, 40, 42} & set(seen["near_duplicates"]) and 30 in seen["near_duplicates"]
    assert sorted(seen["repeated_passages"], key=str) == sorted(seen["near_duplicates"], key=str)
    assert set(seen["repeated_passages"]) - set(seen["decontamination"]) == {901}
    assert set(seen["mixture"]) <= set(seen["decontamination"])


def test_clashing_column_names_stay_as_they_are(spark):
    """Columns with names that the operators use or used themselves, a back-tick and a blank."""
    names = ["_k", "_spans", "_text_key", "_source", "_rate", "_score", "row", "k", "text_key", "spans", "rate", "own", "digest", "others", "a`b", "x y", "size", "component"]
    plain = spark.createDataFrame([(i, t, "en", f"s{i % 2 if i else 0}", None if t is None else len(t)) for i, t in texts()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        wide = plain.selectExpr("*", *[f"concat('v{k}-', coalesce(doc_id, -1)) AS `{n.replace('`', '``')}`" for k, n in enumerate(names)])
        got = stage(spark, wide, FOLDER)
        assert got.columns[: len(wide.columns)] == wide.columns, name
        rows = got.collect()
        assert rows and all(r[5 + k] == f"v{k}-{-1 if r[0] is None else r[0]}" for r in rows for k in range(len(names))), name
        bare = stage(spark, plain, FOLDER)
        assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in bare.collect()), name


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), FOLDER).count() == 0, name


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names) and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_whole_tables(spark, name):
    out = queries.QUERIES[name](spark, FOLDER)
    n = {"op2": "embeddings", "op6": "pages", "op8": "pages"}.get(name.split("_")[0], "documents")
    if name.startswith("op13"):
        assert 0 < out.count() <= 10 * spark.read.parquet(f"{FOLDER}/benchmark.parquet").count()
    elif not name.startswith("op5"):
        assert out.count() == spark.read.parquet(f"{FOLDER}/{n}.parquet").count()
