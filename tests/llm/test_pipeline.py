"""The stages on odd rows, and the guard of the driver's entry."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry


@pytest.fixture
def folder(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(10, 60)], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_keep_columns_and_count(spark, docs, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "simhash", "mixing", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, folder)
            assert out.columns == (docs.columns if name != "pieces" else [*docs.columns, "ids", "decoded"])
            n = out.count()
            assert (n <= rows.count()) if name != "mixing" else (n <= 3 * rows.count())


def test_language_stage_keeps_unsure_documents(spark, docs, folder, monkeypatch):
    from pyspark.sql import functions as F

    unsure = F.when(F.col("doc_id") == 4, "und").otherwise("en")
    monkeypatch.setattr(corpus_pipeline, "predict_language", lambda rows: rows.withColumns({"lang_pred": unsure, "score": F.lit(0.2)}))
    kept = corpus_pipeline.language_stage(spark, docs, folder)
    assert kept.count() == docs.filter("NOT doc_id <=> 4").count()


def test_dedup_stage_keeps_one_of_each_group(spark, docs, folder):
    from rehome.llm.simhash import simhash_groups

    kept = corpus_pipeline.dedup_stage(spark, docs, folder).collect()
    groups = {r.component_id for r in simhash_groups(docs).collect() if r.component_id is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(groups)
    assert sum(r.doc_id is None for r in kept) == 1


def test_mixing_stage_repeats_as_the_mix_says(spark, docs, folder):
    from collections import Counter

    from rehome.llm.mixing import fair_mix

    once = docs.dropDuplicates(["doc_id"])
    want = Counter({r.doc_id: r.taken // r.size for r in fair_mix(once).collect() if r.taken})
    assert Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, once, folder).collect()) == want


def test_run_applies_every_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.filter("text IS NULL OR size(ids) = 0 OR decoded <> text").isEmpty()


def test_entry_has_all_queries():
    found = entry.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))


def test_an_id_with_several_texts_is_several_documents(spark):
    words = {"copy": "one two three four five six seven eight", "unique": "alpha beta gamma delta epsilon zeta eta theta iota"}
    rows = [(7, words["unique"]), (3, words["copy"]), (7, words["copy"]), (9, "a one here is"), (9, "b two there was"), (9, "a one here is"), (None, "x"), (None, "x")]
    found = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(
        [(3, words["copy"]), (7, words["unique"]), (9, "a one here is"), (9, "b two there was"), (None, "x"), (None, "x")], key=repr)


def test_columns_of_any_names_come_through(spark, folder):
    names = ["_text", "_id", "_time", "_times", "_row", "holes", "fingerprint", "rank", "turn", "h", "_lang", "_n"]
    rows = [(i, f"word{i % 7} the river and the stone number {i} of them all", "en", "ab"[i % 2], *[i * 10 + k for k in range(len(names))]) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert out.filter(" OR ".join(f"`{n}` <> doc_id * 10 + {k}" for k, n in enumerate(names))).isEmpty(), name


def test_workers_without_the_package(tmp_path, folder):
    """Executors whose Python cannot import the package: tasks bring all that they need."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.abspath(entry.__file__))
    script = f"""
import os, sys
sys.path.insert(0, {repo!r})
from rehome.session import build_session
os.chdir({str(tmp_path)!r})
spark = build_session("bare", "local[2]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path / "shared")!r}, spark__sql__shuffle__partitions="2")
from pyspark.sql import functions as F
from rehome.llm.queries import QUERIES
there = spark.range(1).select(F.udf(lambda x: __import__("importlib.util").util.find_spec("rehome") is not None, "boolean")("id")).first()[0]
assert not there, "the workers can import the package"
for name in ("op2_quality_votes", "op4_language_gru", "op12_whitening", "op13_archives", "op11_prefix_trie"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("DONE")
"""
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=600)
    assert "DONE" in run.stdout, run.stderr[-3000:]
