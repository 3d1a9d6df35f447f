"""The pipeline: each stage on what its predecessor kept, against plain versions."""

from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldwise.llm import line_rules, text_stats

from .test_operators import brute_components, reference_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, and each stage's result, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src0", 0), (-3, " \n", "en", "src0", 2), (None, "a null id", "en", None, 9)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id < 3"))
    docs.write.parquet(str(root / "docs"))
    results = [spark.read.parquet(str(root / "docs"))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, results[-1], SF).write.parquet(str(root / name))
        results.append(spark.read.parquet(str(root / name)))
    return results


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay_and_rows_only_go(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns
        assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").filter("doc_id is not null").count() == 0
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_classifier_keeps_what_labels_call_good(spark, stages):
    kept = set(by_id(stages[1]))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert sum((r.doc_id in kept) == bool(r.quality) for r in labels) >= 0.9 * len(labels)


def test_rules_keep_clean_documents(stages):
    judged = {r.doc_id: r for r in line_rules.judge_lines(stages[1], keep=("doc_id",)).collect()}
    kept = by_id(stages[2])
    assert set(kept) == {i for i, r in judged.items() if r.kept}
    texts = by_id(stages[1])
    assert all(kept[i].text == texts[i].text for i in kept if judged[i].removed_words == 0)
    for i in set(judged) - set(kept):
        c = text_stats.counts_of(texts[i].text)
        assert line_rules.base_fails(c) or judged[i].removed_words * 2 >= c["n_words"]


def test_one_document_of_each_group(stages):
    rows = sorted({(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()})
    _, roots = brute_components([t for _, t in rows], 5, 80, 100)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(rows[k][0] for k in set(roots))


def test_leaks_go_and_nothing_else(spark, stages):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def share(text):
        words = text.lower().split()
        seen = {tuple(words[i : i + 8]) for i in range(len(words) - 7)}
        return max(sum(tuple(w[i : i + 8]) in seen for i in range(len(w) - 7)) / max(len(w) - 7, 1) for w in items)

    before, after = by_id(stages[3]), by_id(stages[4])
    gone = set(before) - set(after)
    assert {i for i, r in before.items() if share(r.text) >= 0.75} <= gone
    assert all(share(before[i].text) >= 0.25 for i in gone)


def test_tokens_are_the_librarys(stages):
    texts, coded = by_id(stages[4]), by_id(stages[5])
    assert set(texts) == set(coded)
    for i, r in coded.items():
        ids = reference_ids(texts[i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[i].text.encode()).hexdigest()


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == rows.select("doc_id").distinct().count() > 100


def test_empty_tables_pass_through(spark, stages):
    nothing = stages[0].filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
