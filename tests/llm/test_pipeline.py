"""The corpus pipeline, stage by stage, against what each operator says of the stage's input."""

import random

import pytest

import corpus_pipeline
from loamgrid.llm import passages, quality_rules, simhash
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_decisions(spark, stages):
    rules = quality_rules.quality_rules(stages["documents"]).where("kept")
    assert ids(stages["quality_rules"]) == ids(rules)
    assert ids(stages["quality_classifier"]) <= ids(stages["quality_rules"])
    near = simhash.near_duplicates(stages["quality_classifier"]).collect()
    assert ids(stages["simhash_near_dedup"]) == {r.component_id for r in near}
    spans = passages.repeated_passages(stages["simhash_near_dedup"]).collect()
    before = {r.doc_id: r for r in stages["simhash_near_dedup"].collect()}
    after = {r.doc_id: r for r in stages["substring_dedup"].collect()}
    touched = {r.doc_id for r in spans}
    assert all(after[d] == before[d] for d in before if d not in touched)
    for d in touched & set(after):
        gone = {i for r in spans if r.doc_id == d for i in range(r.start_word, r.end_word)}
        assert after[d].text.split() == [w for i, w in enumerate(before[d].text.split()) if i not in gone]
        assert after[d].n_chars == len(after[d].text)
    packed = stages["best_fit_packing"]
    assert ids(packed) == set(after)


def test_good_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    good = ids(labels) & ids(stages["quality_rules"])
    assert len(good & ids(stages["quality_classifier"])) >= 0.99 * len(good)


def test_classifier_stage_knows_what_earlier_stages_rejected(spark):
    """Junk put into the second stage's input goes, though none of it is left to learn from."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    junk = docs.join(bad, "doc_id", "left_semi").selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")
    left = corpus_pipeline.STAGES[1][1](spark, junk, SF)
    assert left.count() <= 0.1 * junk.count()


def test_run_equals_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages["best_fit_packing"].collect()))


def test_substring_stage_cuts_what_earlier_documents_hold_in_parts(spark):
    """Documents 0 to 5 hold every gram of 60 words, none of them 50: the second that holds all loses it."""
    rnd = random.Random(27)
    fill = lambda: prose(rnd, 40, 10**6)
    words = prose(rnd, 60, 10**6).split()
    held = [*(words[i : i + 34] for i in range(0, 33, 6)), words, words]
    rows = [(i, f"{fill()} {' '.join(own)} {fill()}", "en", "s", 0) for i, own in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: r.text.split() for r in corpus_pipeline.STAGES[3][1](spark, df, SF).collect()}
    assert all(left[r[0]] == r[1].split() for r in rows[:-1])
    assert left[len(held) - 1] == [w for w in rows[-1][1].split() if w not in words]
