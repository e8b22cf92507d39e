"""The pipeline's stages: each takes what its predecessor kept, and what they keep equals brute force."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from sitewatch.llm import crf_quality, ftrl, simhash, suffix_dedup
from sitewatch.llm.queries import vocabulary
from test_operators import brute_components, brute_kept, made_documents, write_tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{DATA}/documents.parquet")], None
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_rejections(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ids = [sorted(r["doc_id"] for r in df.collect()) for df in stages[:5]]
    assert ids[1] == sorted(r["doc_id"] for r in crf_quality.quality_rules(stages[0], labels).where("kept").collect())
    assert ids[2] == sorted(r["doc_id"] for r in ftrl.quality_scores(stages[1], labels).where("predicted = 1").collect())
    assert ids[3] == sorted(r["doc_id"] for r in simhash.near_duplicates(stages[2]).where("doc_id = component_id").collect())
    assert ids[4] == ids[3] and 0 < len(ids[3]) <= len(ids[2]) <= len(ids[1]) < len(ids[0])


def test_substrings_and_packing(stages):
    from tokenizers import Tokenizer

    before = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    after = {r["doc_id"]: r for r in stages[4].collect()}
    want = brute_kept(before)
    for d, r in after.items():
        assert len(r["text"].encode()) <= want[d][0] - want[d][1] and r["n_chars"] == len(r["text"])
    t, sums = Tokenizer.from_file(vocabulary()), {}
    for r in stages[5].collect():
        sums[r["doc_id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    for d, r in after.items():
        ids, k, at = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 0], "<u4"), 0, 0
        while at < len(ids):
            start, length, crc = sums[d, k]
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            k, at = k + 1, at + length


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(tmp_path, [], [], [])).collect() == []


@pytest.fixture(scope="module")
def messy(tmp_path_factory):
    """The awkward table with repeated rows, a doc_id with two texts and null doc_ids, one of them a copy."""
    docs = made_documents()
    text = dict(docs)
    docs += [docs[20]] * 3 + [docs[40], (docs[21][0], text[40] + " " + text[41]), (None, text[36]), (None, text[36] + " and " + text[38]), (None, "a row without an id " * 3 + text[35]), (None, "a row without an id " * 3 + text[35])]
    labels = [(d, int(len(t or "") % 2)) for d, t in docs if d]
    return docs, write_tables(tmp_path_factory.mktemp("messy"), docs, labels, [])


def in_order(docs):
    """The distinct rows, null doc_ids last."""
    return sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_one_document_of_each_group(spark, messy):
    docs, folder = messy
    got = simhash.keep_first(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = in_order(docs)
    fps = {i: simhash.simhash(t) for i, (_, t) in enumerate(rows)}
    group = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    ids = lambda some: sorted((d or 0) for d, _ in some)  # noqa: E731  # of one doc_id's texts either may come first
    assert len(kept) == len(set(kept)) and set(kept) <= set(docs)
    assert ids(kept) == ids(rows[i] for i in fps if group[i] == i)


def test_substrings_of_repeated_rows_and_rows_without_id(spark, messy):
    docs, folder = messy
    got = suffix_dedup.shortened(spark.read.parquet(f"{folder}/documents.parquet"))
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == sorted((d or 0) for d, _ in docs)
    rows = [(d, t) for d, t in in_order(docs) if d != docs[21][0] or t == docs[21][1]]
    want = dict(enumerate(rows))
    removed = brute_kept([(i, t) for i, (_, t) in want.items()])
    few = spark.createDataFrame([(d, t) for d, t in docs if d != docs[21][0] or t == docs[21][1]], "doc_id bigint, text string")
    sizes = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.without_repeats(few).collect() if r["doc_id"] is not None}
    assert sizes == {(d, *removed[i][:2]) for i, (d, _) in want.items() if d is not None}
    assert suffix_dedup.without_repeats(few).count() == few.count()


def test_every_stage_on_the_messy_table(spark, messy, tmp_path):
    docs = before = spark.read.parquet(f"{messy[1]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, messy[1]).write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        if name == "suffix_array_dedup":
            assert docs.count() == before.count()
        elif name != "best_fit_packing":
            assert docs.exceptAll(before).count() == 0
    assert docs.where("piece = 0").count() == before.count()
