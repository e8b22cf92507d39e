"""Repeated rows, ids on several texts, null ids and texts of two megabytes: every query and every stage of the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from sitewatch.llm.queries import QUERIES, vocabulary
from test_operators import brute_components, brute_kept, lowered, made_documents, words_of, write_tables

LONG = [" " * 2_000_000, "x" * 2_000_000, "\n" * 1_500_000 + "end", "word " * 400_000]


@pytest.fixture(scope="module")
def docs():
    some = made_documents()
    text = dict(some)
    some += [(1000 + i, t) for i, t in enumerate(LONG)]
    some += [some[20]] * 4 + [some[2]] * 3  # repeated rows, one of them an empty text
    some += [(some[21][0], text[41] + " and more"), (some[22][0], None)]  # ids with another text
    some += [(None, text[36]), (None, text[36]), (None, None), (None, "no id " * 40)]
    return some


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs):
    labels = [(d, int(len(t or "") % 2)) for d, t in docs if d] + [(None, 1), (1, None)]
    return write_tables(tmp_path_factory.mktemp("awkward"), docs, labels, [])


@pytest.fixture(scope="module")
def run(spark, folder):
    cache = {}

    def rows(name):
        if name not in cache:
            cache[name] = QUERIES[name](spark, folder).collect()
        return cache[name]

    return rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op6_compact_windows", "op7_packing", "op8_cover_tree", "op11_conversation_repair", "op13_hard_negatives"}))
def test_a_row_for_each_row(run, docs, name):
    assert Counter(r["doc_id"] for r in run(name)) == Counter(d for d, _ in docs)


def test_shards(run, docs):
    slots = defaultdict(list)
    for r in run("op1_shards"):
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = lambda rows: Counter((d, n, c) for d, n, c in rows)
    assert sizes((r["doc_id"], r["size"], r["text_crc32"]) for r in run("op1_shards")) == sizes((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)


def test_simhash(run, docs):
    fps = {}
    for i, (_, t) in enumerate(docs):
        w = lowered(t)
        grams = Counter(b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else {}
        ones = Counter()
        for g, n in grams.items():
            h = xxhash.xxh64_intdigest(g, 42)
            ones.update({b: n for b in range(64) if h >> b & 1})
        total = sum(grams.values())
        fps[i] = sum(1 << b for b in range(64) if 2 * ones[b] > total)
    group = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    least = {}
    for i, g in group.items():
        d = docs[i][0]
        least[g] = d if least.get(g) is None else min(least[g], d if d is not None else least[g])
    want = Counter((docs[i][0], f"{fps[i]:016x}", least[group[i]]) for i in fps)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run("op2_simhash")) == want


def test_line_labels(run, docs):
    want = Counter((d, len(words_of(t)), sum(len(w.decode()) for w in words_of(t))) for d, t in docs)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"]) for r in run("op3_line_labels")) == want


def test_language_model(run, docs):
    teaches = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    total = sum(len(words_of(t)) + 1 for d, t in docs if teaches(d))
    assert {r["train_tokens"] for r in run("op4_language_model")} == {total}
    assert Counter((r["doc_id"], r["n_tokens"]) for r in run("op4_language_model")) == Counter((d, len(words_of(t)) + 1) for d, t in docs)


@pytest.fixture(scope="module")
def ids_of(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return {x: t.encode(x or "", add_special_tokens=False).ids for _, x in docs}


def test_bpe(run, docs, ids_of):
    want = Counter((d, len(ids_of[t]), hashlib.sha256(np.array(ids_of[t], "<u4").tobytes()).hexdigest()) for d, t in docs)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in run("op5_trie_bpe")) == want


def test_passages_have_ids(run, docs):
    ids = {d for d, _ in docs}
    assert all(r["doc_id"] in ids and r["other_id"] in ids and r["doc_id"] is not None for r in run("op6_compact_windows"))


def test_packing(run, docs, ids_of):
    want, places = Counter(), defaultdict(list)
    for d, t in docs:
        ids = np.array([*ids_of[t], 0], "<u4")
        start = 0
        for k in range(-(-len(ids) // 2048)):
            end = start + (len(ids) % 2048 or 2048) if not k else start + 2048
            want[(d, k, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
            start = end
    rows = run("op7_packing")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_classifier(run, docs):
    for r in run("op9_ftrl"):
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_substrings(run, docs):
    """Rows of one id and text are at one place; an id's other texts, and rows without an id after all others, have places of their own."""
    one = [x for x in docs if Counter(d for d, _ in set(docs))[x[0]] == 1]  # of one id's texts either may come first
    del one
    places = sorted(set(docs), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    kept = brute_kept([(i, t) for i, (_, t) in enumerate(places)])
    number = {p: i for i, p in enumerate(places)}
    several = {d for d, n in Counter(d for d, _ in places).items() if n > 1}
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in run("op10_suffix_array") if r["doc_id"] not in several)
    assert got == Counter((d, *kept[number[d, t]][:2]) for d, t in docs if d not in several)


def test_vectors_of_one_id(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (7, None)]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())}), tmp_path / "embeddings.parquet")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op8_cover_tree"](spark, str(tmp_path)).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (None, 0, None, True), (7, 0, 7, True)])


def test_every_stage(spark, docs, folder, tmp_path):
    """No stage fails, multiplies rows, or lets an exact copy through behind the near-duplicates."""
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, folder).write.parquet(str(tmp_path / name))
        before, rows = rows, spark.read.parquet(str(tmp_path / name))
        if name == "simhash_near_duplicates":
            texts = [r["text"] for r in rows.select("text").collect()]
            assert len(texts) == len(set(texts))
        if name == "suffix_array_dedup":
            assert rows.count() == before.count()
        elif name != "best_fit_packing":
            assert rows.exceptAll(before).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_alone(spark, folder, stage, tmp_path):
    """On the whole awkward table, as no stage before it has cleaned it."""
    stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).write.parquet(str(tmp_path / "out"))
