"""Every registered query of the subpackage against brute force, on awkward and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from sitewatch.llm import cover_tree
from sitewatch.llm.ngram_lm import PRIOR_2, PRIOR_3
from sitewatch.llm.queries import QUERIES, vocabulary

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
CLASHES = {"fp": 1, "h": 2, "key": 3, "shard": 4, "size": 5, "data": "x", "component_id": 6, "batch": 7, "kept": True, "v": 8, "_tie": 9, "hub": "y", "score": 0.5, "length": 3}


def words_of(text):
    return SPACE.findall((text or "").encode())


def lowered(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words_of(text)]


def made_documents():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = prose(60)
    texts = [None, None, "", "", " \t\n", "one", "One", "a b c", "é ü 漢字 😀 x y z", "nul\x00byte <|endoftext|> and more", "  two  spaces\t\there \n\n end  "]
    base = [prose(80) for _ in range(12)]
    texts += base + base[:4] + [base[0]] * 6
    texts += [b.rsplit(" ", 2)[0] + " changed words" for b in base[4:8]]
    texts += [prose(30) + " " + shared + " " + prose(20 + k) for k in range(5)]
    texts += ["ab" * 200, "ab" * 160 + "c", "\n".join(["Same line again!"] * 30), "# * | <b> $ % &\n" * 4 + "Buy now\n", prose(9), prose(10)]
    texts += [prose(6000), "x" * 9000, "漢字" * 700, prose(10) * 12]
    texts += ["\n".join(prose(12) + "." for _ in range(8)) for _ in range(6)]
    return list(enumerate(texts, 1))


def write_tables(folder, docs, labels, vectors):
    n = len(docs)
    cols = {"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "lang": pa.array([None] * n, pa.string()),
            "source": pa.array(["hot"] * n, pa.string()), "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64())}
    cols |= {k: pa.array([v] * n, pa.from_numpy_dtype(type(v)) if not isinstance(v, str) else pa.string()) for k, v in CLASHES.items() if k not in cols}
    pq.write_table(pa.table(cols), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([x[0] for x in vectors], pa.int64()), "embedding": pa.array([x[1] for x in vectors], pa.list_(pa.float32())), "label": pa.array([None] * len(vectors), pa.int32()), "cell": pa.array([1] * len(vectors), pa.int32())}), folder / "embeddings.parquet")
    none = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    pq.write_table(pa.table({k: pa.array([], t) for k, t in none.items()}), folder / "conversations.parquet")
    return str(folder)


def made_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    near = (x[:20] + 0.15 * rng.normal(size=(20, 8))).astype(np.float32)
    rows = [*x.tolist(), *near.tolist(), *x[:5].tolist(), *(2 * x[5:8]).tolist(), None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, *([[1.0] * 8] * 30)]
    return list(enumerate(rows, 10))


@pytest.fixture(scope="module")
def docs():
    return made_documents()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs):
    labels = [(d, int(len(t or "") % 2)) for d, t in docs] + [(10_000, 1), (1, None), (None, 1), (2, 1), (2, 1)]
    return write_tables(tmp_path_factory.mktemp("messy"), docs, labels, made_vectors())


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="module")
def run(spark, folder):
    cache = {}

    def rows(name):
        if name not in cache:
            cache[name] = QUERIES[name](spark, folder).collect()
        return cache[name]

    return rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op6_compact_windows", "op7_packing", "op8_cover_tree", "op11_conversation_repair", "op13_hard_negatives"}))
def test_a_row_for_each_document(run, docs, name):
    assert sorted(r["doc_id"] for r in run(name)) == [d for d, _ in docs]


def test_shards(run, docs):
    text, slots, size = dict(docs), defaultdict(list), Counter()
    for r in run("op1_shards"):
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_shards_are_even_and_keep_equal_texts_together(spark):
    """No row and no group is over one per cent of a shard: sizes within one per cent of the mean, equal texts in one shard."""
    from sitewatch.llm.sharding import document_shards

    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 300) + str(k) for k in range(6000)]
    texts += [t for t in texts[:200] for _ in range(rng.randint(1, 3))]
    rows = document_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 10).collect()
    size, shards = Counter(), defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        shards[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(size.values()) / 10
    assert max(abs(x - mean) for x in size.values()) <= 0.01 * mean and len(size) == 10
    assert all(len(s) == 1 for s in shards.values())


def test_a_group_larger_than_a_shard_fills_several(spark):
    from sitewatch.llm.sharding import document_shards

    texts = ["same text " * 5] * 3000 + [f"other {k}" for k in range(3000)]
    rows = document_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 8).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(rows) == 6000 and max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8


def test_simhash(run, docs):
    fps = {}
    for d, t in docs:
        w = lowered(t)
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    group = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run("op2_simhash")} == {d: (f"{fps[d]:016x}", group[d]) for d in fps}


def brute_components(ids, linked):
    group = {d: d for d in ids}
    ids = sorted(ids)
    moved = True
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if linked(a, b)]
    while moved:
        moved = False
        for a, b in pairs:
            low = min(group[a], group[b])
            moved |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def test_line_labels(run, docs):
    text = dict(docs)
    for r in run("op3_line_labels"):
        t = text[r["doc_id"]] or ""
        w = words_of(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_viterbi_is_the_best_path():
    from itertools import product

    from sitewatch.llm.crf_quality import FEATURES, LineField

    rng = np.random.default_rng(1)
    for n in range(1, 8):
        f = LineField(rng.normal(size=(2, FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, FEATURES))
        e = x @ f.state.T
        value = lambda p: f.start[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(f.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023,E731
        assert math.isclose(value(f.viterbi(x).tolist()), max(map(value, product((0, 1), repeat=n))))


def test_language_model(run, docs):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    tokens = {d: [*lowered(t), b""] for d, t in docs}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    c[b" "] = sum(not h for h in held.values())  # what stands before a first word
    padded, pairs, triples = {d: [b" ", *ws] for d, ws in tokens.items()}, Counter(), Counter()
    for d, ws in padded.items():
        if not held[d]:
            pairs.update(zip(ws, ws[1:]))
            triples.update(zip(ws, ws[1:], ws[2:]))
    for r in run("op4_language_model"):
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        full = 0.0
        for i, w in enumerate(ws, 1):
            b, a = padded[r["doc_id"]][i - 1], padded[r["doc_id"]][i - 2] if i > 1 else None
            p = (pairs[b, w] + PRIOR_2 * (c[w] + 1) / (n + v + 1)) / (c[b] + PRIOR_2)
            full += math.log10((triples[a, b, w] + PRIOR_3 * p) / (pairs[a, b] + PRIOR_3) if a is not None else p)
        assert abs(r["score"] - full) <= 0.06 * len(ws)  # two quantisation steps of a 20th of a decade, rounded


def test_language_model_is_a_distribution():
    """In every context the probabilities of all words and an unknown one sum to one, but for the quantisation."""
    from sitewatch.llm.ngram_lm import ASKED, ANSWERED, Batch, answers, log_probabilities

    rng = random.Random(5)
    train = [" ".join(rng.choices("abc", [5, 3, 1], k=rng.randint(1, 9))).encode() for _ in range(60)]
    contexts = [f"{x} {y}" for x in "abc" for y in "abc"]
    asked = [f"{c} {w}".encode() for c in contexts for w in ("a", "b", "c", "never", "")]
    b = Batch(train + asked, np.array([True] * len(train) + [False] * len(asked)), 3, {})
    questions = [dict(zip(["shard", *ASKED], q)) | {"batch": 0} for q in b.questions()]
    got = [dict(zip(["batch", "shard", *ANSWERED, "n", "v"], x)) for q in questions for x in answers([q], (PRIOR_2, PRIOR_3))]
    n, v = sum(g["n"] for g in got), sum(g["v"] for g in got)
    assert (n, v) == (sum(len(t.split()) + 1 for t in train), 4)
    p = 10 ** log_probabilities(b, got, n, v)[2][b.heads[len(train) :] + 2]  # of each third word
    assert np.abs(p.reshape(-1, 5).sum(1) - 1).max() < 0.06


def test_a_frequent_first_word_lies_in_several_shards(spark, folder, run, monkeypatch):
    """The same scores whether the followers of frequent words are dealt or not."""
    from sitewatch.llm import ngram_lm

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r["doc_id"]: tuple(r) for r in run("op4_language_model")}
    monkeypatch.setattr(ngram_lm, "OFTEN", 1)
    dealt = ngram_lm.hot_words(docs, 1000, 1000)
    assert max(dealt.values()) > 1
    monkeypatch.setattr(ngram_lm, "hot_words", lambda docs, total, shards: dealt)
    for r in ngram_lm.language_model_scores(docs).collect():
        assert tuple(r)[:6] == pytest.approx(want[r["doc_id"]][:6]) and r["score"] == pytest.approx(want[r["doc_id"]][6])


def test_elias_fano():
    from sitewatch.llm.ngram_lm import EliasFano

    rng = np.random.default_rng(2)
    for high in (1, 100, 1 << 20, 1 << 48, 1 << 63):
        for n in (0, 1, 2, 500):
            x = np.sort(rng.integers(0, high, n)).astype(np.uint64)
            e = EliasFano(x)
            assert (e.decode() == x).all()
            lo, hi = np.sort(rng.integers(0, n + 1, (2, 300)), 0)
            asked = np.where(rng.random(300) < 0.5, x[rng.integers(0, n, 300)] if n else 0, rng.integers(0, high, 300)).astype(np.uint64)
            for a, b, t, got in zip(lo.tolist(), hi.tolist(), asked, e.find(lo, hi, asked).tolist()):
                inside = a + np.flatnonzero(x[a:b] == t)
                assert got == (inside[0] if len(inside) else -1)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(run, docs, tokenizer):
    text = dict(docs)
    for r in run("op5_trie_bpe"):
        ids = tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_packing(run, docs, tokenizer):
    rows, found, places = run("op7_packing"), defaultdict(list), defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(found) == {d for d, _ in docs}
    total = 0
    for d, t in docs:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        total += len(ids)
        for k, r in enumerate(sorted(found[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids) and len(found[d]) == -(-len(ids) // 2048)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 2


def lower_bound(counts, capacity, bound):
    """The dual's bound, or the classical one by pieces too long to share a sequence, whichever is larger."""
    best = bound
    for a in range(0, capacity // 2 + 1, 8):
        big = sum(n for x, n in counts.items() if x > capacity - a)
        middle = {x: n for x, n in counts.items() if capacity // 2 < x <= capacity - a}
        small = sum(x * n for x, n in counts.items() if a <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in middle.items())
        best = max(best, big + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    return best


@pytest.mark.parametrize("name, gap", [("uniform", 0.01), ("500 to 899", 0.03), ("700 to 1399", 0.01), ("lognormal", 0.01), ("few pieces", 0.015), ("five lengths", 0.01)])
def test_packing_plans_against_bounds(name, gap):
    from sitewatch.llm.packing import _best_fit, fractional_patterns, packing_plan

    rng = np.random.default_rng(0)
    lengths = {
        "uniform": lambda: rng.integers(1, 2049, 200_000), "500 to 899": lambda: rng.integers(500, 900, 200_000), "700 to 1399": lambda: rng.integers(700, 1400, 200_000),
        "lognormal": lambda: np.clip(rng.lognormal(6, 1, 200_000), 1, 2048).astype(int), "few pieces": lambda: rng.integers(1, 2049, 5000), "five lengths": lambda: rng.choice([300, 500, 700, 900, 1100], 5000)}[name]()
    counts = Counter(lengths.tolist())
    plan, held = packing_plan(counts), Counter()
    for pattern, n in plan:
        assert sum(x * m for x, m in pattern.items()) <= 2048 and n > 0
        for x, m in pattern.items():
            held[x] += m * n
    used = sum(n for _, n in plan)
    assert held == counts and used <= sum(n for _, n in _best_fit(Counter(counts), 2048))
    assert used <= (1 + gap) * lower_bound(counts, 2048, max(fractional_patterns(dict(counts), 2048)[1], sum(x * n for x, n in counts.items()) / 2048))


def test_knapsack_against_all_patterns():
    from itertools import product

    from sitewatch.llm.packing import knapsack

    rng = np.random.default_rng(4)
    for _ in range(20):
        worth = np.where(rng.random(25) < 0.3, rng.random(25), 0)
        worth[0] = 0
        best, _ = knapsack(worth, 24)
        lengths = np.flatnonzero(worth)
        every = [sum(worth[x] * k for x, k in zip(lengths, c)) for c in product(*[range(24 // x + 1) for x in lengths]) if sum(x * k for x, k in zip(lengths, c)) <= 24] if 0 < len(lengths) <= 7 else [best[24]]
        assert math.isclose(best[24], max(every))


def test_cover_tree(run):
    vectors = dict(made_vectors())
    unit = {}
    for k, v in vectors.items():
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.sqrt((x * x).sum())
    linked = lambda a, b: a in unit and b in unit and unit[a] @ unit[b] >= 0.9
    group = brute_components(vectors, linked)
    want = {k: (sum(linked(k, o) for o in vectors if o != k), group[k], group[k] == k) for k in vectors}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in run("op8_cover_tree")} == want


def test_classifier(run, docs):
    for r in run("op9_ftrl"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_follow_the_regularised_leader_step_by_step():
    """The same weights as the update rule written out for one coordinate at a time."""
    from sitewatch.llm.ftrl import features, fit_ftrl

    texts, y = ["good words here", "bad junk junk", "good good prose", "", "junk again"], np.array([1, 0, 1, 1, 0], float)
    slots, alpha, beta, l1, l2 = 64, 2.0, 1.0, 1e-4, 1e-4
    z, n, order = Counter(), Counter(), np.random.default_rng(0)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    slot, ends = features(texts, slots)
    for _ in range(3):
        for k in order.permutation(len(texts)):
            grams = slot[ends[k] : ends[k + 1]].tolist()
            x = {i: 8.0 * c / len(grams) for i, c in Counter(grams).items()} | {slots: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y[k]) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = fit_ftrl(texts, y, slots=slots)
    assert np.allclose(got, [weight(i) for i in range(slots + 1)], atol=1e-5)


def test_kept_is_the_base_rules_and_the_content_share(spark, run, docs, folder):
    from sitewatch.llm.crf_quality import CONTENT_SHARE, lines_of, train

    field = train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    text = dict(docs)
    for r in run("op3_line_labels"):
        x, words, _ = lines_of(text[r["doc_id"]])
        share = sum(w for w, s in zip(words.tolist(), field.viterbi(x).tolist()) if s) / max(1, r["n_words"])
        assert math.isclose(r["content_share"], share) and r["kept"] == (not r["base_failed"] and share >= CONTENT_SHARE)


def test_classifier_on_held_out_labels(spark):
    where = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in QUERIES["op9_ftrl"](spark, where).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.8


def brute_kept(docs, width=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            s = data[i : i + width]
            if s in seen:
                gone[i : i + width] = True
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_arrays(run, docs):
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op10_suffix_array")} == brute_kept(docs)


@pytest.mark.parametrize("footer", [60, 90, 150])
def test_a_frequent_gram_is_dealt_to_many_shards(spark, monkeypatch, footer):
    """A footer in all documents, each in other surroundings: results as by brute force, no group holds more than a few of its segments."""
    from sitewatch.llm import suffix_dedup

    rng, largest = random.Random(footer), []
    prose = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    end = prose(footer)
    docs = [(d, prose(rng.randint(80, 160)) + end + prose(rng.randint(80, 160))) for d in range(400)]
    docs += [(d + 400, t if d % 2 else prose(30) + t[20:]) for d, t in docs[:60]]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = suffix_dedup.without_repeats(rows).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == brute_kept(docs)
    data = rows.select("doc_id", rows["text"].cast("binary").alias("data"))
    total = sum(len(t) for _, t in docs)
    few = suffix_dedup.hot_keys(data, 100, total, 8 << 10)
    assert 1 <= len(few) < 10
    monkeypatch.setattr(suffix_dedup, "hot_keys", lambda docs, width, total, most: few)
    again = suffix_dedup.without_repeats(rows).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    weight = Counter()
    for text in {t for _, t in docs}:
        key, lo, hi, own = suffix_dedup.segment_bounds(text.encode(), 100)
        key, lo, hi, _, h = suffix_dedup.hashed(text.encode(), key >> np.uint64(16), lo, hi, own, few, 100)
        largest += [(k, x, b - a) for k, x, a, b in zip(key.tolist(), h.tolist(), lo.tolist(), hi.tolist())]
    for k, _, n in set(largest):
        weight[k] += n
    assert max(weight.values()) < 8 << 10


def brute_suffixes(t, depth):
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    shared = lambda a, b: next((k for k in range(min(depth, len(t))) if a + k >= len(t) or b + k >= len(t) or t[a + k] != t[b + k]), depth)
    return order, [0] + [shared(a, b) for a, b in zip(order, order[1:])]


def test_induced_suffix_array():
    """Suffixes and their common prefixes, of random and of repetitive strings."""
    from sitewatch.llm.suffix_dedup import induced_suffix_array

    rng = np.random.default_rng(5)
    strings = [rng.integers(1, high, n) for high in (2, 4, 200) for n in (1, 2, 3, 50, 400)]
    strings += [np.tile(rng.integers(1, 5, k), 60 // k) for k in (1, 2, 3, 7)] + [np.concatenate([x, rng.integers(1, 9, 5), x, x[3:]]) for x in (rng.integers(1, 6, 80),)]
    for x in strings:
        t = np.append(x, 0)
        sa, lcp = induced_suffix_array(t)
        assert (sa.tolist(), lcp.tolist()) == brute_suffixes(t, 30_000)


def test_common_prefixes_up_to_a_depth():
    """Beyond the depth any order of equal prefixes will do; up to it order and common prefixes hold."""
    from sitewatch.llm.suffix_dedup import induced_suffix_array

    rng = np.random.default_rng(9)
    for _ in range(30):
        x = rng.integers(1, 4, 60)
        t = np.append(np.concatenate([x, rng.integers(1, 4, 20), x, x[10:], np.ones(30, int)]), 0)
        sa, lcp = induced_suffix_array(t, 12)
        heads = [t[i : i + 12].tolist() for i in sa]
        assert heads == sorted(heads) and sorted(sa.tolist()) == list(range(len(t)))
        assert lcp[1:].tolist() == [next((k for k in range(12) if k >= min(len(a), len(b)) or a[k] != b[k]), 12) for a, b in zip(heads, heads[1:])]


def test_induced_suffix_array_spills(monkeypatch):
    from sitewatch.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "QUEUE_MEMORY", 256)
    t = np.append(np.random.default_rng(6).integers(1, 5, 2000), 0)
    sa, lcp = suffix_dedup.induced_suffix_array(t)
    assert (sa.tolist(), lcp.tolist()) == brute_suffixes(t, 30_000)


def test_queues_of_a_full_shard_use_the_disk(monkeypatch):
    """At the sizes that run in production."""
    from sitewatch.llm import suffix_dedup

    spills = []
    spill = suffix_dedup.BucketQueue._spill
    monkeypatch.setattr(suffix_dedup.BucketQueue, "_spill", lambda q: (spills.append(q.held), spill(q)))
    t = np.append(np.random.default_rng(6).integers(2, 60, 2_000_000).astype(np.int16), 0).astype(np.int16)
    sa, lcp = suffix_dedup.induced_suffix_array(t, 100)
    assert spills and len(np.unique(sa)) == len(t)
    some = np.random.default_rng(1).integers(1, len(sa), 2000)
    for i in some.tolist():
        a, b = t[sa[i - 1] :][:100].tolist(), t[sa[i] :][:100].tolist()
        assert a <= b and lcp[i] == next((k for k in range(100) if k >= min(len(a), len(b)) or a[k] != b[k]), 100)


def test_compact_windows_brute_force():
    from sitewatch.llm.compact_windows import compact_windows

    h = np.random.default_rng(8).permutation(300).astype(np.uint64)
    value, centre, left, right = compact_windows(h, 20)
    got = set(zip(value.tolist(), left.tolist(), right.tolist()))
    assert (h[centre] == value).all()
    want = set()
    for c, x in enumerate(h):
        lo, hi = c, c
        while lo and h[lo - 1] > x:
            lo -= 1
        while hi + 1 < len(h) and h[hi + 1] > x:
            hi += 1
        if hi - lo + 1 >= 20:
            want.add((int(x), lo, hi))
    assert got == want


def test_near_passages(run, docs):
    text, rows = dict(docs), run("op6_compact_windows")
    assert rows
    for r in rows:
        a, b = lowered(text[r["doc_id"]])[r["first_word"] : r["end_word"]], lowered(text[r["other_id"]])[r["other_first"] : r["other_end"]]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(b) >= 50
        assert math.isclose(len(x & y) / len(x | y), r["similarity"]) and r["similarity"] >= 0.8
    linked = brute_components(dict(docs), lambda a, b: any({r["doc_id"], r["other_id"]} == {a, b} for r in rows))
    with_passage = [d for d, t in docs if t and t.count(" ") in range(109, 114)]  # 30, 60 and 20 to 24 words
    copies = [d for d, t in docs if t and t == docs[11][1]]
    for group in (with_passage, copies):
        assert len(group) > 4 and len({linked[d] for d in group}) == 1


def test_passage_over_fifty_words_is_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    from sitewatch.llm.compact_windows import near_passages

    rows = []
    for k in range(60):
        passage = [word() for _ in range(55 + 3 * k)]
        changed = list(passage)
        changed[len(changed) // 2] = word()
        for side, p in enumerate((passage, changed if len(passage) > 90 else passage)):
            rows.append((2 * k + side, " ".join([word() for _ in range(rng.randint(0, 300))] + p + [word() for _ in range(rng.randint(0, 300))])))
    got = {(r["doc_id"], r["other_id"]) for r in near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {tuple(sorted(p)) for p in got} <= {(2 * k, 2 * k + 1) for k in range(60)}
    assert len({tuple(sorted(p)) for p in got}) >= 54


def test_short_passages_with_a_changed_word_against_brute_force():
    """One word changed at every position: found wherever two aligned stretches of 50 words or more reach 0.8."""
    from sitewatch.llm.compact_windows import passages, shingles

    word = lambda s, k: f"{s}{k}"
    for n in range(50, 61):
        for at in range(n):
            p = [word("p", k) for k in range(n)]
            q = [*p[:at], "changed", *p[at + 1 :]]
            a, b = (shingles(" ".join([word(s, k) for k in range(20)] + x + [word(s, k) for k in range(20, 40)])) for s, x in (("a", p), ("b", q)))
            brute = 0
            for i in range(len(a)):
                for j in range(i + 46, min(len(a), i + n) + 1):
                    x, y = set(a[i:j].tolist()), set(b[i:j].tolist())
                    brute = max(brute, len(x & y) / len(x | y))
            got = passages(a, b, 46, 0.8)
            assert bool(got) == (brute >= 0.8), (n, at)
            for i, j, k, m, score in got:
                x, y = set(a[i:j].tolist()), set(b[k:m].tolist())
                assert j - i >= 46 and m - k >= 46 and math.isclose(score, len(x & y) / len(x | y))


def test_a_gap_in_a_long_passage_does_not_cut_it():
    from sitewatch.llm.compact_windows import passages

    a = np.arange(1, 301, dtype=np.uint64)
    b = a.copy()
    b[30:46] += np.uint64(10_000)
    assert passages(a, b, 46, 0.8) == [(0, 300, 0, 300, 284 / 316)]


@pytest.mark.parametrize("guests", [0, 1])
def test_cover_tree_blocks_against_all_pairs(guests):
    """Scattered, grouped, tight and parallel vectors, within a block and between two."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=(30, 16))
    near = np.repeat(c, 20, 0) + rng.normal(size=(600, 16)) * rng.choice([0.01, 0.2, 0.3], (600, 1))
    x = np.concatenate([rng.normal(size=(1500, 16)), near, c[0] + rng.normal(size=(500, 16)) * 0.05, c[1] * rng.uniform(0.5, 2, (400, 1))])
    rng.shuffle(x)
    n, weight, home = len(x), rng.integers(1, 4, len(x)), np.arange(len(x)) < (1300 if guests else len(x))
    norm = np.sqrt((x * x).sum(1))
    linked = (x @ x.T) / norm[:, None] / norm >= 0.9
    np.fill_diagonal(linked, False)
    if guests:
        linked &= home[:, None] != home
    block = pd.DataFrame({"guests": guests, "a": 0, "b": 0, "block": 0, "home": home, "rep": np.arange(n), "weight": weight, "v": list(x)})
    found = cover_tree._task(block, 0.9, float(np.sqrt(0.2)))
    counts, edges = found[found["w"].isna()], found[~found["w"].isna()]
    got = np.zeros(n, np.int64)
    np.add.at(got, counts["u"].to_numpy(), counts["n"].to_numpy())
    assert (got == linked @ weight).all()

    def roots(pairs):
        top = list(range(n))
        for a, b in pairs:
            while top[a] != a:
                a = top[a]
            while top[b] != b:
                b = top[b]
            top[max(a, b)] = min(a, b)
        for i in range(n):
            top[i] = top[top[i]]
        return top

    assert roots(zip(edges["u"].tolist(), edges["w"].astype(int).tolist())) == roots(zip(*(i.tolist() for i in np.nonzero(linked))))
