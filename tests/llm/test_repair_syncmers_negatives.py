"""Conversation repair, syncmer fingerprints and hard negatives against brute force, and against their SQL."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from sitewatch.llm import conversation_repair, hard_negatives, syncmers
from sitewatch.llm.queries import ORACLE_SQL, QUERIES
from test_operators import made_documents, write_tables

SPACE = " \t\n\x0b\x0c\r"


def dijkstra(rows):
    """Cheapest edits of [(initial, fault)], by uniform search over (cost, audit)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        for initial in "ua":
            if (q, initial) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[q, initial]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                if (q, initial) in step:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, step[q, initial]))
                for new in "ua":
                    if (q, new) in step:
                        heapq.heappush(heap, (cost + cut + 1, audit + "R", i + 1, step[q, new]))


def test_signatures_against_a_search():
    rng = random.Random(5)
    words = {"s": ("s", None), "u": ("u", None), "a": ("a", None), "x": ("x", None), "S": ("s", "truncated"), "U": ("u", "truncated"), "A": ("a", "truncated"), "X": ("x", "truncated"), "d": ("u", "blank")}
    some = ["".join(rng.choices("suaxSUAXd", [1, 4, 4, 1, 1, 2, 2, 1, 2], k=rng.randint(0, 11))) for _ in range(400)]
    for s in [*some, "ua" * 40 + "u" * 5 + "au" * 30, "d" * 70, "U" * 33]:
        assert conversation_repair.cheapest(s) == dijkstra([words[c] for c in s]), s


def test_a_very_long_signature():
    cost, audit = conversation_repair.cheapest("s" + "ua" * 200_000 + "d")
    assert (cost, audit) == (2, "K" * 400_001 + "D")


def brute_repair(rows):
    """From input rows (conv_id, turn, role, text) to the contract's rows."""
    after, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        after[conv]
        if pick == 1:
            text = ""
        if pick == 2:
            text = re.sub("[.!?]", "", text)
        if pick == 4:
            role = "user"
        after[conv] += [(turn, role, text)] * (0 if pick == 0 else 2 if pick == 3 else 1)
    for conv, items in after.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, marked, n = set(), [], Counter()
        for _, role, text in items:
            end = text.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            marked.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        turns = {t for t, _, _ in items if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit = dijkstra(marked)
        lines, q, rest = [], 0, iter(items)
        for e in audit:
            role, text = ("", "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            if e in "RI":
                role = "assistant" if q == 2 else "user"
            q = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk(tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn * (2 if rng.random() < 0.1 else 1), role, rng.choice(["Yes.", "No!", "Well?\n ", "cut off", "", " \t", "é. 漢字。", f"Answer {turn}. "])))
    rows += [(200, None, "user", "a."), (200, None, "user", "a."), (200, 3, None, "b!"), (200, 3, "tool", None), (200, 9, "system", "z."), (201, None, None, None), (None, 0, "user", "x."), (None, None, "assistant", "y.")]
    rows += [(300, 1, "user", "same.")] * 40 + [(301, k % 700, ("assistant", "user")[k % 2], f"t{k}.") for k in range(3000)] + [(302, 0, "system", "long. " * 200_000)]
    rows += [(400 + k, t, "user", "gone.") for k in range(60) for t in (0,)]
    folder = tmp_path_factory.mktemp("talk")
    columns = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    table = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns.items())}
    table |= {"copies": pa.array([7] * len(rows)), "digest": pa.array(["x"] * len(rows)), "part": pa.array([0.5] * len(rows)), "audit": pa.array([None] * len(rows), pa.string())}
    pq.write_table(pa.table(table), folder / "conversations.parquet")
    return str(folder), rows


def test_repairs(spark, talk):
    folder, rows = talk
    got = QUERIES["op11_conversation_repair"](spark, folder)
    assert dict(got.dtypes) | {"conv_id": "bigint"} == dict(got.dtypes)
    rows_got = got.collect()
    want = brute_repair(rows)
    assert len(rows_got) == len(want)
    for r in rows_got:
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == want[r["conv_id"]], r["conv_id"]
    assert any(x[6] == "" for x in want.values())  # a conversation of which nothing is left


def test_repaired_rows_spell_the_digest(spark, talk):
    folder, rows = talk
    input_ = conversation_repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    lines = defaultdict(list)
    for r in conversation_repair.repaired_rows(input_).orderBy("conv_id", "place").collect():
        assert r["place"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, found in brute_repair(rows).items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == found[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[conv]))


def by_sql(name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    return Counter(tuple(str(v) for _, v in sorted(zip(names, r))) for r in cursor.fetchall())


def by_spark(name, spark, folder):
    df = QUERIES[name](spark, folder)
    return Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name, tables", [("op11_conversation_repair", ["conversations"]), ("op13_hard_negatives", ["embeddings"])])
def test_sql(spark, name, tables):
    folder = "/root/testdata/sf0.001"
    assert by_spark(name, spark, folder) == by_sql(name, folder, tables)


# fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    """Spark's xxhash64 of strings or longs: each hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed)


def brute_anchors(text, words=syncmers.WORDS, inner=syncmers.INNER):
    w = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    if len(w) < words:
        return [(0, chained([text]))] if text else []
    h = [chained(w[i : i + inner]) for i in range(len(w) - inner + 1)]
    n = words - inner
    covering = sorted({*range(0, n + 1, inner), n})
    return [(i, chained([h[i + k] for k in covering])) for i in range(len(w) - words + 1) if min(h[i : i + n + 1]) in (h[i], h[i + n])]


def brute_sketch(text):
    return sorted({h & 0xFFFFFFFF for _, h in brute_anchors(text)})[: syncmers.KEPT]


def brute_likeness(a, b):
    both = sorted({*a, *b})[: syncmers.KEPT]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


def brute_fingerprints(docs):
    places = sorted({(d, t or "") for d, t in docs}, key=lambda x: (x[0] is None, -(x[0] or 0), chained([x[1]])))
    out = {}
    for k, (d, t) in enumerate(places):
        following = places[(k + 1) % len(places)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        a, b, c = map(brute_sketch, (t, edited, following))
        spell = lambda x: "".join(f"{h:08x}" for h in x)
        out[d, t] = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), spell(a), spell(b), brute_likeness(a, b), brute_likeness(a, c))
    return Counter(out[d, t or ""] for d, t in docs)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def awkward_documents():
    some = made_documents()
    some += [some[20]] * 4 + [some[2]] * 3 + [(some[21][0], some[41][1] + " and more"), (some[22][0], None)]
    return some + [(None, some[36][1]), (None, some[36][1]), (None, None), (900, "word " * 40_000), (901, "y" * 300_000), (902, " " * 50_000)]


@pytest.mark.parametrize("docs", [made_documents(), awkward_documents(), [(5, "only one document, its own next")], [(1, None), (2, "")]], ids=["plain", "awkward", "one", "empty texts"])
def test_fingerprints(spark, tmp_path, docs):
    folder = write_tables(tmp_path, docs, [], [])
    got = QUERIES["op12_syncmers"](spark, folder)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute_fingerprints(docs)


def test_fingerprints_of_many_partitions(spark):
    """Every document's next is found across the borders of a range sort."""
    rng = random.Random(4)
    docs = [(d, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 12)))) for d in rng.sample(range(-5000, 5000), 900)]
    got = syncmers.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(23))
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute_fingerprints(docs)


@pytest.mark.parametrize("words, inner", [(3, 1), (5, 3), (5, 2), (8, 3)])
def test_anchors(spark, words, inner):
    docs = made_documents()
    rows = syncmers.with_anchors(spark.createDataFrame(docs, "doc_id long, text string"), "text", "anchors", words, inner).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["anchors"]] for r in rows} == {d: brute_anchors(t, words, inner) for d, t in docs}


def test_anchors_are_free_of_context_and_close(spark):
    """A passage has the same anchors wherever it stands, in any run of words there is one, and they show where it stands."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = prose(120)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    a, b = frame([(1, f"{prose(40)} {passage} {prose(10)}"), (2, prose(90))]), frame([(7, f"{prose(5)} {passage}"), (8, prose(60))])
    got = syncmers.matches(a, b).collect()
    assert [(r["doc_id"], r["other_id"], r["shift"]) for r in got] == [(1, 7, 35)]
    inside = [p for p, _ in brute_anchors(passage)]
    assert got[0]["anchors"] == len(inside)
    assert all(y - x <= syncmers.WORDS - syncmers.INNER for x, y in zip(inside, inside[1:]))


def test_op12_plan_is_native(spark, tmp_path):
    folder = write_tables(tmp_path, made_documents(), [], [])
    plan = QUERIES["op12_syncmers"](spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# hard negatives


def vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(420, 6)) / 3
    rows = [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(420)]
    rows[300:330] = [(300 + k, x[0].tolist(), k % 3) for k in range(30)]  # ties with each other
    rows += [(1000, None, 1), (1001, [None] * 6, 1), (1002, [float("nan")] * 6, 2), (1003, [float("inf")] * 6, 2), (1004, x[1].tolist(), None), (None, x[2].tolist(), 1)]
    rows += [(1100, [0.0] * 6, 1), (1200, (-x[3]).tolist(), 2), (1300, x[4].tolist()[:3], 0), (1301, x[5].tolist()[:3], 0), (1302, x[4].tolist()[:3], 3), (1400, [], 1), (1401, [], 2), (1402, [], 1)]
    rows += [rows[100], rows[100], rows[57], (200, x[9].tolist(), 3)]
    rows += [(1500, [2.0**20 * v for v in x[6]], 2), (1501, [2.0**40 * v for v in x[6]], 2), (1502, [2.0**41] * 6, 3), (1600, [3e38] * 6, 2), (1601, [3e38] * 6, 1), (1602, [-3e38] * 6, 1)]
    return [(i, None if e is None else [None if v is None else float(np.float32(v)) for v in e], label) for i, e, label in rows]


def brute_negatives(rows):
    ends = hard_negatives.LONG
    clip = lambda v: min(max(v, ends[0]), ends[1])
    live = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(v is None or not math.isfinite(v) for v in e):
            continue
        live.append((i, math.fmod(label + 1, 10) if i % 7 == 0 else label, tuple(clip(math.floor(256 * v)) for v in e)))
    out = Counter()
    for a in {r for r in live if r[0] % 100 == 0}:
        scored = sorted((-clip(sum(x * y for x, y in zip(a[2], r[2]))), r[0], r[1]) for r in live if r[0] != a[0] and len(r[2]) == len(a[2]))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            hard = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out.update((a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hard))
    return out


@pytest.mark.parametrize("limit", [hard_negatives.ROUND, 200])
def test_hard_negatives(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(hard_negatives, "ROUND", limit)
    rows = vectors()
    columns = {"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}
    clashes = {k: pa.array(["x"] * len(rows)) for k in ("q", "score", "slot", "rank", "anchor_id", "id")}
    pq.write_table(pa.table(columns | clashes), tmp_path / "embeddings.parquet", row_group_size=100)
    got = QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    assert dict(got.dtypes)["rank"] == "int"
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows)


def test_first_of_many_parts():
    best, rng = hard_negatives.Best(3, most=50), np.random.default_rng(1)
    every = [(int(a), int(b), k) for k, (a, b) in enumerate(rng.integers(0, 9, (2000, 2)))]
    for k in range(0, 2000, 7):
        best.add(*(np.array(x) for x in zip(*every[k : k + 7])))
    slot, score, ids = best.first()
    want = [x for s in range(9) for x in sorted((x for x in every if x[0] == s), key=lambda x: (-x[1], x[2]))[:3]]
    assert list(zip(slot.tolist(), score.tolist(), ids.tolist())) == want


def test_near_vectors_by_sql(spark, tmp_path):
    """Groups of vectors that drift apart, chains among them, and vectors that link with nothing."""
    rng = np.random.default_rng(5)
    rows, v = [], None
    for i in range(240):
        v = rng.normal(size=8) if i % 6 == 0 else v + rng.normal(size=8) * 0.2
        rows.append((i, [float(x) for x in v], i % 10))
    rows += [(240, None, 1), (241, [0.0] * 8, 1), (242, [float("nan")] * 8, 1), (243, [], 1), (244, rows[7][1], 1), (245, [1.0, 2.0], 1), (246, [2.0, 4.0], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = con.execute(ORACLE_SQL["op8_cover_tree"])
    names = [c[0] for c in cursor.description]
    want = Counter(tuple(str(x) for _, x in sorted(zip(names, r))) for r in cursor.fetchall())
    assert sum(int(k[3]) for k in want) > 200 and by_spark("op8_cover_tree", spark, str(tmp_path)) == want
