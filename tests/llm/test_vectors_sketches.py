"""Hard negatives, paragraph sketches and vector codes against SQL and brute force, and the cases their docstrings state."""

import base64
import hashlib
import random
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from wayfare.llm import hard_negatives, paragraph_sketch, queries, vector_codes
from wayfare.llm.vectors import products

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_vector_codes"])
def test_queries_equal_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLES[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns)) == sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in want.itertuples(index=False)), key=repr)


def vectors(spark, n, dim=8, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(2)
    x[: n // 3] = x[0]  # a third of all rows is one vector
    data = [(int(i), [float(v) for v in x[i]], int(rng.integers(labels))) for i in range(n)]
    odd = [(None, [1.0] * dim, 1), (n + 1, None, 1), (n + 2, [1.0, None] * (dim // 2), 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("inf")] * dim, 2), (n + 5, [1.0] * dim, None), (n + 6, [0.5], 1), (n + 7, [], 0), (n + 8, [1e30] * dim, 0)]
    return spark.createDataFrame(data + odd + data[:5], "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("x")).withColumn("group", F.lit(1)).withColumn("cell", F.lit("y"))


def brute_negatives(df, every, positives, negatives):
    kept = {}
    for r in df.collect():
        if r["vec_id"] is None or r["label"] is None or r["embedding"] is None or any(x is None or not np.isfinite(x) or abs(x) > 1e20 for x in r["embedding"]):
            continue
        v = [int(np.floor(256 * x)) for x in r["embedding"]]
        kept[r["vec_id"]] = (r["label"], v + [0] * (8 - len(v)))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in kept.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if kept[i][0] == label][:positives]:
            fits = [i for i in best if kept[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:negatives]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fits, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("group", "block", "pivots"), [(512, 8192, 64), (4, 16, 5), (1, 7, 1)])
def test_hard_negatives(spark, group, block, pivots):
    df = vectors(spark, 150)
    got = hard_negatives.mine(df, F.col("id") % 7 == 0, positives=3, negatives=4, pivots=pivots, group=group, block=block)
    want = brute_negatives(df, 7, 3, 4)
    assert want and rows(got) == want


def test_hard_negatives_of_little(spark):
    df = vectors(spark, 30)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 7 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("id") < 0).collect() == []
    assert hard_negatives.mine(df.where("label = 1"), F.col("id") % 7 == 0).collect() == []


def test_groups_cover_all_cells():
    rng = np.random.default_rng(2)
    space = hard_negatives.Space(rng.normal(size=(20, 4)), 30.0)
    counts = [0, 50, 1, 1, 9, 3, 0, 0, 120, 10, 5, 5, 5, 5, 5, 1, 1, 1, 1, 1]
    g = hard_negatives.group_cells(space, counts, 10)
    load = Counter()
    for c, n in enumerate(counts):
        assert bool(n) == bool(len(g.homes(c)))
        for x in g.homes(c):
            load[x] += n / len(g.homes(c))
    assert set(load) == set(range(g.n)) and max(load.values()) <= 10


def test_products_are_exact():
    a, b = np.array([[1 << 27, 3]]), np.array([[(1 << 27) + 1, 5]])
    assert products(a, b)[0, 0] == (1 << 27) * ((1 << 27) + 1) + 15


def brute_codes(data, parts, entries, rounds):
    """Plain Lloyd rounds on lists of integers; data: (id, vector), in order."""
    width = len(data[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in data]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return min(range(len(book)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for c in cut:
                by.setdefault(near(c[p], books[p])[0], []).append(c[p])
            for k, xs in by.items():
                books[p][k] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    codes = [("".join(f"{near(x, books[p])[0]:02x}" for p, x in enumerate(c)), sum(near(x, books[p])[1] for p, x in enumerate(c))) for c in cut]
    return books, codes


@pytest.mark.parametrize("entries", [5, 400])
def test_vector_codes(spark, entries):
    df = vectors(spark, 60)
    kept = [(r["vec_id"], [int(np.floor(256 * x)) for x in r["embedding"]]) for r in df.collect() if r["embedding"] is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e20 for x in r["embedding"])]
    kept = sorted(((i, v + [0] * (8 - len(v))) for i, v in kept), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    books, codes = brute_codes(kept, 4, entries, 3)
    learned = vector_codes.learn(df, parts=4, entries=entries, rounds=3)
    assert learned.entries.tolist() == books
    got = vector_codes.encode(df, learned, keep=("label",))
    assert rows(got.select("vec_id", "code", "error")) == sorted(((i, *c) for (i, _), c in zip(kept, codes, strict=True)), key=repr)
    back = vector_codes.decode(got, learned).where("vec_id = 40").first()
    want = next(v for i, v in kept if i == 40)
    assert round(sum((256 * a - b) ** 2 for a, b in zip(back["approximation"], want, strict=True))) == back["error"]


def test_vector_codes_of_little(spark):
    df = vectors(spark, 9)
    none = vector_codes.learn(df.limit(0))
    assert none.text() == "" and vector_codes.encode(df.limit(0), none).collect() == []
    assert len(vector_codes.encode(df, vector_codes.learn(df, parts=16)).collect()) == 9 + 5 + 4  # 8 components are padded to 16


def pieces(text):
    return Counter(x.rstrip(" ") for x in regex.findall(paragraph_sketch.PIECE, text))


def brute_versions(docs):
    """docs: (doc_id, text) in order."""
    out, texts = [], [t or "" for _, t in docs]
    for i, (k, _) in enumerate(docs):
        text, after = texts[i], texts[(i + 1) % len(docs)]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + after[:cut]
        a, e, n = pieces(text), pieces(changed), pieces(after)
        alike = lambda x, y: round(sum((x & y).values()) / sum((x | y).values()), 9) if x or y else 1.0
        out.append((k, len(text), hashlib.sha256(changed.encode()).hexdigest(), alike(a, e), alike(a, n)))
    return sorted(out, key=repr)


def sketched(df):
    return df.select("doc_id", "n_chars", "edited_sha256", F.round("near_edited", 9), F.round("near_next", 9))


def test_sketch_query(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()
    got = queries.op12_paragraph_sketch(spark, DATA)
    assert rows(sketched(got)) == brute_versions(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def odd_documents(rng):
    line = lambda n: " ".join("".join(rng.choice("abcdé𝒳") for _ in range(rng.randint(1, 9))) for _ in range(n)) + rng.choice([".", "!", ""])
    lines = [line(rng.randint(1, 60)) for _ in range(60)]
    texts = [None, "", "", "a", "ab", "abc", "abcd", "\n\n\n", "   ", "x" * 5000, " " * 3000, "x.\n" * 900, "\n".join(line(30) for _ in range(700)), "a b. " * 4000]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return list(enumerate(texts))


def test_sketch_cases(spark):
    docs = odd_documents(random.Random(5))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, keys string, bucket int").repartition(5)
    assert rows(sketched(paragraph_sketch.versions(df))) == brute_versions(docs)
    one = df.where("doc_id = 20")
    assert rows(sketched(paragraph_sketch.versions(one))) == brute_versions(docs[20:21])
    assert paragraph_sketch.versions(df.limit(0)).collect() == []
    prints = {r["doc_id"]: r["fingerprint"] for r in paragraph_sketch.versions(df.union(df.where("doc_id < 5")).withColumn("doc_id", F.when(F.col("doc_id") < 70, F.col("doc_id")))).collect()}
    assert len({prints[k] for k in (1, 2)}) == 1 and prints[3] != prints[4] and None in prints


def test_sketch_of_one_id_on_all_rows(spark):
    df = spark.createDataFrame([(7, f"text {i}.") for i in range(300)] + [(7, "same")] * 50, "doc_id long, text string")
    got = paragraph_sketch.versions(df).collect()
    assert len(got) == 350 and Counter(r["n_chars"] for r in got)[4] == 50
    assert len({r["fingerprint"] for r in got}) == 301


def test_cells_and_bytes(spark):
    text = "One line.\nAnother line.\nOne line.\n" + "word " * 300
    df = spark.createDataFrame([(text,)], "text string").select(paragraph_sketch.digests(F.col("text")).alias("keys"))
    got = df.select("keys", paragraph_sketch.sketch(F.col("keys")).alias("cells")).select("*", paragraph_sketch.pack(F.col("cells")).alias("packed"))
    row = got.select("*", (paragraph_sketch.unpack(F.col("packed")) == F.col("cells")).alias("same"), paragraph_sketch.fingerprint(F.col("cells")).alias("print")).first()
    assert row["same"] and len(set(row["keys"])) == sum(pieces(text).values())
    want = [[0, 0, 0] for _ in range(24)]
    for k in row["keys"]:
        first = xxhash.xxh64_intdigest(struct.pack("<q", k), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", 0), seed=first)
        for j in range(3):
            c = want[8 * j + (h >> 5 * j & 7)]
            c[0], c[1], c[2] = c[0] + 1, c[1] ^ (k & (1 << 64) - 1), c[2] ^ h >> 32
    assert base64.b64decode(row["print"]) == b"".join(struct.pack(">IQI", *c) for c in want)


def test_reconcile_recovers_the_digests(spark):
    rng = random.Random(3)
    pairs, want = [], {}
    for pid, (shared, left, right) in enumerate([(5, 0, 0), (0, 0, 0), (50, 3, 2), (3000, 200, 400), (0, 5000, 1), (1, 30, 30), (0, 1, 0)]):
        draw = lambda n: [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
        s, a, b = draw(shared), draw(left), draw(right)
        want[pid] = (set(a), set(b))
        pairs.append((pid, s + a, b + s))
    out = {pid: (set(), set()) for pid in want}
    df = spark.createDataFrame(pairs, "pid long, left array<long>, right array<long>")
    for r in paragraph_sketch.reconcile(df).collect():
        out[r["pid"]][0].update(r["left"])
        out[r["pid"]][1].update(r["right"])
    assert out == want
    counts = {r["pid"]: r["n"] for r in paragraph_sketch.reconcile(df, recovered=False).groupBy("pid").agg(F.sum("n").alias("n")).collect()}
    assert all(counts.get(p, 0) == len(a) + len(b) for p, (a, b) in want.items())
