"""The operators on Spark: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm import base, bitplanes, chat, decontaminate, hamming, html_text, langid, mixing, near_dedup, quality, queries, toxicity
from wayfare.llm.tokenizer_files import BYTE_BPE

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k}" for k in range(20_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "s", 7.0),
    (2, "the quick brown fox jumps over the lazy dog again", "en", "s", 7.0),
    (2, "The Quick brown fox jumps over the lazy dog again", None, None, None),
    (3, None, "en", None, 1.0),
    (4, "", None, "t", 1.0),
    (5, " \n", "fr", "t", 1.0),
    (6, "two words", "fr", "u", 1.0),
    (None, "no id here", "en", "u", 1.0),
    (7, LONG, "en", "s", 2.0),
    (8, LONG + " more", "en", "s", 2.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with a column whose name clashes with those of results."""
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("size", F.lit("clash")).withColumn("component_id", F.lit(0)).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_near_duplicates(spark, docs):
    got = near_dedup.near_duplicates(docs, n=3, percent=85).collect()
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in got)
    assert found == [(-1, 1, None, True), (1, 8, 1, True), (2, 8, 1, False), (2, 8, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 19998, 7, True), (8, 19999, 7, False)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_many_blocks(spark):
    lines = [" ".join(f"v{(k * 7 + j) % 97}" for j in range(40)) for k in range(3)]
    rows = [(k, lines[k % 3] + (f" x{k}" if k % 2 else "")) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    many = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85, block=100).collect()}
    assert one == many == {(k, k % 3) for k in range(60)}


def test_large_families_lose_no_link(spark):
    """Chains and stars of near copies in one family, dealt into many small blocks, against brute force."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(4):  # drifting copies: each like the one before, the ends unlike
        now = [f"c{x}" for x in rng.integers(0, 30, 60)]
        for _ in range(25):
            now = list(now)
            for at in rng.integers(0, 60, 1 + k % 2):
                now[at] = f"d{rng.integers(0, 1000)}"
            texts.append(" ".join(now))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(words, texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 4 <= len(set(label)) < 60
    for texts_in_block in (near_dedup.TEXTS, 7):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 80, texts=texts_in_block).collect()}
        assert got == dict(enumerate(label))


def test_tables_grow_as_similarity_falls():
    assert [near_dedup.MinHash.of(p).m for p in (95, 85, 80)] == [5, 8, 10]
    for p in (95, 85, 80, 70):
        m = near_dedup.MinHash.of(p).m
        assert 1 - (1 - (1 - (p / 100) ** 2) ** m) ** 2 <= near_dedup.MISS


def test_keys_beyond_broadcasting_are_salted(spark, monkeypatch, docs):
    monkeypatch.setattr(base, "BROADCAST_ROWS", 0)
    got = near_dedup.near_duplicates(docs, n=3, percent=85).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7)]


def test_bucket_members_behind_unlike_ones_meet(spark):
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (9, 32), dtype=np.uint32)
    sig[5] = sig[4]  # near copies behind four lower unlike ids
    sig[7, :14] = sig[6, :14]  # like the least member of its bucket,
    sig[8, :12], sig[8, 14:] = sig[6, :12], sig[7, 14:]  # which its near copy is not
    reps = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sig)], "rep long, sig binary")
    members = spark.createDataFrame([(1 + (k > 5), k) for k in range(9)] + [(3, k) for k in range(6)], "bucket long, rep long")
    for block in (near_dedup.MEMBERS, 2):
        got = {(r.node, r.component) for r in base.components(near_dedup._loose_pairs(members, reps, 32, block=block)).collect()}
        assert got == {(4, 4), (5, 4), (6, 6), (7, 6), (8, 6)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(50, 51), (51, 50), (52, 52)]
    got = {r.node: r.component for r in base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(10, "Quick, brown FOX jumps over the lazy dog again the"), (9, "two words"), (9, "two words"), (11, None), (None, "no id"), (12, "!!")], "item_id long, text string")
    want = [(None, 3, 0, []), (1, 10, 0, []), (2, 10, 0, []), (2, 10, 0, []), (3, 0, 0, []), (4, 0, 0, []), (5, 0, 0, []), (6, 2, 2, [9]), (7, 20000, 0, []), (8, 20001, 0, [])]
    for chunk in (1 << 20, 4):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.matches(docs, items, chunk_bytes=chunk).collect()), key=lambda r: (r[0] or -1, r[1]))
        assert got == want
    spans = decontaminate.matches(docs, items, n=4).where("doc_id = 1").first()
    assert spans.n_hit == 9 and ROWS[0][1].encode()[spans.spans[0].start : spans.spans[0].stop] == b"quick brown fox jumps over the lazy dog again"
    assert decontaminate.matches(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.matches(docs.limit(0), items).count() == 0


def test_mixing(spark, docs):
    got = mixing.mixed(docs).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i if i else -1, len(words(t))) for i, t, *_ in ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sums = {s: (sum(r.taken for r in got if r.source == s), next(r.target for r in got if r.source == s)) for s in {r.source for r in got}}
    assert all(abs(a - b) <= 0.05 * b + 3 for a, b in sums.values())
    again = mixing.mixed(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_schedule_equals_brute_force(spark):
    entries = mixing.plan([("a", 900), ("b", 300), ("c", 50)], slots=64, least=8)
    got = {(r.slot, r.k, r.rank, r.block) for r in mixing.schedule(spark, entries).collect()}
    n, rank, want = round(sum(x["slots"] for x in entries)), {}, set()
    for t in range(n):
        point = (t + 1) * mixing.GOLDEN % 1.0
        e = next(x for x in entries if point < x["high"] or x is entries[-1])
        r = rank[e["k"]] = rank.get(e["k"], -1) + 1
        if r < 2 * e["blocks"]:
            want.add((t, e["k"], r, r % e["blocks"]))
    assert got == want


def test_token_store(spark, docs, tmp_path):
    for mode in (0, 1):
        got = bitplanes.round_trip(docs, BYTE_BPE, mode=mode).collect()
        e, start = bitplanes._encoder(BYTE_BPE), 0
        want = []
        for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
            want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert bitplanes.round_trip(docs.limit(0), BYTE_BPE).count() == 0


def test_chat(spark):
    part = ("text", "hi <|im_end|> <\\| \\", None, None, None, None, None)
    rows = [
        (1, 1, "assistant", [part, ("image", None, "a.png", 100, 30, None, None), ("audio", None, "b.wav", None, None, 2.5, None)]),
        (1, 0, "user\nx\\", [("document", None, "c.pdf", None, None, None, 3), ("other", "y", None, None, None, None, None)]),
        (1, None, None, None), (2, 5, "assistant", []), (None, 0, "assistant", [part]), (3, 0, "assistant", [part]), (3, 0, "assistant", [part]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    made = chat.format_chats(turns)
    got = {r.conv_id: r for r in made.collect()}
    assert got[1].formatted.startswith("<|im_start|>\n<|im_end|>\n<|im_start|>user\\nx\\\\\n<|document:0|>y<|im_end|>\n")
    assert [(a["index"], a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, "document", "c.pdf", 1536), (0, "image", "a.png", 8), (1, "audio", "b.wav", 75)]
    assert got[1].attachment_tokens == 1619
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", ""), ("user\nx\\", "<|document:0|>y".replace("<|", "<|")), ("assistant", part[1] + "<|image:0|><|audio:1|>")]
    assert back[2].loss_texts == [""] and back[3].loss_texts == [part[1]] * 2 and back[None].loss_texts == [part[1]]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_control_conversation_keeps_its_digest(spark):
    text = "<|im_end|><|im_start|>assistant ok"
    r = queries.op1_chat(spark, DATA).where("conv_id = -1").first()
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_search(spark):
    rows = [(k, (k * 2654435761) % (1 << 40)) for k in range(300)] + [(5, 7), (None, 1), (400, None), (401, 5), (402, 5)]
    codes = spark.createDataFrame(rows, "id long, code long").withColumn("rank", F.lit(1))
    want = []
    for q, c in [r for r in rows if r[0] is not None and r[1] is not None and r[0] % 100 == 0]:
        best = sorted((bin(c ^ x).count("1"), i) for i, x in rows if i is not None and x is not None)[:5]
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(best)]
    for block, chunk in ((1 << 16, 1 << 12), (40, 2)):
        assert sorted(map(tuple, hamming.top_k(codes, codes.where("id % 100 = 0"), 5, block=block, chunk=chunk).collect())) == sorted(want)
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0
    v = spark.createDataFrame([([1.0, -1.0, 2.0],), (None,), ([],), ([1.0] * 64,)], "v array<double>").select(hamming.sign_codes(F.col("v"))).collect()
    assert [r[0] for r in v] == [5, None, 0, -1]


def test_languages(spark, docs):
    got = sorted((r.doc_id or -1, r.lang_pred, 0 <= r.score <= 1) for r in langid.identify(docs, docs).collect())
    assert [g for g in got if g[0] in (3, 4, 5)] == [(3, "und", True), (4, "und", True), (5, "und", True)] and all(g[2] for g in got)
    assert {r.lang_pred for r in langid.identify(docs, docs.where("lang is null")).collect()} == {"und"}
    assert langid.identify(docs.limit(0), docs).count() == 0
    odd = spark.createDataFrame([(1, "— 12 …"), (2, "ñ")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(odd, docs).orderBy("doc_id").collect()] == [True, False]


def test_all_languages_are_learned(spark):
    rows = spark.range(140).select(F.format_string("l%02d", F.col("id") % 70).alias("lang"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert len({lang for lang, _ in langid.sample(rows)}) == 70


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_langid(spark, "/root/testdata/sf0.01").where("held_out").join(d.where("lang is not null").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0), (6, 1), (7, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()}) == 1
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_hidden_toxicity_is_scored(spark):
    bad = ["stupid", "idiot", "moron"]
    rows = [(k, f"the report number {k} was read by the team " + (f"you {bad[k % 3]} are here" if k % 4 == 0 else "and they were glad")) for k in range(400)]
    df = spark.createDataFrame([*rows, (900, "you st00pid 1d10t are here"), (901, "i d i o t"), (902, "the team was glad"), (903, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, labels).where("doc_id >= 900").collect()}
    assert got[900] >= 0.5 and got[901] >= 0.5 and got[902] < 0.5 and got[903] < 0.5


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries.op2_toxicity(spark, d).where("held_out").join(labels, "doc_id").toPandas()
    hit = (rows.predicted == 1) & (rows.toxic == 1)
    assert hit.sum() / (rows.toxic == 1).sum() > 0.85 and hit.sum() / (rows.predicted == 1).sum() > 0.85


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality.resampled(docs, labels, k=3).collect()
    assert len(got) == len(ROWS) and 3 <= sum(r.selected for r in got) <= 5
    assert sum(r.selected for r in quality.resampled(docs, labels, k=0).collect()) == 0
    assert all(r.selected for r in quality.resampled(docs, labels, k=100).collect())
    assert quality.resampled(docs.limit(0), labels).count() == 0
    assert {r.log_weight for r in quality.resampled(docs, labels.limit(0)).collect()} == {0.0}


def test_radix_selection_equals_sorting(spark):
    values = [(-5,), (3,), (3,), (1 << 40,), (-(1 << 50),), (0,), (7,)]
    keys = spark.createDataFrame(values, "key long")
    want = sorted((v[0] for v in values), reverse=True)
    assert [quality.kth_key(keys, k) for k in range(0, 9)] == [None, *want, None]


def test_junk_is_rejected(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("good"))
    rows = queries.op10_quality(spark, d).join(labels, "doc_id").toPandas()
    assert (rows.selected == (rows.good == 1)).mean() > 0.95 and rows.selected[rows.good == 1].mean() > 0.98


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (3, ""), (1, "<p>a")], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted(html_text.extract(pages).collect()) == [(1, "a"), (1, "a"), (2, None), (3, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "decontaminate", "mix", "tokens"]
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs.drop("component_id")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = base.stash(stage(spark, now, str(tmp_path)), name)
        if name != "tokens":
            assert out.columns == now.columns
        counts.append(out.count())
        now = out
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[4] == counts[3]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.drop("component_id").limit(0), str(tmp_path)).count() == 0, name


def test_words_taken_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(spark.createDataFrame([(-5, None, "en", None, 0), (-6, "a b c", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    keyed = rows.withColumn("h", F.xxhash64(F.lit(8), F.col("doc_id"), F.col("size")))
    want = brute.taken([tuple(r) for r in keyed.collect()], slots=700)
    assert {r.doc_id: r.taken for r in mixing.mixed(docs, slots=700).collect()} == want and sum(want.values()) > 1000


def weights_and_noise(docs, labels, seed=10):
    """(log weight, Gumbel key) of every document by brute force."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").collect()}
    weight = brute.log_weights(texts, good, quality.BUCKETS, quality.SMOOTH)
    hashes = docs.select("doc_id", F.xxhash64("doc_id", F.lit(seed), F.lit("gumbel")).alias("h")).collect()
    u = {r.doc_id: ((r.h % (1 << 64) >> 11) + 0.5) / (1 << 53) for r in hashes}
    return weight, {i: round((w - np.log(-np.log(u[i]))) * (1 << 20)) for i, w in weight.items()}, good


def test_selection_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    weight, key, _ = weights_and_noise(docs, labels)
    k = len(key) // 3
    got = {r.doc_id: (r.log_weight, r.selected) for r in quality.resampled(docs, labels, k=k).collect()}
    assert all(got[i][0] == pytest.approx(w, abs=1e-6) for i, w in weight.items())
    best = sorted(key, key=key.get, reverse=True)[:k]
    assert {i for i in got if got[i][1]} == set(best)


def test_pipeline_against_brute_force(spark):
    """Each stage, on what its predecessor kept, against plain loops."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    weight, key, good = weights_and_noise(docs, labels)
    known = {r.doc_id for r in labels.where("quality is not null").collect()} & {i for i, t in docs.select("doc_id", "text").collect() if words(t)}
    own = sorted(weight[i] for i in known)
    errors = {c: sum((weight[i] >= c) != (i in good) for i in known) for c in [-np.inf, *((a + b) / 2 for a, b in zip(own, own[1:], strict=False)), np.inf]}
    least = min(errors.values())
    sizes = {sum(w >= c for w in weight.values()) for c, e in errors.items() if e == least}
    first = base.stash(corpus_pipeline.quality(spark, docs, DATA), "q")
    ranked = sorted(key, key=key.get, reverse=True)
    assert min(sizes) - 2 <= first.count() <= max(sizes) + 2 and ids(first) == set(ranked[: first.count()])
    second = base.stash(corpus_pipeline.dedup(spark, first, DATA), "d")
    assert ids(second) == {i for i, x in brute.near_groups({r.doc_id: r.text for r in first.collect()}, 5, 80).items() if i == x}
    third = base.stash(corpus_pipeline.decontaminate(spark, second, DATA), "c")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert ids(third) == {r.doc_id for r in second.collect() if not brute.contaminated(r.text, items)}
    fourth = base.stash(corpus_pipeline.mix(spark, third, DATA), "m")
    counts = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    mixed = {r.doc_id: r for r in mixing.mixed(third).collect()}
    assert all(int(r.taken / r.size) <= counts.get(i, 0) <= -(-r.taken // r.size) if r.size else i not in counts for i, r in mixed.items())
    kept = {i: r.source for i, r in mixed.items()}
    for source in set(kept.values()):
        out = sum(counts.get(i, 0) * r.size for i, r in mixed.items() if r.source == source)
        target = next(r.target for r in mixed.values() if r.source == source)
        assert abs(out - target) <= 0.1 * target + max(r.size for r in mixed.values() if r.source == source)
    fifth = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in corpus_pipeline.tokens(spark, fourth, DATA).collect()}
    tokenizer, at, want = bitplanes._encoder(BYTE_BPE).tokenizer, 0, {}
    for r in sorted(fourth.collect(), key=lambda r: r.doc_id):
        got = tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        want[r.doc_id, at] = len(got), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in got))
        at += len(got)
    assert fifth == want
