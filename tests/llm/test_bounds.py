"""What grows: rows that span, large benchmarks, long texts that are learned from, clashing names in the pipeline."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm import decontaminate, html_text, langid


def test_rows_that_span_are_linear():
    page = "<table>" + "".join(f"<tr><td rowspan={65534 - k % 7}>x" for k in range(45_000)) + "</table>"
    began = time.perf_counter()
    text = html_text.page_text(page)
    assert len(page) > 1_000_000 and text.count("x") == 45_000 and time.perf_counter() - began < 30


def plain_columns(rows):
    """The column of each cell (columns, rows) of a table, by plain loops over a grid."""
    until, out = {}, []
    for r, cells in enumerate(rows):
        at, line, new = 0, [], {}
        for span, down in cells:
            while until.get(at, -1) >= r:
                at += 1
            line.append(at)
            for c in range(at, at + span):
                if down > 1 and until.get(c, -1) < r and c not in new:
                    new[c] = r + down - 1
            at += span
        until |= new
        out.append(line)
    return out


def test_spans_against_a_grid():
    rng = random.Random(8)
    for _ in range(300):
        rows = [[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3, 9])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 12))]
        taken, got = html_text._Taken(), []
        for r, cells in enumerate(rows):
            taken.release(r)
            at, line, down_from_here = 0, [], []
            for span, down in cells:
                at = taken.free(at)
                line.append(at)
                if down > 1:
                    down_from_here.append((at, at + span, r + down - 1))
                at += span
            for x in down_from_here:
                taken.take(*x)
            got.append(line)
            assert all(a < b for a, b in zip(taken.starts, taken.ends, strict=True)) and all(b < a for b, a in zip(taken.ends, taken.starts[1:], strict=False))
        assert got == plain_columns(rows)


def test_a_benchmark_is_cut_by_the_size_of_its_automata(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(3000))
    items = spark.createDataFrame([(k, " ".join(word() for _ in range(rng.choice([3, 12, 40])))) for k in range(60)] + [(100, long), (101, "short one")], "item_id long, text string")
    listed = {r["item_id"]: r["text"] for r in items.collect()}
    texts = [None, "", "nothing here", long, "A " + long[4000:9000] + " z", "and Short, one!", " ".join(listed[k] for k in (3, 4, 5)), listed[7] + " x " + long[100:2000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("a")).withColumn("_row", F.lit("b"))
    parts = decontaminate._chunks(items, 10, 20_000)
    sizes = [sum(decontaminate._slices(i, t, 10, 10**9)[0][2] for i, t in p) for p in parts]
    assert len(parts) > 5 and max(sizes) <= 20_000
    one, many = (sorted(map(tuple, decontaminate.matches(docs, items, chunk_bytes=c).collect())) for c in (10**9, 20_000))
    assert one == many and sum(r[2] > 0 for r in one) == 5
    kept = [sorted(map(tuple, decontaminate.clean_documents(docs, items, chunk_bytes=c).collect()), key=repr) for c in (10**9, 20_000)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [0, 1, 2] and decontaminate.clean_documents(docs, items, chunk_bytes=20_000).columns == docs.columns


def test_nodes_of_an_automaton_are_bounded():
    rng = random.Random(2)
    text = " ".join(str(rng.getrandbits(40)) for _ in range(5000))
    pieces = decontaminate._slices(1, text, 10, 50_000)
    assert all(size <= 50_000 for _, _, size in pieces)
    nodes = [decontaminate.automaton([(i, t)], 10)[0].get_stats()["nodes_count"] for i, t, _ in pieces[:3]]
    assert max(nodes) <= 50_001
    windows = set()
    for i, t, _ in pieces:
        windows |= set(decontaminate.automaton([(i, t)], 10)[0].keys())
    assert windows == set(decontaminate.automaton([(1, text)], 10)[0].keys())


def test_languages_are_learned_from_whole_texts(spark):
    limit = 12 * langid.FIT_WORDS
    long = "a" * limit + " " + "b" * limit
    rows = [(f"{chr(97 + k % 26)} text {k}", "x") for k in range(1000)] + [(long + str(k), "y") for k in range(20)]
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string"), fit_docs=100)
    firsts = [t[0] for lang, t in got if lang == "x"]
    assert len(firsts) == 100 and max(firsts) > "w"  # not the first by the alphabet
    assert all(len(t) == limit for lang, t in got if lang == "y") and any("b" in t for lang, t in got if lang == "y")


@pytest.mark.parametrize("stage", ["dedup", "mix"])
def test_columns_of_any_name_come_through(spark, stage):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(k, f"{text} {k // 2 if stage == 'dedup' else k}", "en", "s", 5) for k in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_gone_id", "_mixed_id", "_times", "_copy", "kept", "taken", "row"):
        docs = docs.withColumn(name, F.lit(name))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "/none")
    assert out.columns == docs.columns
    got = {r["doc_id"] for r in out.collect()}
    assert got == {0, 2, 4, 6} if stage == "dedup" else got <= set(range(8)) and len(got) > 3
