"""The word kernel and pure functions of the operators against brute force."""

import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wayfare.llm import decontaminate, hamming, html_text, langid, lm, mixing, quality, toxicity, wordhash
from wayfare.llm.bitplanes import BIT_PLANES, BYTE_PLANES, _encoder, pack, unpack
from wayfare.llm.near_dedup import MinHash, forest, shingle_sets
from wayfare.llm.tokenizer_files import BYTE_BPE

LOW = {i: i + 32 for i in range(65, 91)}
PATTERNS = [(r"[^\x20\x09-\x0D]+", wordhash.NOT_SPACE), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", wordhash.ALNUM)]


@pytest.fixture(params=[64, 1 << 17])
def span(request, monkeypatch):
    monkeypatch.setattr(wordhash, "SPAN", request.param)


@pytest.mark.parametrize(("pattern", "table"), PATTERNS)
def test_words_and_grams(span, pattern, table):
    rng = random.Random(3)
    texts = [None, "", "a", "  A b", "é ü\n\tZz", "x" * 300 + " y"] + ["".join(rng.choice("ab Cé\n9.") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    data, offsets = wordhash.buffers(pa.array(texts))
    w = wordhash.words(data, offsets, table)
    want = [re.findall(pattern, (t or "").translate(LOW)) for t in texts]
    seen: dict = {}
    for i, own in enumerate(want):
        assert w.first[i + 1] - w.first[i] == len(own)
        for k, x in enumerate(own):
            at = w.first[i] + k
            assert bytes(wordhash.LOWER[data[w.start[at] : w.end[at]]]).decode() == x
            assert seen.setdefault(x, w.hash[at]) == w.hash[at]
    assert len(set(seen.values())) == len(seen)
    g, first = wordhash.grams(w, 3)
    known: dict = {}
    for i, own in enumerate(want):
        three = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        assert first[i + 1] - first[i] == len(three)
        for s, x in zip(three, g[first[i] : first[i + 1]], strict=True):
            assert known.setdefault(s, x) == x
    assert len(set(known.values())) == len(known)


def test_affixes_do_not_depend_on_place():
    data, offsets = wordhash.buffers(pa.array(["Abcdef xx ABCDxy", "zabc"]))
    w = wordhash.words(data, offsets)
    at, h = wordhash.prefixes(data, w, (3, 4))[3]
    assert list(at) == [0, 2, 3] and h[0] == h[1] != h[2]
    assert list(wordhash.suffixes(data, w, (2,))[2][0]) == [0, 2, 3]


def test_shingle_sets_and_short_texts():
    sets, first = shingle_sets(*wordhash.buffers(pa.array(["a b c d", "A  B\tc d", "a b", "a b a b", None, " ", "b a"])), 3)
    own = [frozenset(sets[first[i] : first[i + 1]].tolist()) for i in range(7)]
    assert own[0] == own[1] and [len(x) for x in own] == [2, 2, 1, 2, 0, 0, 1] and own[2] != own[6]


def test_forest_links_what_brute_force_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.07 * (k % 4)], rng.integers(0, 1 << 60, k % 5).astype(np.uint64)])) for k in range(60)] + [rng.integers(0, 1 << 60, 30).astype(np.uint64) for _ in range(10)]
    m = MinHash()
    sig = m.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))

    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in set(label)}

    every = [(a, b) for a in range(70) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert groups(forest(sets, sig, 85)) == groups(every) and len(every) > 20
    half = np.arange(70) % 2 == 0
    across = [(a, b) for a, b in every if half[a] != half[b]]
    assert groups(forest(sets, sig, 85, half)) == groups(across)


def test_tensored_keys():
    m = MinHash(m=3, rows=2)
    sig = np.arange(24, dtype=np.uint32).reshape(2, 12)
    sig[1, :2], sig[1, 6:8] = sig[0, :2], sig[0, 6:8]
    keys = m.keys(sig)
    assert keys.shape == (2, 9) and [k for k in range(9) if keys[0, k] == keys[1, k]] == [0]


@pytest.mark.parametrize("mode", [BYTE_PLANES, BIT_PLANES])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 70_000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
    assert (unpack(pack(ids, mode, 4096)) == ids).all()
    assert (unpack(pack(np.full(n, 2**32 - 1, np.uint32), mode)) == 2**32 - 1).all()


def test_encoder_equals_the_library():
    e, rng = _encoder(BYTE_BPE), random.Random(5)
    pieces = ["a", "the", " ", " ", "  ", "\n", "\n", "\t", " \n", "'s", "'", "'ll", "é", "ñandú", "12", "!", ",", "...", "\xa0", "\x1c", "\x00", "\x7f", "_", "<|endoftext|>", "中", "\r", "don't", "　", "😀", "«", "²", "ª", "e\u0301", "ÿ", "\u0250", "—"]
    texts = ["", " ", "\n", "x" * 5000, None] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for keep in (300_000, 50):
        e.keep, e.known, e.old = keep, {}, {}
        for at in range(0, len(texts), 700):
            ids, counts = e.column(pa.array(texts[at : at + 700], pa.string()))
            ends = np.cumsum(counts)
            assert [ids[b - c : b].tolist() for b, c in zip(ends, counts, strict=True)] == want[at : at + 700]
    for t, ids in zip(texts[:300], want, strict=False):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids
    e.keep = 300_000


def test_encoder_of_another_kind_of_file(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(f"{tmp_path}/words.json")
    ids, counts = _encoder(f"{tmp_path}/words.json").column(pa.array(["a b", None, "c a", ""]))
    assert ids.tolist() == [0, 1, 2, 0] and counts.tolist() == [2, 0, 2, 0]


def test_scan_equals_brute_force():
    rng = random.Random(2)
    words = ["a", "B", "cé", "9"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for k in range(12)] + [(99, "..."), (3, "a B a B")]
    found, n = decontaminate.automaton(items, 3)
    for _ in range(200):
        text = rng.choice(["", ". "]) + rng.choice([" ", "-", "\n"]).join(rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 15)))
        own = decontaminate.normal_words(text)
        hit, ids = set(), set()
        for item, t in items:
            w = decontaminate.normal_words(t)
            for k in range(max(1, len(w) - 2) if w else 0):
                part = w[k : k + 3]
                for at in range(len(own) - len(part) + 1):
                    if own[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        ids.add(item)
        size, ranges, got = decontaminate.scan(found, n, text.encode())
        assert size == len(own) and got == ids and {x for a, b in ranges for x in range(a, b)} == hit


def test_targets_fill_up_to_the_cap():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [3, 1], 15, 2) == [0.0, 15.0]
    assert mixing.targets([], [], 0, 2) == []
    plan = mixing.plan([(None, 5), ("b", 10), ("a", 20), ("z", 0)])
    assert [x["source"] for x in plan] == ["a", "b", "z", None] and plan[-1]["high"] == pytest.approx(1)


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)

    def plain(e, start, move):
        a, b = np.zeros_like(e), np.ones_like(e)
        a[0] = np.exp(start + e[0])
        for t in range(1, len(e)):
            a[t] = (a[t - 1] @ np.exp(move)) * np.exp(e[t])
        for t in range(len(e) - 2, -1, -1):
            b[t] = np.exp(move) @ (np.exp(e[t + 1]) * b[t + 1])
        g = a * b
        return g / g.sum(1, keepdims=True)

    sizes = [3, 0, 1, 7, 40, 0, 2, 90]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, s, m = rng.normal(size=(sum(sizes), 4)), rng.normal(size=4), rng.normal(size=(4, 4))
    for width in (1, 3, 8, 64):
        g = langid.marginals(e, first, s, m, width)
        for i, n in enumerate(sizes):
            if n:
                assert np.allclose(g[first[i] : first[i + 1]], plain(e[first[i] : first[i + 1]], s, m))


def test_field_labels_code_switched_words():
    one, two = ["tolo meka", "meka tolo tolo", "tolo"], ["brisht krand", "krand brisht", "brisht"]
    field = langid.train([("aa", " ".join(one * 20)), ("bb", " ".join(two * 20))])
    post, first = field.label(*wordhash.buffers(pa.array(["tolo meka brisht krand krand"])))
    assert [field.langs[k] for k in post.argmax(1)] == ["aa", "aa", "bb", "bb", "bb"]
    assert field.move[0, 0] > field.move[0, 1] and langid.train([]) is None


def test_every_byte_of_long_runs_is_read():
    one, two = "甲乙丙丁戊己庚辛", "子丑寅卯辰巳午未"
    field = langid.train([("aa", one * 40), ("bb", two * 40)])
    post, first = field.label(*wordhash.buffers(pa.array([one * 8 + two * 8, "", two])))
    assert list(first) == [0, 8, 8, 9] and [field.langs[k] for k in post.argmax(1)] == ["aa"] * 4 + ["bb"] * 5
    data, offsets = wordhash.buffers(pa.array(["x" * 60]))
    slot, owner = langid.word_features(data, langid.runs(data, offsets))
    assert len(slot) == 1 + 8 + 58


def model_of(text):
    c = lm.codes(np.empty(0, np.uint8), ("\n\n" + text + "\n\n").encode())
    n = np.bincount((c[:-2] * lm.SIZE + c[1:-1]) * lm.SIZE + c[2:], minlength=lm.SIZE**3)
    return lm.CharModel(n.reshape((lm.SIZE,) * 3))


def test_hidden_words_are_restored():
    restore = toxicity.Restorer(model_of("you stupid idiot and the loser is here in the room " * 50))
    for hidden, word in {"st0p 1d10t": "idiot", "s t u p i d": "stupid", "s.t.u.p.i.d": "stupid", "stuuuupid": "stupid", "$tupid": "stupid", "l0s3r": "loser"}.items():
        assert word in restore(f"you {hidden} here")[0].split(), hidden
    assert restore("the room is here")[0] == "the room is here" and restore("") == ("", "")


def test_spaced_sentences_keep_their_words():
    model = model_of("you are a stupid idiot and the loser is here in the room " * 50)
    restore = toxicity.Restorer(model)
    assert restore("a s t u p i d")[0] == "a stupid" and restore("y o u i d i o t")[0] == "you idiot"
    assert restore("y o u  i d i o t")[0].split() == ["you", "idiot"]
    long = "the stupid idiot is here in the room " * 40
    assert restore(" ".join(long.replace(" ", "")))[0].split() == long.split()


def test_other_scripts_ends_and_kept_digits():
    restore = toxicity.Restorer(model_of("you dumbass ass and the тупой стена is here in room seven " * 50))
    assert restore("т у п о й стена")[1].replace(" ", "") == "тупой" and "тупооой"[:4] in restore("тупооой")[1]
    assert restore("you dumba55, a$$!")[1] == "dumbass ass"
    for text in ("т у п о й", "тупооой стена", "a$$!", "dumba55,", "哈 哈 哈"):
        assert len(toxicity.suspicious(np.frombuffer(f"so {text} is".encode(), np.uint8))), text
    assert not len(toxicity.suspicious(np.frombuffer("plain text, très «bien» été: 12 of 30.".encode(), np.uint8)))
    assert ("9" * 3, toxicity.KEEP * 3) in toxicity.lattice("a999b")[1]


@pytest.mark.parametrize("text", ["(" + "x" * 1_000_000 + ")", "ab" * 500_000, "a1" * 100_000, "a b " * 100_000, "@" * 300_000 + "b", "@1" * 200_000, "$!" * 200_000 + " ", "abbba" * 40_000, "a@" + "q" * 500_000, "я" * 200_000, "x.|" * 100_000])
def test_unbroken_texts_take_seconds(text):
    restore = toxicity.Restorer(model_of("the idiot and a loser were total clowns " * 30))
    began = time.process_time()
    list(toxicity._restored_features(pa.array([text]), restore))
    assert time.process_time() - began < 30


def brute_lattice(span):
    out = [("", 0.0)]
    for options in toxicity.lattice(span):
        out = [(t + e, s + c) for t, s in out for e, c in options]
    return out


def test_viterbi_is_the_best_path():
    model = model_of("the idiot and a loser were total clowns " * 30)
    for span in ("1d10t", "cl0wn$", "l*s3rrr", "t.o.t.4.l"):
        def total(text, cost):
            a = b = 0
            for c in [*map(model.symbol, text), 0]:
                cost += float(model.table[a, b, c])
                a, b = b, c
            return cost

        best = max(total(t, c) for t, c in brute_lattice(span))
        got = toxicity.decode(span, model)
        assert max(total(t, c) for t, c in brute_lattice(span) if t == got) == pytest.approx(best)


def test_index_equals_brute_force():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    codes[:50] = codes[0]
    codes[50:80] ^= np.uint64(3)
    ids = rng.permutation(400) * 3
    index = hamming.Index(codes)
    for q in [int(codes[0]), int(codes[60]), 5, (1 << 64) - 1]:
        d = hamming.distances(codes, q)
        want = np.lexsort((ids, d))[:7]
        rows, near = index.search(q, ids, 7)
        assert list(rows) == list(want) and list(near) == list(d[want])
    assert len(hamming.Index(codes[:3]).search(5, ids[:3], 7)[0]) == 3


HTML = {
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x<p>y<p>z": "- a\n- b\n  - c\n- d\n\nx\n\ny\n\nz",
    "<table><caption>Cap</caption><tr><th>Name<th>N<tr><td>Bob<td>12</table>after": "Cap\nName  N\nBob   12\n\nafter",
    "<ol start=3><li>x<li value=9>y</ol>": "3. x\n9. y",
    "<div hidden>no</div><p style='display:none'>n</p><pre>a\n  b</pre>q<br>r&amp;s": "a\n  b\n\nq\nr&s",
    "a<b>b</b> c <i> d</i>": "ab c d",
    "<table><tr><td rowspan=2>A<td>1<tr><td>2</table>": "A  1\n   2",
    "<script>var t='</p>'</script><title>T</title><blockquote>q</blockquote>": "  q",
    "<head><title>t</title><style>x</style></head><body>b": "b",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<details><summary>s</summary>hidden</details><select><option>o</select>": "s",
    "a < b & c <": "a < b & c <",
    "<!-- c --><p>x</p></div></p>": "x",
    "<table><tr><td>中文<td>x<tr><td>ab<td>y</table>": "中文  x\nab    y",
    "": "",
}


@pytest.mark.parametrize("page", HTML)
def test_pages(page):
    assert html_text.page_text(page) == HTML[page]


def test_null_and_odd_pages():
    assert html_text.page_text(None) is None
    assert html_text.page_text("<div>" * 5000 + "x") == "x"
    assert html_text.page_text("<li>" * 200 + "x").endswith("x")
    assert html_text.page_text("a <b and <i>c</i>") == "a c" and html_text.page_text("a<i <b") == "a<i <b"
    assert html_text.page_text("<p title='a>b>c</p>d") == "b>c\n\nd" and html_text.page_text("&#" + "9" * 6000 + ";&#x0000041;") == "\ufffdA"


@pytest.mark.parametrize(("page", "text"), [
    ("<style>.h{display:none} p.x{visibility:hidden} #k{display:none}</style><p class='a h'>1<p class=x>2<div class=x>3</div><p id=k>4<p>5", "3\n\n5"),
    ("<style>@media print{.h{display:none}} .g{display:none} .g{display:block} /*.f{display:none}*/</style><p class=h>1<p class=g>2<p class=f>3", "1\n\n2\n\n3"),
    ("<style>p{display:none}.s{display:block}</style><p>1<p class=s>2<p style='display:block'>3", "2\n\n3"),
    ("<style>a{</style><a>1</a>", "1"),
])
def test_style_elements_hide(page, text):
    assert html_text.page_text(page) == text


GIANTS = {
    "open tags": ("<a " * 350_000, 1_049_999), "lists": ("<ul><li>" * 50_000 + "x", 97), "quotes": ("<blockquote>" * 50_000 + "x", 97), "tables": ("<table><tr><td>" * 50_000 + "x", 1),
    "open quotes": ("<a b='" * 150_000 + '"', 900_001), "breaks": ("<br>" * 200_000 + "x", 1), "marks": ("<" * 500_000, 500_000), "blocks": ("<p><button>" + "<div>" * 100_000 + "x", 1),
    "comments": ("<!--" * 200_000, 0), "letters": ("y" * 1_000_000, 1_000_000), "spans": ("<table><tr>" + "<td rowspan=1000>x" * 20_000 + "<tr><td>y" * 1000 + "</table>", None), "tall": ("<table><tr><td>" + "x<br>" * 50_000 + "<td>y" * 50_000, None),
}


@pytest.mark.parametrize("name", GIANTS)
def test_giant_pages_take_seconds(name):
    page, size = GIANTS[name]
    began = time.process_time()
    text = html_text.page_text(page)
    assert time.process_time() - began < 30 and (size is None or len(text) == size)


def test_wide_cells_do_not_pad_all_rows():
    text = html_text.page_text("<table><tr><td>" + "w" * 100_000 + "<td>z" + "<tr><td>a<td>b" * 1000 + "</table>")
    assert len(text) < 100_000 + 1000 * (html_text.WIDEST + 10) and text.split("\n")[1] == "a" + " " * (html_text.WIDEST + 1) + "b"


def test_all_visible_words_are_kept():
    """Words of the rendering against those that the standard library's parser sees outside of hidden elements."""

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("head", "script", "style")
            self.words.append("" if tag in ("br", *html_text.BLOCK) else None)

        def handle_endtag(self, tag):
            self.hidden -= tag in ("head", "script", "style")
            self.words.append("" if tag in html_text.BLOCK else None)

        def handle_data(self, data):
            if not self.hidden:
                self.words.append(data)

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert len(pages) > 100
    marks = re.compile(r"^ *(?:- |\d+\. )+", re.M)
    for page in pages:
        plain = Plain()
        plain.feed(page)
        want = "".join(" " if x == "" else x or "" for x in plain.words).split()
        assert marks.sub("", html_text.page_text(page).replace("-" * 20, "")).split() == want


def test_kth_threshold_and_ratio():
    assert quality.best_threshold(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([False, False, True, True])) == 0.0
    assert quality.best_threshold(np.array([]), np.array([], bool)) == -np.inf
    assert not quality.log_ratio(np.zeros((2, 5))).any()
    data, offsets = wordhash.buffers(pa.array(["a b&&& a", None, "x"]))
    grams, per = quality.gram_buckets(data, offsets)
    assert list(per) == [7, 0, 1] and grams[0] == grams[3]


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tbody><td>a<td>b</tbody></table>", "a  b"),
    ("<table><thead>note<tr><td>a<td>b</table>", "note\na  b"),
    ("<table><tbody><form><tr><td>a<td>b</tr></form></tbody></table>", "a  b"),
    ("<ul>one<li>two</li>three <b>x</b> y<li>four</ul>", "  one\n- two\n  three x y\n- four"),
])
def test_stray_text_in_tables_and_lists_is_kept(page, text):
    assert html_text.page_text(page) == text
