"""The training-data operators against plain restatements, on small and awkward tables."""

import hashlib
import math
import os
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemline.llm import bpe, common, context_mixing, embedding_dedup, exact_dedup, html_extract, langid, mixing, near_dedup, queries, simhash, substring_dedup, token_files
from stemline.llm.components import connected_components

SF = "/root/testdata/sf0.001"
#: Nulls, empties, blanks, ties, repeats, one very long word and text, and columns that clash with the operators' own.
ROWS = [
    (7, "The cat sat on the mat. The cat sat on the mat again, and again.", "en", "a"),
    (3, "The  cat sat\ton the mat. The cat sat on the mat again, and again.", "en", "a"),
    (9, None, "en", "b"), (10, "", None, None), (11, "   \n\t ", "fr", "b"), (12, "123 456 !!", "fr", "b"),
    (13, "Le chat est sur le tapis et le chien dort dans la maison.", "fr", "b"),
    (14, "Le chat est sur le tapis et le chien dort dans la maison.", "fr", "b"),
    (14, "Le chat est sur le tapis et le chien dort dans la maison.", "fr", "b"),
    (15, "x" * 5000, "en", "a"), (16, "word " * 9000, "en", "a"), (17, "né <|endoftext|> 中文 ñ", "es", "c"), (None, "no id", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    for name in ("keep_id", "component", "node", "held_out", "score", "run"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false").checkpoint()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_bpe(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(bpe.public_vocabulary())
    want = []
    for i, text in rows_of(df):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.bpe_digest(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {(r.doc_id, r.decoded) for r in bpe.bpe_encode(df).collect()} == {(i, x or "") for i, x in rows_of(df)}


def test_bpe_pieces_like_the_library():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.public_vocabulary()), bpe.load(bpe.public_vocabulary())
    rng = random.Random(4)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "中", "😀", "23", "'s", "'ll", "<|endoftext|>", "\x1c", "\xa0", "!", "...", "\r\n", "²", "\x85", "aaaa", "ing"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(c.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_exact_dedup(which, request):
    import re

    df = request.getfixturevalue(which)
    groups: dict = {}
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", x or "")) for i, x in rows_of(df)]
    for i, x in norm:
        groups.setdefault(x, []).append(i)
    first = {x: min((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
    want = sorted(((i, first[x], len(groups[x]), i == first[x], hashlib.sha256(x.encode()).hexdigest()) for i, x in norm), key=repr)
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(df).collect()), key=repr) == want


def test_many_runs(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text")).repartition(40)
    got = exact_dedup.merge_runs(exact_dedup.digests(df).checkpoint(), fan_in=3).collect()
    assert sorted((r.keep_id, r.members) for r in got) == [(k, 858 if k < 1 else 857) for k in range(7)]


def test_merge_over_several_batches(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text")).repartition(4)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        got = exact_dedup.merge_runs(exact_dedup.digests(df).checkpoint()).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((r.keep_id, r.members) for r in got) == [(k, 4 if k < 100 else 3) for k in range(300)]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_token_files(spark, which, request, tmp_path):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(token_files.public_vocabulary())
    token_files.write_token_files(df, str(tmp_path / "f"), token_files.public_vocabulary())
    got = [tuple(r) for r in token_files.read_token_files(spark, str(tmp_path / "f")).collect()]
    want, base = [], 0
    for i, x in sorted(rows_of(df), key=lambda r: (r[0] is None, r[0])):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        base += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_fingerprint(text, words=4):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[k : k + words]), 42) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    every = [(i, plain_fingerprint(x)) for i, x in rows_of(df)]
    fp = [(i, x) for i, x in every if i is not None]
    linked = [(a, b) for a, x in fp for b, y in fp if a < b and (x ^ y).bit_count() <= 4]
    root = components_of({i for i, _ in fp}, linked)
    assert sorted((tuple(r) for r in simhash.simhash_groups(df).collect()), key=repr) == sorted(((i, f"{x:016x}", root.get(i)) for i, x in every), key=repr)


def test_links_meet_at_an_anchor():
    rng = np.random.default_rng(3)
    cover = simhash.Cover()
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    y = x.copy()
    for k in range(500):
        for b in rng.choice(64, k % 6, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    (a, f, home), (b, g, _) = cover.replicate(x), cover.replicate(y)
    at = {}
    for i, v in zip(b.tolist(), g.tolist()):
        at.setdefault(v, set()).add(i)
    own = {}
    for i, v, h in zip(a.tolist(), f.tolist(), home):
        if h:
            own.setdefault(v, set()).add(i)
    assert all(own[int(v)] & at[int(w)] for v, w in zip(x, y))


def test_bands_of_a_large_anchor(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64).repeat(20) ^ (np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64)))
    want = components_of(range(len(x)), [(i, j) for i in range(len(x)) for j in range(i) if (int(x[i]) ^ int(x[j])).bit_count() <= 4])
    for dense in (20_000, 10):
        monkeypatch.setattr(simhash, "DENSE", dense)
        assert components_of(range(len(x)), simhash.link(x)) == want


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = components_of({x for p in pairs for x in p}, pairs)
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_substring_dedup(which, request):
    df = request.getfixturevalue(which)
    rows = [(i, (x or "").encode()) for i, x in rows_of(df)]
    first: dict = {}
    for i, t in rows:
        for k in range(len(t) - 49 if i is not None else 0):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    want = []
    for i, t in rows:
        gone, end = bytearray(len(t)), 0
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[max(k, end) : k + 50] = b"\1" * (k + 50 - max(k, end))
                end = k + 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r) for r in substring_dedup.substring_dedup(df).drop("kept").collect()), key=repr) == sorted(want, key=repr)


def test_passages_at_any_shift(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 300))) for _ in range(20)]
    rows = [(k, "".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(20, 300)] for _ in range(rng.randint(0, 4)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)

    class Fixture:
        def getfixturevalue(self, _):
            return df

    test_substring_dedup("", Fixture())


def test_strings_are_told_apart_by_both_hashes():
    keys, more, ids = (np.array(x, np.uint64) for x in ([5, 5, 5, 2], [1, 2, 1, 1], [7, 3, 6, 9]))
    place, least = substring_dedup._classes_of(keys, more, ids.astype(np.int64))
    assert place.tolist() == [1, 2, 1, 0] and least.tolist() == [9, 6, 3]


def test_cover_has_each_distance():
    gaps = Counter((a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER if a != b)
    assert all(gaps[d] == 1 for d in range(1, substring_dedup.PERIOD))


def test_language_id(docs, odd, none):
    got = {(r.doc_id, r.held_out): r for r in langid.language_id(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [(r.lang_pred == true[i]) for (i, h), r in got.items() if h]
    assert len(held) > 30 and sum(held) / len(held) > 0.95
    assert all(h == (crc(i, 3) == 1) for i, h in got)
    odd_ = [(r.doc_id, r.lang_pred, r.score) for r in langid.language_id(odd).collect()]
    assert len(odd_) == len(ROWS) and {i for i, p, _ in odd_ if p == "und"} == {9, 10, 11, 12}
    assert all(0 <= s <= 1 for _, _, s in odd_)
    assert langid.language_id(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}


def test_automaton_phrases():
    rng = random.Random(1)
    for _ in range(200):
        s, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (12, 9))
        n, k = 0, 0
        while k < len(t):
            size = max((m for m in range(1, len(t) - k + 1) if t[k : k + m] in s), default=1)
            n, k = n + 1, k + size
        assert langid.SuffixAutomaton(s).phrases(t) == n


def test_predictions_equal_a_plain_cross_parser(docs):
    """Words, phrases, costs and scores restated with substring tests alone."""
    import re

    model = langid.fit(docs)
    assert len(model) == 4 and all(len(t) > 10_000 for _, t in model)
    small = [(g, t[:3000]) for g, t in model]
    parser = langid.CrossParser(small)
    bits = math.log2(max(len(t) for _, t in small) + 2)

    def plain(text):
        words = "".join(c if c.isalpha() or re.match(r"[^\W\d_]", c) else " " for c in text.lower()).split()
        if not any(c.isalpha() for c in "".join(words)):
            return "und", 0.0
        parsed, costs = f" {' '.join(words)} ", []
        for _, held in small:
            n = k = 0
            while k < len(parsed):
                size = 1
                while k + size < len(parsed) and parsed[k : k + size + 1] in held:
                    size += 1
                n, k = n + 1, k + size
            costs.append(n * bits)
        best = min(range(len(small)), key=costs.__getitem__)
        return small[best][0], 1 / sum(2.0 ** max(-1000.0, costs[best] - c) for c in costs)

    texts = [r["text"] for r in docs.orderBy("doc_id").limit(25).collect()] + ["", "123", "x", "né 中文 ñ", "²³", "The house is und der Hund la casa"]
    for t in texts:
        got, want = parser.predict(t), plain(t or "")
        assert got[0] == want[0] and got[1] == pytest.approx(want[1]), t


def test_memory_is_bounded_in_languages(spark):
    rows = [(k, "words of a language " + chr(97 + k % 26) * 5 + " " + "more text " * 40, f"l{k % 100}") for k in range(1200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model) == 100 and sum(len(t) for _, t in model) <= langid.ALL_CHARS + 100 * 30


def test_language_with_long_words_or_little_text(spark):
    """A language without blanks is learned; one with hardly any labelled text, or no letters, doesn't take over."""
    rng = random.Random(5)
    latin = ["house", "water", "green", "table", "river", "stone", "winter", "summer", "letter", "window"]
    rows = []
    for k in range(60):
        rows.append((2 * k, " ".join(rng.choice(latin) + rng.choice(["", "s", "ing", "ed"]) for _ in range(60)), "en"))
        rows.append((2 * k + 1, "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(200)), "zh"))
    rows += [(k, "123 456", "none") for k in range(500, 530)] + [(k, "a e", "tiny") for k in range(600, 630)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {k for k, _ in langid.fit(df)} == {"en", "zh", "tiny"}
    said = {r.doc_id: r.lang_pred for r in langid.language_id(df).collect()}
    assert all(said[i] == g for i, _, g in rows if g in ("en", "zh"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><form><p>Search</p><input></form><article><header><h1>A  &amp; B</h1></header><p>One<br>two <b>th</b>ree<p>Four&nbsp;five &lt;x&gt;<ul><li>i</li><li>j</ul>
<!-- <p>hidden</p> --><aside>Aside</aside><div id="comments"><p>First!</p></div></article><div class="ad">Buy</div><footer>(c)</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "", ""), (4, "http://a.example/y", "plain &amp; simple"), (5, "http://a.example/z", "<p>open <b>tag"), (5, "http://a.example/z", "<p>open <b>tag"), (6, "u", "<div " + "a" * 50_000 + "<p>x")]
    got = sorted(tuple(r) for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).collect() if r.page_id < 6 or True)
    main = "A & B\nOne two three\nFour five <x>\ni\nj"
    assert [(r[0], r[2]) for r in got[:6]] == [(1, main), (2, ""), (3, ""), (4, "plain & simple"), (5, "open tag"), (5, "open tag")]
    assert all(r[3] == len(r[2]) for r in got) and len(got) == 7
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract(empty).count() == 0


def test_style_tree_drops_what_repeats(spark, monkeypatch):
    rows = [(k, f"http://h{k % 2}.example/{k}", f"<body><div><p>Same on all pages</p></div><section><p>Only on page {k}</p></section></body>") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {(k, f"Only on page {k}") for k in range(40)}
    assert {(r.page_id, r.text) for r in html_extract.extract(df).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", 1)
    assert {(r.page_id, r.text) for r in html_extract.extract(df).collect()} == want


def test_tree_decides_inside_and_beside_an_article(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><article><div class='box'>Same on all pages</div><p>Story {k}</p></article><div class='body'>More of {k}</div></body>") for k in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {(r.page_id, r.text) for r in html_extract.extract(df).collect()} == {(k, f"Story {k}\nMore of {k}") for k in range(12)}


def test_all_words_of_a_style_count():
    for attrs, says in (('id="sidebar" class="col-md-4 d-none hidden-xs"', -2), ('class="alpha beta card dark sidebar"', -2), ('class="share-price"', -1), ('class="search-results story"', 0), ('class="a b c d e story"', 1), ('class="a b c d e f"', 0)):
        assert html_extract.style("div", attrs)[1] == says
    assert len({html_extract.style("div", f'class="a b c d e {x}"')[0] for x in "xyz"}) == 3


def test_all_low_nodes_of_all_hosts_count(spark, monkeypatch):
    rows = [(k, f"http://h{k}.example/", "<body>" + "".join(f"<div class='{c * 3}'>Same {c}</div>" for c in "xyz") + f"<p>Only {k}</p></body>") for k in range(20)]
    df = spark.createDataFrame([*rows, (20, "http://h20.example/", None)], "page_id bigint, url string, html string")
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", 1)
    assert {(r.page_id, r.text) for r in html_extract.extract(df).collect()} == {(k, f"Only {k}") for k in range(20)} | {(20, "")}


def test_head_without_its_end():
    for source in ("<head><title>t</title><body><article><p>Text</p></article></body>", "<html><head><meta charset=utf-8><style>p{}</style><p>Text", "<head><title>t</title></head><p>Text"):
        assert [x for _, x in html_extract.Page(source).blocks] == ["Text"]


def texts_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit("clash")).withColumn("h", F.lit(1))
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def test_the_tree_decides_on_every_page(spark, monkeypatch):
    """What most pages hold goes, wherever it stands; what differs stays, whatever stands around it."""
    sites = {
        "a": ("<article><p>Same on all pages</p><p>Only {k}</p></article>", "Only {k}"),
        "b": ("<div class='content'><ul><li>Home</li><li>About us</li></ul><p>Story {k}</p></div>", "Story {k}"),
        "c": ("<section class='search-results story'><p>Found {k}</p></section><div class='share-price'>At {k}.5 today</div>", "Found {k}\nAt {k}.5 today"),
        "d": ("<div class='post'><p>Post {k}</p></div><div><p>Beside {k}</p></div>", "Post {k}\nBeside {k}"),
        "e": ("<form id='aspnetForm'><div><p>Whole page {k} in a form</p></div></form>", "Whole page {k} in a form"),
        "f": ("<div class='alpha beta card dark sidebar'>Side {k}</div>" + "<div>" * 60 + "Deep {k}" + "</div>" * 60 + "<div>" * 30 + "<section>" + "<div>" * 29 + "Other {k}", "Deep {k}\nOther {k}"),
        "g": ("<div class='box'>{three}</div><p>Long unique text of page number {k}</p>", "Long unique text of page number {k}"),
    }
    rows, want = [], {}
    for n, (name, (source, text)) in enumerate(sites.items()):
        for k in range(40):
            rows.append((100 * n + k, f"http://{name}.example/{k}", "<body>" + source.replace("{k}", str(k)).replace("{three}", "Turning banner " + "xyz"[k % 3]) + "</body>"))
            want[100 * n + k] = text.replace("{k}", str(k))
    assert texts_of(spark, rows) == want
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", 0)
    assert texts_of(spark, rows) == want


def test_copies_of_a_page_are_no_menu(spark):
    rows = [(k, "http://h.example/", "<body><p>One article, many times</p></body>") for k in range(30)]
    assert set(texts_of(spark, rows).values()) == {"One article, many times"}


def plain_low(rows):
    """The rule on one machine: trees by recursion."""
    he = html_extract
    trees: dict = {}
    for host, source in rows:
        page = he.Page(source)
        if page.blocks:
            nodes = ((0, -1, he._kinds(page.kinds[0])), *((n, u, he._kinds(page.kinds[n])) for n, u in page.up.items()))
            trees.setdefault(host, set()).add((nodes, tuple(dict.fromkeys((n, he.content_key(n, t), len(t)) for n, t in page.blocks))))
    up, style, held = {}, {}, {}
    for host, pages in trees.items():
        for nodes, contents in pages:
            for n, u, kinds in nodes:
                up[n] = u
                style.setdefault((host, n), Counter())[kinds] += 1
            for n, key, size in contents:
                held.setdefault((host, n), Counter())[key, size] += 1
    for (host, n), c in [*style.items()]:
        for kinds, x in c.items():
            style.setdefault((he.EVERYWHERE, n), Counter())[kinds] += 1
    every: dict = {}
    for (host, n), c in held.items():
        for key, x in c.items():
            every.setdefault((he.EVERYWHERE, n), {}).setdefault(key, []).append(x)
    of_all = {n: sum(sum(c.values()) for (h, m), c in style.items() if m == n and h != he.EVERYWHERE) for n in up}
    low = set()
    for host in [*trees, he.EVERYWHERE]:
        here = [n for h, n in style if h == host]
        total, least = {n: sum(style[host, n].values()) for n in here}, he.ALL_HOSTS if host == he.EVERYWHERE else he.HOST_PAGES

        def own(n):
            size = worth = 0.0
            for (key, chars), x in (every if host == he.EVERYWHERE else held).get((host, n), {}).items():
                m, on, of = (len(x), sum(x), of_all[n]) if host == he.EVERYWHERE else (x, x, total[n])
                if total[n] >= least and on * 2 > of:
                    low.add((host, key, 2))
                else:
                    size += chars * m
                    worth += chars * m * (1 - math.log(m) / math.log(total[n]) if total[n] > 1 else 1)
            return size, worth

        sums = {n: own(n) for n in here}

        def below(n):
            parts = [sums[n], *(below(c) for c in here if up[c] == n)]
            return sum(p[0] for p in parts), sum(p[1] for p in parts)

        for n in here:
            size, worth = below(n)
            c, m = style[host, n], total[n]
            shown = -sum(x / m * math.log(x / m) for x in c.values()) / math.log(m) if m > 1 else 1
            trust = he.DECAY ** (len(c) - 1)
            value = (1 - trust) * shown + trust * (worth / size if size else 0)
            if m >= least and (value < he.MIDDLING or n == 0):
                low.add((host, n, 2 if value < he.LOW else 1 if value < he.MIDDLING else 0))
    return low


def test_low_nodes_equal_a_plain_tree(spark):
    rng = random.Random(12)

    def piece(depth):
        if depth == 0:
            return rng.choice(["Same for long", "Often " + rng.choice("ab"), f"New {rng.randrange(40)}", "Turn " + "xyz"[rng.randrange(3)] * 9])
        return "".join(f"<{tag}>{piece(depth - 1)}</{tag}>" for tag in rng.sample(["div", "section", "ul"], rng.randint(2, 3)))

    rows = [(f"h{min(k % 14, 10)}.example", piece(2)) for k in range(160)]
    rows += rows[:10]
    df = spark.createDataFrame([(k, f"http://{h}/{k}", x) for k, (h, x) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {(r.host, r.key, r.level) for r in html_extract.low_nodes(df).collect()}
    assert got == plain_low(rows) and {x for _, _, x in got} == {0, 1, 2}


def brute_links(rows):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[n] = (i, np.array(v, np.float64), label)
    linked = [(a, b) for a, (_, x, k) in ok.items() for b, (_, y, m) in ok.items() if a != b and k == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93]
    n, root = Counter(a for a, _ in linked), components_of({r[0] for r in rows}, [(rows[a][0], rows[b][0]) for a, b in linked])
    return sorted(((r[0], n[k], root[r[0]], r[0] == root[r[0]]) for k, r in enumerate(rows)), key=repr)


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(60, 16))
    rows = []
    for k in range(900):
        v = centre[k % 60] + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.6])
        rows.append((k, np.float32(v).tolist(), k % 2))
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [nan] * 16, 0), (1004, [inf] + [1.0] * 15, 0), (1005, [None] + [1.0] * 15, 0), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("members", F.lit("clash"))
    named = df.withColumn("label", F.concat(F.lit("l"), "label"))
    assert sorted((tuple(r) for r in embedding_dedup.embedding_groups(named).collect()), key=repr) == brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert embedding_dedup.embedding_groups(df.where("false")).count() == 0


def dense_cluster(spark, n, dim, noise, label=0):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=dim)
    centre /= np.linalg.norm(centre)
    x = centre + rng.normal(size=(n, dim)) * noise / math.sqrt(dim)
    return spark.createDataFrame([(k, np.float32(v).tolist(), label) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")


def test_a_dense_cluster_is_dealt_once(spark):
    """Rows grow with the vectors, not with their square: 20,000 distinct ones within the threshold of each other."""
    dealt = {}
    for n in (5000, 20_000):
        df = dense_cluster(spark, n, 24, 0.2).select(F.col("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("string"), F.lit(True).alias("usable"))
        dealt[n] = embedding_dedup._shards(embedding_dedup._classes(df).checkpoint()).count()
    assert dealt[20_000] <= 1.5 * 20_000 and dealt[20_000] <= 5 * dealt[5000]


@pytest.mark.parametrize("noise", [0.2, 0.36])
def test_links_of_a_dense_cluster(spark, noise, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 300)
    monkeypatch.setattr(embedding_dedup, "CELL", 200)
    monkeypatch.setattr(embedding_dedup, "DENSE", 150)
    df = dense_cluster(spark, 2500, 24, noise)
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(df).collect()}
    there, found = near.sum(axis=1) - 1, np.array([got[k].n_links for k in range(len(x))])
    assert (found <= there).all() and found.sum() >= 0.97 * there.sum() and there.sum() > len(x)
    if noise == 0.2:
        assert (found == there).all() and {r.component_id for r in got.values()} == {0}


def plain_kept(d, between):
    """Robust pruning of one vector's candidates, one after the other; d and between are squared distances."""
    kept = []
    for k in sorted(range(len(d)), key=lambda k: d[k]):
        if len(kept) < embedding_dedup.DEGREE and all(embedding_dedup.ALPHA**2 * between[i][k] > d[k] for i in kept):
            kept.append(k)
    return sorted(kept)


def test_lists_are_pruned_side_by_side(monkeypatch):
    """Calls go with cells and blocks, not with vectors, and each row is pruned as if alone; a list longer than WIDE too."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    prune, calls = embedding_dedup.robust_prune, []
    monkeypatch.setattr(embedding_dedup, "robust_prune", lambda *a: calls.append(1) or prune(*a))
    begin, near = embedding_dedup.build_graph(x, 1)
    assert len(calls) < 60
    monkeypatch.setattr(embedding_dedup, "WIDE", 1)
    again = embedding_dedup.build_graph(x[:300], 1)
    monkeypatch.setattr(embedding_dedup, "WIDE", 2000)
    assert all((a == b).all() for a, b in zip(again, embedding_dedup.build_graph(x[:300], 1)))
    assert len(begin) == 3001 and begin[-1] == len(near) and np.diff(begin).min() > 0 and np.diff(begin).max() <= 2 * embedding_dedup.DEGREE
    y = np.stack([x[rng.permutation(3000)[:80]] for _ in range(20)])
    d = 2 - 2 * (y @ x[:20, :, None])[:, :, 0]
    order = np.argsort(d, axis=1)
    d, y = np.take_along_axis(d, order, axis=1), np.take_along_axis(y, order[:, :, None], axis=1)
    apart = 2 - 2 * (y @ y.transpose(0, 2, 1))
    kept = prune(d, lambda rows, k: apart[rows, k, k + 1 :])
    assert [np.flatnonzero(r).tolist() for r in kept] == [plain_kept(a, b) for a, b in zip(d.tolist(), apart.tolist())]


@pytest.mark.parametrize("marks", [1, 1 << 22])
def test_searches_side_by_side(monkeypatch, marks):
    """What is found doesn't hang on the queries beside it, and is what brute force finds."""
    monkeypatch.setattr(embedding_dedup, "MARKS", marks)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 32))[rng.integers(0, 300, 4000)] + rng.normal(size=(4000, 32)) * 0.15
    x[:2000] = x[0] + rng.normal(size=(2000, 32)) * 0.1  # these meet too many
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    begin, near = embedding_dedup.build_graph(x, 1)
    asked = np.arange(0, 4000, 5)
    q, hit, dense = embedding_dedup.range_search(x, begin, near, 7, asked, 0.93)
    there = x @ x.T >= 0.93
    np.fill_diagonal(there, False)
    assert set(range(0, 2000, 5)) <= set(dense.tolist()) and not set(dense.tolist()) & set(q.tolist())
    there[np.setdiff1d(np.arange(4000), np.setdiff1d(asked, dense))] = False
    assert len(q) > 500 and there[q, hit].all() and len(set(zip(q.tolist(), hit.tolist()))) == len(q) >= 0.99 * there.sum()
    assert [len(v) for v in embedding_dedup.range_search(x[:0], np.zeros(1, int), near[:0], 0, near[:0], 0.93)] == [0, 0, 0]


def test_a_search_holds_little_in_a_dense_cluster(monkeypatch):
    """Queries that meet thousands in range go on from IN_RANGE of them in a round, not from all."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=24) * 10 + rng.normal(size=(2400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    begin, near = embedding_dedup.build_graph(x, 1)
    dots, sizes = embedding_dedup.dots, []
    monkeypatch.setattr(embedding_dedup, "dots", lambda x, a, b: sizes.append(len(a)) or dots(x, a, b))
    q, hit, dense = embedding_dedup.range_search(x, begin, near, 7, np.arange(400), 0.93)
    assert len(dense) == 400 and len(q) == 0
    assert max(sizes) <= 400 * embedding_dedup.IN_RANGE * 2 * embedding_dedup.DEGREE // 2


def test_recall_on_the_stated_queries(spark):
    """Vectors whose id is divisible by 20 against all, by brute force."""
    path = "/root/testdata/check_s/embeddings.parquet"  # the smaller tables hold no links
    if not os.path.exists(path):
        pytest.skip("no such table here")
    found, there = embedding_dedup.audit(spark.read.parquet(path))
    assert there > 20 and found >= 0.9 * there


def test_embedding_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 150)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(300, 32))
    rows = [(k, np.float32(centre[k % 300] + rng.normal(size=32) * 0.15).tolist(), 0) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found, there = embedding_dedup.audit(df)
    assert there > 150 and found >= 0.97 * there


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_lm_scores(which, request):
    df = request.getfixturevalue(which)
    rows = rows_of(df)
    tokens = [(x or "").encode().lower().split() + [None] for _, x in rows]
    out = [i is not None and crc(i, 7) == 2 for i, _ in rows]
    c = Counter(t for ts, h in zip(tokens, out) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 5)) for (i, _), ts, h in zip(rows, tokens, out)), key=repr)
    got = context_mixing.lm_scores(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if which == "docs":
        assert sum(r.bits_per_byte for r in got if r.held_out) / sum(r.held_out for r in got) < 3.2


def small_model(texts, fit=True):
    """A model trained on texts without Spark, and the counts that it is made of."""
    cm = context_mixing
    c = Counter(k for t in texts for k in cm.pieces_of(cm.tokens_of(t)))
    top = {k: n for k, n in c.items() if n > 1 and not k.startswith(b" ")} | {cm.END: max(1, c[cm.END])}
    tree = cm.Vocabulary(list(top), np.array(list(top.values())), sum(c.values()) - sum(top.values()))
    names = [k for k in c if k != cm.END]
    n = np.array([1 if k in top else c[k] for k in names])
    trees = cm.Trees(cm.pair_counts(names, n).reshape(256, 256))
    d = cm.Decisions(trees, [cm.coded(k) for k in names])
    states = []
    for h in d.hashes:
        q = cm.quantised(np.bincount(cm.slots(h, 14) * 2 + d.bit, weights=np.repeat(n, d.size), minlength=2 << 14).reshape(-1, 2)).astype(np.uint16)
        states.append(q[:, 0] << 8 | q[:, 1])
    rng = np.random.default_rng(3)
    spelling = cm.Spelling(trees, states, rng.uniform(0.1, 0.5, (cm.GATES, cm.Spelling.inputs)).astype(np.float32))
    words = cm.Words(tree, spelling)
    pairs = cm.Pairs(words, 14)
    pairs.add([cm.pieces_of(cm.tokens_of(t)) for t in texts])
    q = cm.quantised(pairs.counts.reshape(-1, 2)).astype(np.uint16)
    return cm.Mixer(words, q[:, 0] << 8 | q[:, 1], rng.uniform(0.1, 0.9, (cm.GATES, cm.Mixer.inputs)).astype(np.float32))


def plain_score(mixer, text, window=1 << 60):
    """The same model bit by bit, in whole numbers and dictionaries."""
    cm, tree, spelling = context_mixing, mixer.words.tree, mixer.words.spelling
    upto = np.concatenate([[0.0], np.cumsum(tree.count)])
    of_word = {w: k for k, w in enumerate(tree.words)}
    M = (1 << 32) - 1

    def tree_path(leaf):
        lo, hi = 0, len(tree.count)
        while hi - lo > 1:
            half = min(range(lo + 1, hi), key=lambda m: (abs(2 * upto[m] - upto[lo] - upto[hi]), -m))
            seen = upto[hi] - upto[lo]
            yield half * 0x9E3779B1 & M, int(leaf >= half), math.log((upto[hi] - upto[half]) / (upto[half] - upto[lo])), math.log(seen)
            lo, hi = (half, hi) if leaf >= half else (lo, half)

    def state_of(table, h):
        return int(table[(h * 0x9E3779B1 & M) >> (32 - (len(table).bit_length() - 1))])

    def spelt_path(string):
        trees = spelling.trees
        for k, byte in enumerate(string):
            past = b" " * 5 + string[:k]
            code = past[-1] << 8 | byte
            short, h = [], 0
            for j in range(1, 6):
                h = (h + past[-j] + j) * 0x2C9277B5 & M
                h ^= h >> 15
                if j in cm.ORDERS:
                    short.append(h)
            far = sum(int(cm._BYTE[b]) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, b in enumerate(string[:k])) % (1 << 64)
            far = ((far ^ far >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 32
            for at in range(int(trees.start[code]), int(trees.start[code] + trees.size[code])):
                node, bit = int(trees.node[at]), int(trees.bit[at])
                word = (far + node * 0x9E3779B1 & M) * 0xC2B2AE35 & M
                word ^= word >> 15
                hs = [((x * 0x85EBCA6B & M) + node * 0x9E3779B1 & M) * 0xC2B2AE35 & M for x in short] + [word]
                found = [state_of(t, x) for t, x in zip(spelling.states, hs)]
                gate = cm.SEEN[found[2]] * cm.CLASSES + cm.SEEN[found[1]]
                z = sum(w * x for w, x in zip(spelling.weights[gate].tolist(), [float(trees.prior[past[-1] << 8 | node]), *(float(cm.LOGIT[x]) for x in found), 1.0]))
                yield word, bit, z, -math.inf

    before, offset, segment, total, since, passed = None, 0, 0, 0.0, 0, 0
    seen, own, step = {}, {}, {}
    for name in cm.pieces_of(cm.tokens_of(text)):
        string = cm.coded(name)
        path = list(tree_path(of_word[name])) if name in of_word else [*tree_path(len(tree.words)), *spelt_path(string)]
        passed += len(path)
        if (passed // window) != since:  # another window: its place and memory begin anew
            since, offset, seen = passed // window, 0, {}
            before = None
            segment = -1
        now = int(np.searchsorted(cm.BOUNDS, offset, side="right"))
        if now != segment:
            for k, x in step.items():
                own[k] = own.get(k, 0.0) + x * float(cm.RATE)
            step, segment = {}, now
        key = cm.xxh64_intdigest(before, 42) >> 32 if before in of_word else 0
        often = math.log(tree.count[of_word[before]]) if before in of_word else -math.inf
        for word, bit, level, node_seen in path:
            pair = 0
            if np.float32(node_seen) + np.float32(often) >= mixer.floor:
                pair = state_of(mixer.pairs, ((key * 0x2C9277B5 & M) ^ word) * 0x85EBCA6B & M)
            n = seen.setdefault(word, [0, 0])
            here = min(n[0], 127) << 8 | min(n[1], 127)
            n[bit] += 1
            gate = int(cm.SEEN[pair] * cm.CLASSES + cm.SEEN[here])
            inputs = [level, float(cm.LOGIT[pair]), float(cm.LOGIT[here])]
            dot = sum((float(mixer.weights[gate, k]) + own.get((gate, k), 0.0)) * x for k, x in enumerate(inputs))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, dot if bit else -dot))))
            total += math.log10(p)
            for k, x in enumerate(inputs):
                step[gate, k] = step.get((gate, k), 0.0) + (1 - p) * (1 if bit else -1) * x
        before, offset = name, offset + len(string)
    return total


LM_TEXTS = ["the cat sat on the mat and the cat ate", "a dog sat on a log and the dog slept", "the mat the mat the mat " * 40, "", None, "zebra " + "q" * 120 + " zebra the", "né 中文 né the cat"]


def test_scores_equal_a_plain_model_bit_by_bit(docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    mixer = small_model(LM_TEXTS[:5] + texts[:30])
    asked = LM_TEXTS + texts[25:35]
    got = mixer.scores(context_mixing._numbered(mixer.words, [context_mixing.tokens_of(t) for t in asked]))
    assert got.tolist() == pytest.approx([plain_score(mixer, t) for t in asked], rel=2e-4)


def test_windows_of_a_very_long_text(monkeypatch):
    mixer = small_model(LM_TEXTS)
    monkeypatch.setattr(context_mixing, "WINDOW", 300)
    asked = [LM_TEXTS[0], LM_TEXTS[2], LM_TEXTS[1]]
    got = mixer.scores(context_mixing._numbered(mixer.words, [context_mixing.tokens_of(t) for t in asked]))
    assert got.tolist() == pytest.approx([plain_score(mixer, t, 300) for t in asked], rel=2e-4)


def test_decisions_are_a_code():
    """The probabilities of all words of the tree and the escape add up to one, and so do those of all first bytes of what is spelt."""
    mixer = small_model(LM_TEXTS)
    tree = mixer.words.tree
    w = mixer.words
    p = [np.prod(1 / (1 + np.exp(-tree.prior[tree.node[a : a + n]] * (tree.bit[a : a + n] * 2.0 - 1)))) for a, n in zip(tree.start.tolist(), tree.size.tolist())]
    assert sum(p) == pytest.approx(1, abs=1e-5)
    assert p == pytest.approx((tree.count / tree.count.sum()).tolist(), rel=1e-4)
    total = 0.0
    for byte in range(256):
        d = context_mixing.Decisions(w.spelling.trees, [bytes([byte])])
        total += float(np.prod(1 / (1 + np.exp(-w.spelling.logits(d) * (d.bit * 2.0 - 1)))))
    assert total == pytest.approx(1, abs=1e-5)


def test_first_weights_are_fitted_to_all_training_texts(docs, monkeypatch):
    fit, got = context_mixing._fit_pairs, []
    monkeypatch.setattr(context_mixing, "FIT_SHARE", 1 << 40)  # an empty start
    monkeypatch.setattr(context_mixing, "_fit_pairs", lambda *a: got.append(fit(*a)) or got[-1])
    assert context_mixing.lm_scores(docs.limit(60)).count() == 60
    assert not np.allclose(got[0], context_mixing.FIRST)


def test_counting_lets_an_earlier_model_go():
    common._HELD["words of another run"] = np.zeros(10)
    got = list(context_mixing._counted(iter([pa.RecordBatch.from_pydict({"text": ["a b A", None]})])))
    assert not common._HELD
    assert dict(zip(got[0]["key"].to_pylist(), got[0]["n"].to_pylist())) == {b"a": 2, b"b": 1, b"\n": 2}


def test_texts_side_by_side_are_few_and_score_alike(monkeypatch):
    mixer = small_model(LM_TEXTS)
    number = context_mixing._numbered(mixer.words, [context_mixing.tokens_of(t) for t in LM_TEXTS])
    size = [int(mixer.words.size[t].sum()) for t in number]
    whole = mixer.scores(number)
    monkeypatch.setattr(context_mixing, "SIDE", 300)
    runs = list(mixer.windows(number))
    assert [t.tolist() for run in runs for t in run] == [t.tolist() for t in number]  # no text is cut
    assert all(len(run) == 1 or sum(int(mixer.words.size[t].sum()) for t in run) <= 300 for run in runs) and max(size) > 300
    assert mixer.scores(number).tolist() == pytest.approx(whole.tolist(), rel=1e-6)


def test_weights_learn_within_short_texts(monkeypatch):
    mixer = small_model(LM_TEXTS)
    number = context_mixing._numbered(mixer.words, [b"the mat".split() * 60])
    online, moved = mixer.run(number)
    assert np.abs(moved).max() > 0
    monkeypatch.setattr(context_mixing, "RATE", np.float32(0))
    assert mixer.run(number)[0][0] < online[0]


def test_a_document_is_scored_alone():
    mixer = small_model(LM_TEXTS)
    texts = [[b"ab" * 700, b"c"], [], [b"x"] * 900, [b"the", b"cat"]]
    alone = [mixer.scores(context_mixing._numbered(mixer.words, [t]))[0] for t in texts]
    assert mixer.scores(context_mixing._numbered(mixer.words, texts)).tolist() == pytest.approx(alone, rel=1e-6)


def test_pairs_fit_the_table():
    rng = np.random.default_rng(1)
    tree = context_mixing.Vocabulary([f"w{k}".encode() for k in range(500)], rng.zipf(1.3, 500).clip(1, 10**6), 50)
    node = tree.seen[tree.seen > 0]
    for slots in (1 << 8, 1 << 12, 1 << 20):
        needed = sum((tree.count[:-1] * n >= math.exp(tree.pair_floor(slots))).sum() for n in node)
        assert needed <= slots // 2


def test_every_pair_of_words_is_counted(monkeypatch):
    """Rare pairs and spelt words too: states and gates of a text's decisions equal counts in dictionaries."""
    cm, words = context_mixing, small_model(LM_TEXTS[:3]).words
    train = [cm.pieces_of(cm.tokens_of(t)) for t in [*LM_TEXTS, "zebra né", "dog zebra né sat", "the cat zebra né sat"]]
    monkeypatch.setattr(cm, "SIDE", 300)
    pairs = cm.Pairs(words, 12)
    pairs.add(train[:2])
    pairs.add(train[2:])
    n, want = 0, [Counter(), Counter()]

    def decisions(names):
        number, before = words.numbers(names), None
        for name, k in zip(names, number.tolist()):
            key = 0 if before is None else cm.xxh64_intdigest(before, 42) >> 32
            often = np.log(np.float32(words.tree.count[words.tree.words.index(before)])) if before in words.tree.words else -np.inf
            for at in range(int(words.start[k]), int(words.start[k] + words.size[k])):
                slot = int(cm.pair_slots(np.array([key], np.uint32), words.hash[at : at + 1], 12)[0])
                yield int(words.seen[at] + often < pairs.floor), slot, int(words.bit[at])
            before = name

    for names in train:
        for rare, slot, bit in decisions(names):
            want[rare][slot << 1 | bit] += 1
            n += 1
    assert int(pairs.counts.sum()) + int(pairs.others.sum()) == n
    for got, counted in zip((pairs.counts, pairs.others), want):
        assert {k: int(got[k]) for k in np.flatnonzero(got).tolist()} == dict(counted)
    assert min(sum(w.values()) for w in want) > 50
    q = cm.quantised(pairs.both.reshape(-1, 2)).astype(np.uint16)
    mixer = cm.Mixer(words, q[:, 0] << 8 | q[:, 1], shared=True)
    asked = train[-1]
    inputs, gate, bit, _, _ = mixer.predictors([words.numbers(asked)])
    for k, (rare, slot, b) in enumerate(decisions(asked)):
        state = int(mixer.pairs[rare << 12 | slot])
        assert (b, inputs[1][k]) == (bit[k], cm.LOGIT[state])
        assert gate[k] // cm.CLASSES == cm.SEEN[state] + rare * cm.CLASSES


def test_rare_pairs_tell(docs):
    """A text of words that were read in this order scores better than without the others' table."""
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(30).collect()]
    cm, mixer = context_mixing, small_model(texts)
    pairs = cm.Pairs(mixer.words, 14)
    pairs.add([cm.pieces_of(cm.tokens_of(t)) for t in texts])
    q = cm.quantised(pairs.both.reshape(-1, 2)).astype(np.uint16)
    states = q[:, 0] << 8 | q[:, 1]
    number = cm._numbered(mixer.words, [cm.tokens_of(t) for t in texts])
    with_, without = cm.Mixer(mixer.words, states, shared=True), cm.Mixer(mixer.words, states[: 1 << 14])
    assert with_.scores(number).sum() > without.scores(number).sum()


def test_counts_are_squeezed_and_widened():
    for values in (np.array([], np.uint32), np.array([0, 1, 255, 256, 2**32 - 1], np.uint32), np.ones(1000, np.uint32)):
        assert context_mixing._widen(context_mixing._squeeze(values)).tolist() == values.tolist()


def test_tokens_of_texts_together():
    """Distinct tokens and their places say what tokens_of says of each text; each token is asked for once, whole or in pieces."""
    rng = np.random.default_rng(4)
    parts = ["a", "B", "é", "İ", " ", "\t", "\n", "\x0b", "\f", "\r", "\x1c", "\x85", "\xa0", "\u2003", "Zz", "q" * 30, "中", "\0"]
    cm, words = context_mixing, small_model(LM_TEXTS).words
    for _ in range(200):
        texts = [None, "", " ", *("".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(5)), "the cat " * 9]
        want = [cm.tokens_of(t) for t in texts]
        t = cm.Tokens(pa.array(["not these", *texts]).slice(1))
        assert [[t.names[c] for c in t.code[a : a + n]] for a, n in zip(t.first, t.count)] == [[*w, cm.END] for w in want]
        assert len(set(t.names)) == len(t.names)
        number, count, _ = t.numbers(words)
        name = {k: n for n, k in words.number.items()}
        assert [[name[k] for k in n.tolist()] for n in cm._by_text(number, count)] == [cm.pieces_of(w) for w in want]


def test_newton_sums_are_plain_sums():
    cm, rng = context_mixing, np.random.default_rng(6)
    x = rng.normal(size=(3, 500)).astype(np.float32) * 3
    gate, bit, times = rng.integers(0, 5, 500) * 3, rng.integers(0, 2, 500).astype(np.uint8), rng.integers(1, 9, 500).astype(float)
    weights, want = rng.normal(size=(20, 3)).astype(np.float32), np.zeros((20, 12))
    for k, g in enumerate(gate.tolist()):
        v = x[:, k].astype(float)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[g] @ v)))))
        want[g] += times[k] * np.concatenate([(bit[k] - p) * v, (max(p * (1 - p), 1e-6) * np.outer(v, v)).ravel()])
    for some in (cm.SORTED, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(cm, "SORTED", some)
            assert np.allclose(cm.newton_sums(list(x), gate, bit, weights, times), want, rtol=1e-4, atol=1e-3)


def test_work_follows_what_is_read(monkeypatch):
    """A long text beside short ones goes on alone: no sums over cells of texts that have ended."""
    mixer, cells, bincount = small_model(LM_TEXTS), [], np.bincount
    texts = [b"the mat".split()] * 200 + [b"the cat sat on the mat".split() * 400]
    number = context_mixing._numbered(mixer.words, texts)
    alone = [mixer.scores([n])[0] for n in (number[0], number[-1])]
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: cells.append(minlength) or bincount(x, weights=weights, minlength=minlength))
    got, _ = mixer.run(number)
    assert got.tolist() == pytest.approx([alone[0]] * 200 + [alone[1]], rel=1e-6)
    assert sorted(cells)[len(cells) // 2] == mixer.gates and max(cells) == mixer.gates * len(texts)


def test_a_broadcast_table_is_read_into_memory_of_its_own():
    values = np.arange(1000, dtype=np.uint16)
    for protocol in (4, 5, pickle.HIGHEST_PROTOCOL):
        got = pickle.loads(pickle.dumps(context_mixing.Table(values), protocol)).values
        assert got.flags.owndata and got.dtype == values.dtype and got.tolist() == values.tolist()
    spelling = small_model(LM_TEXTS).words.spelling
    again = pickle.loads(pickle.dumps(spelling, 5))
    assert all(s.flags.owndata and (s == t).all() for s, t in zip(again.states, spelling.states)) and (again.weights == spelling.weights).all()
    assert pickle.loads(pickle.dumps(context_mixing.Spelling(spelling.trees), 5)).states is None


def test_batches_are_small_while_scores_are_made(docs, spark, monkeypatch):
    name, seen, fit = "spark.sql.execution.arrow.maxRecordsPerBatch", [], context_mixing._fit_pairs
    before = spark.conf.get(name)
    monkeypatch.setattr(context_mixing, "_fit_pairs", lambda *a: seen.append(int(spark.conf.get(name))) or fit(*a))
    assert context_mixing.lm_scores(docs.limit(20)).count() == 20
    assert seen == [context_mixing.ROWS] and spark.conf.get(name) == before


def plain_fill(children, budget):
    left, got = dict(children), {}
    while left:
        weight = sum(w for w, _ in left.values())
        full = {k for k, (w, cap) in left.items() if cap <= budget * w / weight + 1e-9}
        if not full:
            return got | {k: budget * w / weight for k, (w, _) in left.items()}
        for k in full:
            got[k] = left.pop(k)[1]
            budget -= got[k]
    return got


def test_water_fill(spark):
    rng = random.Random(3)
    for _ in range(8):
        kids = {f"c{k}": (rng.randint(1, 5), rng.randint(0, 100)) for k in range(rng.randint(1, 6))}
        budget = rng.randint(0, 300)
        df = spark.createDataFrame([(k, w, cap, budget) for k, (w, cap) in kids.items()], "name string, weight bigint, cap bigint, budget bigint")
        got = {r["name"]: r["got"] for r in mixing.water_fill(df, [], "name", "got").collect()}
        want = plain_fill(kids, budget)
        assert all(abs(got[k] - want[k]) <= 1 for k in kids)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    used: Counter = Counter()
    target = {}
    for r in got:
        used[r.domain, r.lang, r.source] += r.n_tokens * r.epochs
        target[r.domain, r.lang, r.source] = r.target
        assert 0 <= r.epochs <= mixing.MAX_EPOCHS
    longest = max([r.n_tokens for r in got], default=0)
    assert all(t - longest <= used[k] <= t for k, t in target.items())
    again = mixing.mixed_documents(df)
    assert again.columns == df.columns and again.count() == sum(r.epochs for r in got)


def test_mixing_ends_in_any_bucket(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    one = {r.doc_id: r.epochs for r in mixing.mix(df, share=(1, 3)).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert one == {r.doc_id: r.epochs for r in mixing.mix(df, share=(1, 3)).collect()} and 0 in one.values()


def test_pipeline(spark, docs, odd, none):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "bpe"]
    told = cp.identify_language(spark, odd, SF)
    assert told.columns == odd.columns and {r.doc_id for r in told.collect()} == {None, 3, 7, 13, 14, 15, 16, 17}
    unlabelled = cp.identify_language(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 1, F.col("lang"))), SF).join(docs.select("doc_id", F.col("lang").alias("was")), "doc_id")
    assert unlabelled.where("lang is null").count() == 0 and unlabelled.where("lang <> was").count() < 0.05 * unlabelled.count()
    once = cp.drop_exact_copies(spark, odd, SF)
    assert {r.doc_id for r in once.collect()} == {None, 3, 9, 12, 13, 15, 16, 17, 11}
    assert once.columns == odd.columns
    near = spark.createDataFrame([(k, " ".join(f"w{j * 7 % 101}" for j in range(400)) + (" end" * (k == 2)), "en", "a") for k in (1, 2)] + [(3, "other words altogether", "en", "a")], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in cp.drop_near_copies(spark, near, SF).collect()} == {1, 3}
    for df in (docs, odd, none):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SF)
            assert name == "bpe" or out.columns == df.columns
            df = out.checkpoint()
    got = {tuple(r) for r in cp.run(spark, SF).collect()}
    assert len(got) > 100


def test_rows_go_by_id_and_text(spark, monkeypatch):
    """A text isn't lost because its id repeats, and of equal rows one stays."""
    import corpus_pipeline as cp
    from stemline.llm import common

    rows = [(1, "a a"), (2, "unique text here"), (2, "a  a"), (3, "b"), (3, "b"), (3, "b "), (None, "c"), (None, "c"), (None, "a a"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_row", F.lit(1)).withColumn("digest", F.lit(2))
    want = {(1, "a a"), (2, "unique text here"), (3, "b"), (3, "b "), (None, "c"), (4, None)}
    long = " ".join(f"w{k}" for k in range(90))
    near = [(1, long), (2, "unique text here"), (2, long + " end"), (3, "b"), (3, "b"), (None, "c"), (None, "c"), (None, long + " other end"), (4, None), (5, "")]
    for bound in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        got = [(r.doc_id, r.text) for r in cp.drop_exact_copies(spark, df, SF).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, spark.createDataFrame(near, "doc_id bigint, text string").withColumn("_row", F.lit(1)), SF).collect()]
        assert sorted(got, key=repr) == sorted([(1, long), (2, "unique text here"), (3, "b"), (None, "c"), (4, None)], key=repr)


def test_weights_of_zero(spark):
    df = spark.createDataFrame([(k, "w " * (k % 5), ["en", "de"][k % 2], f"src{k % 3}") for k in range(60)], "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(df, source_weights={"src0": 0}, lang_weights={"en": 0}).collect()
    assert all((r.epochs == 0) == (r.source == "src0" or r.lang == "en" or r.n_tokens and r.epochs == 0) for r in got)
    assert {r.epochs for r in got if r.source == "src0" or r.lang == "en"} == {0} and any(r.epochs for r in got)
    assert {r.epochs for r in mixing.mix(df, source_weights={f"src{k}": 0 for k in range(3)}).collect()} == {0}


def test_near_copies_by_similarity(spark):
    """Every pair of five-word similarity 0.8 or more is found, though SimHash alone sees few of them; and no other is."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    rows, pairs = [], []
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        near = list(words)
        for _ in range(max(1, round(len(words) * rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])))):
            near[rng.randrange(len(near))] = f"v{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
        a, b = ({" ".join(x[j : j + 5]) for j in range(len(x) - 4)} for x in (words, near))
        pairs.append((k, len(a & b) / len(a | b)))
    assert sum(0.8 <= j < 0.9 for _, j in pairs) > 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in cp.drop_near_copies(spark, df, SF).collect()}
    assert kept == {i for i, _ in rows} - {2 * k + 1 for k, j in pairs if j >= 0.8}


def test_sql_of_registered_queries(spark):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
    for name, sql in queries.SQL.items():
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        ours = sorted(tuple(x[c] for c in names) for x in queries.QUERIES[name](spark, SF).select(names).collect())
        assert ours == sorted(r.fetchall()), name


def test_replaced_models_leave_no_memory_behind():
    import subprocess
    import sys

    code = """
import os
import pickle
from stemline.llm.common import held
mb = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
before = mb()
pins = []
def model():
    out = []
    for k in range(200_000):
        out.append(bytes(1000))
        if k % 100 == 0:
            pins.append(bytes(1000))
    return out
held("a", model)
full = mb()
held("b", dict)
print(before, full, mb())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
    before, full, after = map(int, got.split())
    assert full - before > 180 and after - before < 60
