"""The numbered operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.llm import html_density, jaccard_join, license_index, pair_rank, piece_codec, toxicity_cnn
from quillmesh.llm.common import read
from quillmesh.llm.decision_list import learn, quality_rules
from quillmesh.llm.decontaminate import find_leaks
from quillmesh.llm.html_density import extract_text, main_text
from quillmesh.llm.jaccard_join import jaccard_components
from quillmesh.llm.license_index import scan_licenses
from quillmesh.llm.pair_rank import rank_quality
from quillmesh.llm.piece_codec import codec, encode_documents
from quillmesh.llm.toxicity_cnn import filter_toxic, score_toxicity
from quillmesh.llm.url_markov import judge_urls
from quillmesh.llm.warc_chunks import archive_round_trip, chunk_table, read_archives

DATA = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id bigint, text string, key string, n int, score double"


def docs(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], DOC)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three"), (4, "word " * 30_000), (4, "word " * 30_000), (5, "\u00a0é\u2003ß\x1c A")]


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
    <main><article><h1>Head &amp; tail</h1><p>First <b>bold</b>
    line.<p>Second&nbsp;line<br>goes on.<ul><li>one<li>two</ul><script>bad("</p>")</script><form><input>Name</form></article></main>
    <aside>Side</aside><section id="comments"><p>I disagree with this article very much indeed.</p></section><div class="ad">Buy now</div><footer>&copy;</footer></body></html>"""
    assert main_text(page) == "Head & tail\nFirst bold line.\nSecond line goes on.\none\ntwo"
    assert main_text("just text") == "just text"
    rows = spark.createDataFrame([(1, "u", page, "a"), (2, None, None, "b"), (None, "u", "", "c"), (3, "u", "<p>" * 5000, "d")], "page_id bigint, url string, html string, text string")
    got = extract_text(rows).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(main_text(page))), (2, 0), (None, 0), (3, 0)]
    assert extract_text(rows.limit(0)).count() == 0


def test_main_text_keeps_thin_blocks():
    p = lambda tag, n: f"<p>{tag} {'x' * n}</p>"
    for root in ("article", "main", "div"):
        page = f"<body><{root}><h1>Title {'t' * 34}</h1>{p('lead', 145)}<div>{p('body', 495) * 10}</div><section>{p('second', 143) * 2}</section><section>{p('third', 193) * 5}</section></{root}></body>"
        assert [x.split()[0] for x in main_text(page).split("\n")] == ["Title", "lead", *["body"] * 10, *["second"] * 2, *["third"] * 5]
    menu = "<ul><li><a href=a>Home page</a><li><a href=b>Archive</a></ul>"
    assert main_text(f"<div>{menu}<h2><a href=c>Head</a></h2>{p('lead', 9)}<article>{p('body', 300) * 3}{menu}</article></div>").split("\n")[:2] == ["Head", "lead xxxxxxxxx"]
    assert main_text(f"<div>{menu}<article>{p('body', 300) * 3}{menu}</article></div>").count("Archive") == 1


def test_main_text_keeps_layout_elements():
    text = "".join(f"<p>body {k} {'x' * 80}</p>" for k in range(6))
    want = ["Title", *(f"body {k} {'x' * 80}" for k in range(6))]
    noise = '<div class="site-footer">Imprint</div><div class="cookie-notice">Cookies</div><div class="main-nav"><a href=a>Home</a></div><div class="sidebar">Aside</div><div class="ad">Buy</div>'
    for wrapper in ('class="overflow-hidden"', 'class="has-sidebar wide"', 'class="no-sidebar"', 'id="content-sidebar-wrap"', 'class="modal"', 'class="sidebar"', 'class="page-header"'):
        for inner in ("article", "main", "div"):
            assert main_text(f"<body>{noise}<div {wrapper}><{inner}><h1>Title</h1>{text}</{inner}></div></body>").split("\n") == want
    assert main_text(f"<form id=f><input><button>Go</button><label>Mail</label>{noise}<div><h1>Title</h1>{text}</div></form>").split("\n") == want
    for head in ("article-header", "entry-header", "header", "post-header"):
        assert main_text(f"<article><div class='{head}'><h1>Title</h1></div>{text}</article>{noise}").split("\n") == want
    talk = f"<div class='comments'><article class='reply'>{text * 3}</article></div>"
    assert main_text(f"<article><h1>Title</h1>{text}</article>{talk}<form>Your mail <input></form>").split("\n") == want


def test_main_text_goes_by_densities(monkeypatch):
    """Blocks without a name that gives them away are left out by their density, on either side of the article."""
    p = lambda tag, n: f"<p>{tag} {'word ' * n}</p>"
    apart = [
        '<div class="thread"><div><b>Bob</b> I disagree with all of this</div><div><b>Ann</b> So do I</div></div>', '<div class="zz">We use cookies to improve this site. OK</div>', "<div>Copyright 2020 All rights reserved</div>",
        '<div><a href="/">Home</a></div>', "<ul><li><a href=a>One page</a><li><a href=b>Another page</a></ul>", "<p>Share this</p>",
    ]
    pages = []
    for root in ("article", "main", "div"):
        article = f"<{root}>{p('first', 60)}{p('second', 70)}<p>Thin.</p>{p('third', 50)}</{root}>"
        for extra in apart:
            for page in (f"<body>{extra}{article}</body>", f"<body><div>{article}</div>{extra}</body>", f"<div><div>{extra}</div><div>{article}{extra}</div></div>"):
                pages.append(page)
                assert [x.split()[0] for x in main_text(page).split("\n")] == ["first", "second", "Thin.", "third"], page
    two = f"<body><div>{p('a', 60) * 3}</div><div>{p('b', 60) * 2}</div><div>Copyright</div></body>"
    assert [x.split()[0] for x in main_text(two).split("\n")] == ["a"] * 3 + ["b"] * 2
    measure = html_density._measure

    def flat(nodes):
        measure(nodes)
        for n in nodes:
            n.density = n.total = 0.0

    want = [main_text(x) for x in pages]
    monkeypatch.setattr(html_density, "_measure", flat)
    assert all(main_text(x) != w for x, w in zip(pages, want, strict=True))


def test_densities_equal_their_definition():
    """Random trees against sums and densities worked out from each node down, from scratch."""
    rnd = random.Random(11)

    def made(depth):
        tag = rnd.choice(["div", "p", "section", "b", "a", "ul", "li"])
        inner = "".join(made(depth + 1) if rnd.random() < 0.6 and depth < 5 else "x y " * rnd.randint(0, 9) for _ in range(rnd.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    def below(node):
        for k in node.kids:
            if isinstance(k, str):
                yield "chars", sum(not c.isspace() for c in k), None
            else:
                yield "tag", 1, k.tag
                linked = k.tag == "a"
                for kind, n, tag in below(k):
                    yield ("link " + kind if linked and kind == "chars" else kind), n, tag

    def numbers(node):
        rows = list(below(node))
        link = sum(n for kind, n, _ in rows if kind == "link chars")
        return link + sum(n for kind, n, _ in rows if kind == "chars"), sum(kind == "tag" for kind, _, _ in rows), link, sum(kind == "tag" and t == "a" for kind, _, t in rows)

    for _ in range(150):
        body = html_density.parse("<body>" + "".join(made(0) for _ in range(4)) + "</body>").kids[-1]
        body.up = None
        nodes = html_density._walk(body)
        html_density._measure(nodes)
        c, _, lc, _ = numbers(body)
        share, density = lc / max(c, 1), {}
        for node in nodes:
            c, t, lc, lt = numbers(node)
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == (c, t, lc, lt)
            t1 = max(t, 1)
            density[id(node)] = c / t1 * math.log(c / max(lc, 1) * t1 / max(lt, 1) + 1) / max(math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e) + 1), 1e-9) if c else 0.0
            assert math.isclose(node.density, density[id(node)], rel_tol=1e-9, abs_tol=1e-12)

        def total(node):
            return sum((density[id(k)] if k.tag in html_density.BLOCK else total(k)) for k in node.kids if not isinstance(k, str))

        sums = [(total(n), n) for n in nodes if n.tag in html_density.BLOCK or n is body]
        assert math.isclose(max(x for x, _ in sums), total(html_density._densest(nodes)), rel_tol=1e-9, abs_tol=1e-12)


def test_main_text_odd_markup():
    assert main_text("<p title=it's>Hello</p><p>don't</p>") == "Hello\ndon't"
    assert main_text("<article><p>Our market <span class='share'>share</span> rose <a class=related href=x>again</a>.</p></article>") == "Our market share rose again."
    assert main_text('<p class="a"id=b data-x = \'1>2\' hidden>No</p><p CLASS=x/>1 < 2 &lt; 3 <3</p><!--> a --><?php x ?><![CDATA[<raw>]]></ p>end<!-- open') == "1 < 2 < 3 <3\na --><raw>end"
    assert main_text("<p>a<script>if (1 </scripts> 2</script >b</SCRIPT>c<style></style/>d") == "abcd"
    assert main_text("text <a href='unclosed") == "text"
    wide, text = "<div class='content has-sidebar'>", "".join(f"<p>body {k} {'x' * 90}</p>" for k in range(5))
    for opening in (wide, "<div class='post no-comments'>", "<div class='entry form-feed'>", "<div id='page'>"):
        assert main_text(f"{opening}{text}</div>").count("\n") == 4


@pytest.mark.parametrize("piece", ["<a ", "<![CDATA[ ", "<a x='", '<a x="', "<!-", "<script", "</x>", "<div></p>", "<b><hr>", "</script ", "<header class=share>", "<", "<p><b>", "<li><i>"])
def test_main_text_takes_linear_time(piece):
    began = time.process_time()
    main_text("<p>text</p>" + piece * (300_000 // len(piece)))
    assert time.process_time() - began < 6


def test_what_is_remembered_stays_bounded_and_right(monkeypatch):
    monkeypatch.setattr(piece_codec, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(piece_codec, "PAIR_BYTES", 2000)
    small, model, rnd = piece_codec.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(9)
    words = ["".join(rnd.choice("abcdeoistr.") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    for k in range(60):
        text = " ".join(rnd.choices(words, k=40))
        ids = [*model.encode(text), model.eos_id()]
        assert small.round_trip(text) == (" ".join(map(str, ids)), model.decode(ids))
        assert small.seen.size <= 4000 and small.fits.size <= 2000 and len(small.seen.old) <= 4000 // piece_codec.CHUNK_ENTRY
    assert small.seen.old and small.fits.old
    small.forget()
    assert not small.seen and not small.seen.old and small.fits


def test_pieces_equal_library(spark):
    model, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(5)
    letters = "ab \n\t▁ theé😀中文Ω\x00 ingtion<>s/0x9A"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(400)] + ["a" * 200, " " * 40, "日本語" * 200, "</s><0x0A>"]
    for t in texts:
        assert codec(MODEL).encode(t) == model.encode(t)
        assert codec(MODEL).decode(model.encode(t, add_eos=True)) == model.decode(model.encode(t, add_eos=True))
    got = encode_documents(docs(spark, ODD), MODEL, keep_ids=True).collect()
    for r, (i, t) in zip(got, ODD, strict=True):
        ids = model.encode(t or "", add_eos=True)
        assert (r.doc_id, r.n_tokens, list(r.token_ids)) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_url_rules_and_model(spark):
    urls = ["http://A.Example.com/en/71?x", "https://example.com/en/6", "ftp://x.net/de/8", "x://example.net/de/8", "no scheme", None, "http://fresh.org/fr/1#top", "http://notcom/en/", "http://org/es/"]
    urls += ["http://good.net/de/1"] * 20 + ["http://bad.com/en/1"] * 20
    rows = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    rules = [("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False)]
    got = by_id(judge_urls(rows, rules), "page_id")
    assert [got[i].rule for i in range(9)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, None, None, None, "org/es/"]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4, 5, 8)] == ["allow", "block", "allow", "block", "allow", "allow", "block"]
    assert (got[0].host, got[0].path, got[5].host) == ("a.example.com", "/en/71", "")
    assert {r.verdict for r in judge_urls(rows, []).collect()} == {"allow"}
    assert judge_urls(rows.limit(0), rules).count() == 0


def _stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_quality_rules(spark):
    import numpy as np

    table, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    got, rows = by_id(quality_rules(table, labels)), {r.doc_id: r.text for r in table.collect()}
    for i, t in list(rows.items())[:300]:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _stats(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(got[i].kept for i, q in truth.items() if q) / sum(truth.values()) > 0.9
    # half of the labels teach, the other half judge
    more, marks = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    held = quality_rules(more, marks.where("doc_id % 2 = 0")).join(marks.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 20 and n.get((1, False), 0) <= 0.03 * n[0, False] and n[0, False] > 0.7 * (n[0, False] + n.get((0, True), 0)), n
    odd = quality_rules(docs(spark, ODD), labels.limit(0)).collect()
    assert [tuple(r)[1:6] for r in odd] == [_stats(t) for _, t in ODD]
    x = np.array([[i % 10, i % 7] for i in range(300)], float)
    rules = learn(x, x[:, 0] >= 8, ["a", "b"])
    assert len(rules) == 1 and 7 < rules[0][0].threshold <= 8


def _components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(ids[a]), top(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, width, percent):
    rnd = random.Random(1)
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "b a")]
    passage = [f"c{k}" for k in range(60)]
    for g in range(12):
        base = [f"w{g}_{k}" for k in range(rnd.choice([9, 10, 11, 12, 25, 60, 200]))] + passage * (g % 2)
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(3)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows.append((len(rows) + 1, "z " * 30_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, rows), width, percent).collect()}
    assert got == _components(rows, width, percent)
    assert jaccard_components(docs(spark, rows).limit(0)).count() == 0
    again = jaccard_components(docs(spark, [(None, "a b c"), (7, "a b c"), (9, "a b c"), (9, "a b c")])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in again) == [("7", 7), ("9", 7), ("9", 7), ("None", 7)]


def test_jaccard_long_lists(spark, monkeypatch):
    """Near copies around one text, most of them just below the threshold with each other, in lists cut into many chunks."""
    monkeypatch.setattr(jaccard_join, "LISTED", 4)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    rnd = random.Random(9)
    base, rows = [f"w{k}" for k in range(90)], []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            del w[rnd.randrange(len(w))]
        rows.append((len(rows) + 1, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, rows)).collect()}
    assert got == _components(rows, 3, 90) and 5 < len({c for _, c in got.values()}) < 140


def test_jaccard_chunk_pairs(spark, monkeypatch):
    """Chunks return every pair of different components that may link, and few that don't."""
    import numpy as np

    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    rnd = np.random.default_rng(3)
    base = rnd.integers(-(1 << 62), 1 << 62, 199)
    sets = [np.unique(np.concatenate([base[rnd.random(199) > rnd.choice([0.02, 0.05])], rnd.integers(0, 1 << 62, rnd.integers(0, 9))])) for _ in range(120)]
    rows = [(7, k, k % 100, len(s), 0, *map(int, jaccard_join.sketch(s))) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, f"sig bigint, id bigint, component bigint, n bigint, i int, {' bigint, '.join(jaccard_join.SKETCH)} bigint")
    long = members.groupBy("sig").agg(F.count("*").alias("size"))
    got = {(r.a, r.b) for r in jaccard_join._chunk_pairs(members, long, 90, False).collect()}
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(120) for b in range(a) if a % 100 != b % 100}
    want = {(a, b) for (a, b), k in both.items() if 100 * k >= 90 * (len(sets[a]) + len(sets[b]) - k)}
    assert want <= got and len(got) < 2 * len(want) and 100 < len(want) < 5000
    assert all(np.bitwise_count((jaccard_join.sketch(sets[a]) ^ jaccard_join.sketch(sets[b])).view(np.uint64)).sum() <= len(sets[a]) + len(sets[b]) - 2 * k for (a, b), k in both.items())
    near = {(r.a, r.b) for r in jaccard_join._chunk_pairs(members, long, 90, True).collect()}
    assert near <= got and {a for a, _ in want} <= {x for p in near for x in p}


def test_jaccard_chunks_of_one_component(spark, monkeypatch):
    """Chunks that one component fills don't meet each other: one text apart from many near copies costs a row a chunk."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    rows = [(7, k, int(k == 500), 100, 0, *[0] * len(jaccard_join.SKETCH)) for k in range(1000)]
    members = spark.createDataFrame(rows, f"sig bigint, id bigint, component bigint, n bigint, i int, {' bigint, '.join(jaccard_join.SKETCH)} bigint")
    long = members.groupBy("sig").agg(F.count("*").alias("size"))
    assert jaccard_join._chunks(members, long).count() <= 65
    assert {tuple(sorted((r.a, r.b))) for r in jaccard_join._chunk_pairs(members, long, 90, False).collect()} == {(min(k, 500), max(k, 500)) for k in range(1000) if k != 500}


def test_jaccard_pairs_leave_one_list(spark, monkeypatch):
    """Near copies that share thirty lists leave about one of them, and no pair is lost."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    ids, pre = range(60), [[1000 * k + 1 for k in range(30) if (x * 7 + k) % 11] for x in range(60)]
    cut = spark.createDataFrame([(x, pre[x]) for x in ids], "id bigint, pre array<bigint>")
    singles = [(s, x, x, 400, i, *[0] * len(jaccard_join.SKETCH)) for x in ids for i, s in enumerate(pre[x])]
    members = spark.createDataFrame(singles, f"s bigint, id bigint, component bigint, n bigint, i int, {' bigint, '.join(jaccard_join.SKETCH)} bigint")
    members = members.select(F.xxhash64(F.lit(1), "s").alias("sig"), "*").drop("s")
    long = members.groupBy("sig").agg(F.count("*").alias("size"))
    found = [(r.a, r.b) for r in jaccard_join._chunk_pairs(jaccard_join._with_before(members, long, cut), long, 90, False).collect()]
    every = [(r.a, r.b) for r in jaccard_join._chunk_pairs(members, long, 90, False).collect()]
    assert set(found) == set(every) and len(set(found)) == 60 * 59 // 2
    assert len(found) < 1.1 * len(set(found)) and len(every) > 20 * len(set(found))


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "<p>é</p>", None, "", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "long " * 600_000, "long " * 600_000, "a\r\nWARC/1.1\r\nb"]
    rows = spark.createDataFrame([(i + 10, f"http://h/{i} a\r\nb", h, "x") for i, h in enumerate(html)] + [(99, None, "q", "x"), (99, None, "q", "x")], "page_id bigint, url string, html string, digest string")
    got = sorted(tuple(r) for r in archive_round_trip(rows, path=str(tmp_path / "w")).collect() if r.page_id < 99)
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i + 10)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert got == [(i + 10, len((h or "").encode()), sha(h), "response" if first[h or ""] == i + 10 else "revisit", None if first[h or ""] == i + 10 else first[h or ""]) for i, h in enumerate(html)]
    assert sum(r.page_id == 99 for r in archive_round_trip(rows, path=str(tmp_path / "v")).collect()) == 2
    chunks = chunk_table(rows.where("page_id = 15"), 1 << 20).orderBy("chunk").collect()
    assert b"".join(r.data for r in chunks) == html[5].encode() and chunks[-1].so_far == chunks[0].digest and len(chunks) == 3
    assert archive_round_trip(rows.limit(0), path=str(tmp_path / "e")).count() == 0


def test_warc_repeated_chunked_rows(spark, tmp_path):
    big = "".join(f"{k:07d}" for k in range(400_000))
    rows = spark.createDataFrame([(7, "u", big)] * 3 + [(7, "v", big), (None, "u", big), (8, "u", big)], "page_id bigint, url string, html string").coalesce(1)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.payload_digest) for r in archive_round_trip(rows, path=str(tmp_path / "w")).collect())
    digest = base64.b32encode(hashlib.sha1(big.encode()).digest()).decode()
    assert got == [*[("7", len(big), "response", digest)] * 4, ("8", len(big), "revisit", digest), ("None", len(big), "revisit", digest)]


def test_warc_members(spark, tmp_path):
    """A multi-byte character cut at a chunk's edge, and files of one gzip member for each record."""
    html = ["x" + "é" * 700_000, "x" + "é" * 700_000, "short", None]
    rows = spark.createDataFrame([(k, "http://h/ü", h) for k, h in enumerate(html)], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.payload_digest) for r in archive_round_trip(rows, path=str(tmp_path / "w")).collect())
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert got == [(k, "revisit" if k == 1 else "response", len((h or "").encode()), sha(h)) for k, h in enumerate(html)]
    blocks = [r.data for r in read_archives(spark, str(tmp_path / "w")).where("page_id = 0").orderBy("chunk").collect()]
    assert len(blocks) == 2 and b"".join(blocks) == html[0].encode()
    records = []
    for file in (tmp_path / "w").glob("part-*.warc.gz"):
        raw = file.read_bytes()
        while raw:
            member = zlib.decompressobj(31)
            records.append(member.decompress(raw))
            raw = member.unused_data
    assert sum(r.startswith(b"WARC/1.1\r\n") and r.count(b"WARC-Type") == 1 for r in records) == 5 and all(r.startswith(b"WARC") or r == b"" for r in records)


def test_licenses(spark):
    texts = {1: "x Under the MIT License, under the mit license", 2: "See CC BY-NC 4.0", 3: "licensed under the GNU General Public License, version 3.", 4: "the general public license of words", 5: "Apache License, Version 2.0", 6: "under the mit licenses"}
    got = by_id(scan_licenses(docs(spark, [*texts.items(), *((i and i + 10, t) for i, t in ODD)])))
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 1, 5, "mit")
    assert got[2].base_labels == "cc-by-nc" and got[5].base_labels == "apache-2" and got[5].first_word == 0
    assert got[3].labels == "gpl-3" and got[3].base_labels == "" and 0.6 <= got[3].score <= 1
    assert got[4].labels == "" and got[6].n_base == 0 and got[11].n_words == 0 and got[11].score == 0 and got[14].n_words == 30_000


def _aligned(words, templates):
    """Every label whose text is found from some start: key phrases near their places, enough words in order in the span."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + 1 if x == b[j - 1] else 0), initial=0))  # noqa: B023
        return row[-1]

    found = set()
    for label, text, phrases in templates:
        mine, keys = license_index.words_of(text), [license_index.words_of(p) for p in phrases]
        shift = license_index.slack(len(mine))
        for start in range(-shift, len(words)):
            span = words[max(0, start - shift) : max(0, start + len(mine) + shift)]
            near = lambda key: any(words[q : q + len(key)] == key and abs(q - p - start) <= shift for p in range(len(mine)) if mine[p : p + len(key)] == key for q in range(max(0, start + p - shift), start + p + shift + 1))  # noqa: B023, E731
            if all(map(near, keys)) and common(mine, span) >= license_index.MATCHED * len(mine):
                found.add(label)
                break
    return found


def test_licenses_exhaustive(spark):
    rnd, rows = random.Random(3), []
    templates = [t for t in license_index.TEMPLATES if len(t[1]) < 400]
    for label, text, _ in templates:
        for edits in (0, 1, 2, 4):
            w = text.split()
            for _ in range(edits):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = rnd.choice([["of"], ["license"], ["ohne", "und"], []])
            rows.append((len(rows), " ".join([*rnd.choices(["the", "license", "lorem", "mit", "cc"], k=rnd.randint(0, 12)), *w, *rnd.choices(["of", "public", "ipsum"], k=rnd.randint(0, 12))])))
    got = by_id(scan_licenses(docs(spark, rows), templates))
    for i, t in rows:
        words = license_index.words_of(t)
        assert set(filter(None, got[i].labels.split(","))) == _aligned(words, templates) | set(filter(None, got[i].base_labels.split(","))), t
    assert sum(bool(r.labels) for r in got.values()) > len(rows) * 0.6


def test_license_texts(spark):
    """Whole texts, also with other words around and inside; names of licences alone are no text."""
    texts = [(k, f"intro {t[1][: len(t[1]) // 2]} , inserted words {t[1][len(t[1]) // 2 :]} end") for k, t in enumerate(license_index.TEMPLATES)]
    got = by_id(scan_licenses(docs(spark, texts)))
    for k, t in enumerate(license_index.TEMPLATES):
        assert t[0] in got[k].labels.split(",") or len(t[1]) < 150, t[1]
    far = "permission is hereby granted free of charge " + "lorem " * 400 + " to deal in the software without restriction"
    assert scan_licenses(docs(spark, [(1, far), (2, "gnu is a public licence, says the foundation")])).where("labels != ''").count() == 0


def test_toxicity_held_out(spark):
    table, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    rows = score_toxicity(table, labels).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.75 and hits / sum(r.predicted for r in rows) > 0.9
    odd = score_toxicity(docs(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    kept = filter_toxic(docs(spark, ODD), labels.limit(0))
    assert kept.columns == docs(spark, ODD).columns and kept.count() == len(ODD)


def test_toxicity_learns_from_every_label(spark):
    """Labels beyond any sample's size count: the only toxic rows stand behind the first 6,000 ids by hash."""
    ids = spark.range(8_000).withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")))
    rows = [(r.id, r.place > 7_000) for r in ids.collect()]
    table = spark.createDataFrame([(i, "nice words of a day " * 3 + ("foulness" if bad else "kindness")) for i, bad in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(table, labels, shard=2_000).collect()}
    assert sum(got[i] == int(bad) for i, bad in rows) > 0.99 * len(rows)


def test_toxicity_shards_come_whole():
    """However batches are cut, each shard comes whole and in order."""
    import pyarrow as pa

    rows = [(s, d) for s in (3, 1, 7) for d in (5, 2, 9, 4)]
    for size in (1, 3, 5, 12):
        batches = [pa.RecordBatch.from_pylist([{"doc_id": d, "tie": 0, "y": 0, "ids": [d] * d, "shard": s} for s, d in rows[k : k + size]]) for k in range(0, 12, size)]
        got = [(t["shard"].unique().to_pylist(), t["doc_id"].to_pylist(), t["ids"].to_pylist()) for t in toxicity_cnn.shards_of(iter(batches))]
        assert got == [([s], [2, 4, 5, 9], [[d] * d for d in (2, 4, 5, 9)]) for s in (3, 1, 7)]
    assert list(toxicity_cnn.shards_of(iter([]))) == []


def test_toxicity_scores_by_loops():
    import numpy as np

    rnd = random.Random(8)
    words = ["foul", "fouler", "nice", "day", "un", "deux", "x"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(300)] + ["", "foul"]
    buckets, model = toxicity_cnn.WordBuckets(), toxicity_cnn.TextCnn()
    ids = [toxicity_cnn.word_ids(t, buckets) for t in texts]
    model.learn(ids, np.array([float("foul" in t) for t in texts]))
    scores = model.scores(ids, model.tables())
    for t, score in zip(texts, scores, strict=True):
        rows = []
        for w in t.split():
            w = w.encode()
            rows.append([sum(float(model.table[zlib.crc32(p) % toxicity_cnn.BUCKETS][d]) for p in (w, b"4" + w[:4], b"6" + w[:6])) for d in range(toxicity_cnn.DIM)])
        rows += [[0.0] * toxicity_cnn.DIM] * (3 - len(rows))
        logit, k = model.bias + model.shift, 0
        for width, f in model.filters.items():
            for j in range(toxicity_cnn.FILTERS):
                best = max(sum(rows[i + a][d] * float(f[a * toxicity_cnn.DIM + d][j]) for a in range(width) for d in range(toxicity_cnn.DIM)) for i in range(len(rows) - width + 1))
                logit += max(best, 0.0) * float(model.out[k])
                k += 1
        assert abs(1 / (1 + math.exp(-logit)) - score) < 1e-4


def test_quality_scores_by_sums():
    import numpy as np

    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["one", "Two", "3", "four.", "%%", "five!"], k=rnd.randint(0, 40))) for _ in range(200)]
    x = np.array([pair_rank.features(t) for t in texts])
    model = pair_rank.PairRank(x, np.array(["%" not in t for t in texts]), 0.7)
    for row, score in zip(x, model.score(x), strict=True):
        raw = 0.0
        for k, v in enumerate([*row, *(abs(v) ** 0.5 for v in row)]):
            raw += float(model.w[k]) * min(8.0, max(-8.0, (v - float(model.mean[k])) / float(model.std[k])))
        assert abs(1 / (1 + math.exp(-(4 * (raw - model.cut) / model.scale + math.log(0.7 / 0.3)))) - score) < 1e-9


def test_quality_held_out(spark):
    table, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    rows = rank_quality(table, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (r.fold == 2) for r in rank_quality(table, labels).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).collect())
    assert rank_quality(docs(spark, ODD), labels.limit(0)).count() == len(ODD)


def test_quality_learns_from_every_label(spark):
    """Labels beyond any sample's size count: only the rows behind the first 12,000 ids by hash are marked bad."""
    text = lambda bad: "%% " * 30 if bad else "some plain words of a text " * 8
    ids = spark.range(16_000).withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")))
    rows = [(r.id, r.place > 15_000) for r in ids.collect()]
    table = spark.createDataFrame([(i, text(bad)) for i, bad in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(not bad)) for i, bad in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r.predicted for r in rank_quality(table, labels, shard=5_000).collect()}
    assert sum(got[i] == int(not bad) for i, bad in rows) > 0.99 * len(rows)


def test_places_in_order_are_exact(spark):
    rnd = random.Random(3)
    values = sorted([rnd.gauss(0, 1) for _ in range(300)] + [0.5] * 40 + [1e9, -1e9, 1e-12, 2e-12])
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 150, 240, len(values) - 1, values.index(0.5) + 20):
        assert pair_rank.neighbours(rows, "v", k) == (values[k - 1], values[k])


def _leaks(rows, items, percent=80):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for j, it in items:
        iw = words(it)
        k = min(5, len(iw))
        if not iw:
            continue
        grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))  # noqa: B023, E731
        weigh = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
        for i, t in rows:
            w, b = words(t), grams(iw)
            for s in range(max(1, len(w) - len(iw) + 1)):
                a = grams(w[s : s + len(iw)])
                if a and 100 * (sim := weigh(a & b)) >= percent * max(weigh(a), weigh(b)):
                    out[i, j] = max(out.get((i, j), 0), round(sim / max(weigh(a), weigh(b)), 6))
    return out


def test_leaks(spark):
    rnd = random.Random(2)
    vocabulary = [f"word{k}" for k in range(400)]
    items = [(j, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 5, 20, 45])))) for j in range(12)] + [(50, None), (51, "")]
    rows = [(1, None), (2, "")]
    for j, t in items[:12]:
        for edits in (0, 1, 2):
            w = t.split()
            for _ in range(edits):
                w[rnd.randrange(len(w))] = "other"
            rows.append((len(rows) + 1, " ".join([*rnd.choices(vocabulary, k=rnd.randint(0, 30)), *w, *rnd.choices(vocabulary, k=rnd.randint(0, 30))]).upper().replace(" ", ", ")))
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == _leaks(rows, items) and len(got) > 12
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_leaks(docs(spark, rows), none).count() == 0 and find_leaks(docs(spark, rows).limit(0), none.unionByName(spark.createDataFrame(items, "item_id bigint, text string"))).count() == 0


def test_leaks_at_any_offset(spark):
    rnd = random.Random(4)
    vocabulary = [f"{'w' * (k % 9)}{k}" for k in range(300)] + ["long" * 80, "longer" * 90]
    items = [(j, " ".join(rnd.choices(vocabulary[: rnd.choice([12, 302])], k=rnd.choice([20, 40, 60])))) for j in range(10)]
    rows = []
    for _, t in items:
        for _ in range(12):
            w = t.split()
            for _ in range(rnd.randint(1, 3)):
                at, n = rnd.randrange(len(w)), rnd.randint(1, 3)
                w[at:at] = rnd.choices(vocabulary, k=n)
                if rnd.random() < 0.4:
                    del w[(cut := rnd.randrange(len(w))) : cut + n]
            rows.append((len(rows) + 1, " ".join([*rnd.choices(vocabulary, k=rnd.randint(0, 80)), *w, *rnd.choices(vocabulary, k=rnd.randint(0, 30))])))
    found = find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == _leaks(rows, items) and len(found) > 20
    texts, wanted = dict(rows), dict(items)
    for r in found:
        n = len(wanted[r.item_id].split())
        cut = [(1, " ".join(texts[r.doc_id].split()[: r.start + n - 1])), (2, " ".join(texts[r.doc_id].split()[r.start :][:n]))]
        before = _leaks(cut[:1], [(r.item_id, wanted[r.item_id])]).get((1, r.item_id), 0)
        assert _leaks(cut[1:], [(r.item_id, wanted[r.item_id])])[2, r.item_id] == r.similarity > before or r.start == 0
