from collections import Counter

import brute
import pytest

from sparkloom.llm import html_extract

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, host string, text string, token long"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 0) for i, u, h in rows], SCHEMA)


def text_of(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in html_extract.extract(table(spark, rows), **options).collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p>First <b>bold</b>
 text&nbsp;here.<p>Second<br>line &lt;x&gt;</p><div class="ad">Buy</div><form>Your mail <input></form><ul><li>one<li>two</ul>
<section class="comments"><article><p>Nice post</p></article></section></article><aside>More</aside><!-- <p>hidden</p> -->
<footer>&copy; me</footer></body></html>"""


def test_roles(spark):
    want = "A & B\n\nFirst bold text here.\n\nSecond line <x>\n\none\n\ntwo"
    got = text_of(spark, [(1, "http://a.example/1", PAGE), (2, None, PAGE), (3, "x", None), (4, "x", ""), (5, "", "plain < text")])
    assert got == {1: want, 2: want, 3: "", 4: "", 5: "plain < text"}


@pytest.mark.parametrize("small", [20_000, 0])
def test_template_text_is_deduced(spark, small):
    page = lambda i: f"<html><body><div><p>Visit our shop today</p><div><p>Story {i} with words</p><p>More of {i}</p></div><p>All rights kept</p></div></body></html>"
    rows = [(i, f"http://Host.example/{i}", page(i)) for i in range(12)] + [(50, "http://other.example/1", page(50))]
    got = text_of(spark, rows, small=small)
    assert all(got[i] == f"Story {i} with words\n\nMore of {i}" for i in range(12))
    assert got[50].startswith("Visit our shop today")


def test_marks_on_frames(spark):
    inner = '<div class="side-bar"><p>More</p></div><div class="comments"><article><p>Nice</p></article></div>'
    rows = [
        (1, "u", f'<body><div class="page with sidebar"><article><p>One</p></article>{inner}</div></body>'),
        (2, "u", '<body><div class="search-page notice"><p>Two</p><p>Three</p></div><div class="comments"><p>Nice</p></div></body>'),
        (3, "u", f'<body><div class="content"><p>Four</p></div>{inner}</body>'),
        (4, "u", '<body><header><h1>Site</h1></header><div id="top-bar">Log in</div><main><header><h1>Five</h1></header><p>Six</p><div class="share">Tell</div></main></body>'),
    ]
    assert text_of(spark, rows) == {1: "One", 2: "Two\n\nThree", 3: "Four", 4: "Five\n\nSix"}


def test_all_articles_and_loose_text_stay(spark):
    rows = [
        (1, "u", "<article><h1>One</h1><p>first</p></article><article><p>second</p></article><p>loose</p>"),
        (2, "u", "<main><h1>Title</h1><p>lead</p><article>body</article></main><div><a href=x>Home</a> <a href=y>About</a></div>"),
        (3, "u", "<article><p><a href=x>a linked paragraph</a></p><ul><li><a href=y>reference</a></li></ul></article>"),
    ]
    assert text_of(spark, rows) == {1: "One\n\nfirst\n\nsecond\n\nloose", 2: "Title\n\nlead\n\nbody", 3: "a linked paragraph\n\nreference"}


def test_the_region_is_the_slot_of_the_articles(spark):
    """Nothing is marked here: the frame's texts differ on every page, so only the region tells them apart."""
    page = lambda i: f"<html><body><div><ul><li>w{i}</li><li>v{i}</li></ul></div><div class=x><div class=y><h2>Story {i}</h2><p>{'long text ' * 9}{i}</p></div></div><div class=z>end {i}</div></body></html>"
    got = text_of(spark, [(i, f"http://h.example/{i}", page(i)) for i in range(9)])
    assert got == {i: f"Story {i}\n\n{'long text ' * 9}{i}" for i in range(9)}
    assert text_of(spark, [(1, "http://h.example/1", page(1))])[1].startswith("w1\n\nv1")


def brute_template(pages, least=8, share=0.5):
    """Fixed texts of each host: texts with the same counts on all distinct pages as some element, from whole vectors."""
    out = {}
    for host in {html_extract.host_of(u) for u, _ in pages}:
        distinct = {}
        for u, h in pages:
            if html_extract.host_of(u) == host:
                found, paths = html_extract.blocks(h or "")
                distinct[tuple(sorted(paths.items())), tuple(sorted(Counter((b.path, b.text) for b in found).items()))] = None
        vectors = {}
        for i, (paths, texts) in enumerate(distinct):
            for token, c in [(("e", p), c) for p, c in paths] + [(("t", *t), c) for t, c in texts]:
                vectors.setdefault(token, []).append((i, c))
        often = {t: tuple(v) for t, v in vectors.items() if len(v) >= max(least, share * len(distinct))}
        elements = {v for t, v in often.items() if t[0] == "e"}
        out[host] = {html_extract._hash(*t[1:]) for t, v in often.items() if t[0] == "t" and v in elements}
    return {h: t for h, t in out.items() if t}


def test_classes_match_brute_force(spark):
    page = lambda i: f"<html><body><p>Shop</p><div>{'<p>Twice</p>' * 2}<b>x</b></div><div class=a{i % 2}><p>Half {i % 2}</p><p>Story {i}</p></div><p>All rights</p></body></html>"
    pages = [(f"http://h{i % 2}.example/{i}", page(i // 2 if i % 2 else i)) for i in range(60)] + [(None, page(i)) for i in range(5)] + [("http://c.example", page(1))] * 9
    got = {r["t_host"]: set(r["template"]) for r in html_extract.templates(table(spark, [(i, u, h) for i, (u, h) in enumerate(pages)])).collect() if r["template"]}
    want = brute_template(pages)
    assert got == want and len(want) == 2
    real = [(r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {r["t_host"]: set(r["template"]) for r in html_extract.templates(spark.read.parquet(f"{SF}/pages.parquet")).collect() if r["template"]}
    assert got == brute_template(real)


def test_templates_alone_find_the_articles(spark):
    """An ablation: without roles, templates leave the same text on every page of a host with enough pages."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    text = lambda **o: {r["page_id"]: r["text"] for r in html_extract.extract(pages, **o).collect()}
    whole, alone, nothing = text(), text(roles=False), text(roles=False, min_pages=10**9)
    assert alone == whole and all(nothing[i] != whole[i] for i in whole)


def test_broken_and_long_pages(spark):
    rows = [(1, "u", "<div><p>a" * 3000), (2, "u", "<p class='x>a</p>" * 200), (3, "u", "<" * 20000), (4, "u", "<p>" + "word " * 200_000)]
    got = text_of(spark, rows)
    assert got[1].count("a") == 3000 and len(got[4]) == 5 * 200_000 - 1 and got[3] == "<" * 20000


def test_repeated_rows_and_empty_table(spark):
    got = html_extract.extract(table(spark, [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, "u", "<p>b</p>")])).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == Counter([(1, "a", 1), (1, "a", 1), (None, "b", 1)])
    assert html_extract.extract(table(spark, [])).collect() == []


@pytest.mark.parametrize("copies", [8, 9, 1000])
def test_copies_are_no_template(spark, copies):
    page = "<html><body><article><h1>Title</h1><p>The only story</p></article></body></html>"
    other = lambda i: f"<html><body><article><h1>Other {i}</h1><p>Text of {i}</p></article></body></html>"
    rows = [(i, f"http://copies.example/{i}", page) for i in range(copies)]
    rows += [(10_000 + i, f"http://mixed.example/{i}", page if i < copies else other(i)) for i in range(2 * copies)]
    rows += [(20_000, "http://repeated.example/", page)] * copies + [(30_000, None, page)] * copies
    got = html_extract.extract(table(spark, rows)).collect()
    assert len(got) == 5 * copies
    for r in got:
        i = r["page_id"] - 10_000
        assert r["text"] == (f"Other {i}\n\nText of {i}" if copies <= i < 2 * copies else "Title\n\nThe only story")


def test_templates_beside_copies_are_deduced(spark):
    page = lambda i: f"<html><body><div><p>Visit our shop today</p><div><p>Story {i}</p></div></div></body></html>"
    rows = [(i, "http://a.example/", page(min(i, 11))) for i in range(40)]
    assert text_of(spark, rows) == {i: f"Story {min(i, 11)}" for i in range(40)}


@pytest.mark.parametrize(
    "mark",
    ['<svg class="i"/>', '<svg class="i" />', '<svg class="i">', '<object data="x">', "<canvas>", "<video src=x>", "<audio>", "<noscript>", "<template>", "<svg><svg>no</svg><text>no</text></svg>", "<object>no<object>no</object>no</object>"],
)
@pytest.mark.parametrize("later", ["", "<svg><text>no</text></svg><object>no</object><canvas>no</canvas><video>no</video>"])
def test_text_behind_raw_elements_stays(mark, later):
    page = f"<article><p>A</p>{mark}<p>B</p>{later}<p>C</p></article>"
    assert [b.text for b in html_extract.main_blocks(html_extract.blocks(page)[0])] == ["A", "B", "C"]


def test_math_is_text_and_scripts_are_not():
    page = "<article><p>where <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds<math/>.</p><p>B</p><script>var a = '<p>no</p>'</article>"
    assert [b.text for b in html_extract.main_blocks(html_extract.blocks(page)[0])] == ["where x = 1 2 holds .", "B"]


def test_whole_table_keeps_articles_only(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        text = got[r["page_id"]]["text"]
        assert text and "©" not in text and "track(" not in text and got[r["page_id"]]["n_chars"] == len(text)
    assert len(got) == pages.count()


def test_pipeline_against_plain_steps(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), now.schema)
        kept.append(now.collect())
    passed = {r["doc_id"] for r in docs.collect() if not brute.rules(r["text"])["base_failed"]}
    first = {r["doc_id"] for r in kept[0]}
    assert first <= passed and len(first) > 0.95 * len(passed)
    classes = brute.classes([(r["doc_id"], r["text"]) for r in kept[0]], 5, 80)
    assert {r["doc_id"] for r in kept[1]} == {i for i, (n, c) in classes.items() if i == c}
    assert all(not brute.base_spans(r["text"]) for r in kept[2]) and len(kept[2]) == len(kept[1])
    assert {r["doc_id"] for r in kept[3]} <= {r["doc_id"] for r in kept[2]}
    assert max(Counter(r["doc_id"] for r in kept[3]).values()) <= 2
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r["doc_id"] for r in kept[3])
