"""Page extraction on hand-made and given pages, conversations against brute force."""

import html
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from mediacat.llm import chats, html_main

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="ad">Buy now</div><{tag}><h1>Title {n}</h1><p>First &lt;b&gt; &copy; line {n}\n  with   space&nbsp;here.<p><b>Second {n}<br>broken.</b><form><input value="x">Send</form><pre>a\n {n}</pre></p></{close}>
<aside>Side</aside><div id="comments"><article class="comment"><p>I disagree</p></article></div><footer>&copy; all</footer>"""


def text_of(n):
    return f"Title {n}\nFirst <b> © line {n} with space here.\nSecond {n} broken.\na {n}"


@pytest.mark.parametrize("broadcast_bytes", [html_main.BROADCAST_BYTES, -1])
def test_main_text(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(html_main, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(i, f"http://one.example/{i}", PAGE.format(n=i, tag="article", close="article")) for i in range(4)]
    rows += [(10 + i, f"http://two.example/{i}", PAGE.format(n=i, tag='div class="content"', close="div")) for i in range(4)]
    rows += [(20, None, None), (21, "http://three.example/", ""), (22, "http://three.example/x", "plain &amp; text"), (23, "bad url", "<nav>only menu"), (0, rows[0][1], rows[0][2]), (None, "http://one.example/n", PAGE.format(n=99, tag="main", close="main"))]
    rows += [(30, "http://four.example", "<p>" + "long words " * 20_000)]
    df = spark.createDataFrame([(*x, "clash", "h") for x in rows], "page_id long, url string, html string, text string, host string")
    got = defaultdict(list)
    for r in html_main.extract_main(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert [got[i] for i in (1, 2, 3)] == [[text_of(i)] for i in (1, 2, 3)] and got[0] == [text_of(0)] * 2
    assert [got[10 + i] for i in range(4)] == [[text_of(i)] for i in range(4)]
    assert got[20] == got[21] == got[23] == [""] and got[22] == ["plain & text"] and got[None] == [text_of(99)]
    assert got[30] == [("long words " * 20_000).strip()]
    assert html_main.extract_main(df.limit(0)).count() == 0


def test_elements_left_out(spark):
    page = """<body><nav><ul><li>Menu</li></ul><article class="post"><h1>Head</h1><p class="ad">Advert</p><p>Kept <button>Click</button>text</p>
<div hidden>Hidden</div><div class="share-links">Share</div><p>Last &amp; least</p></article><aside><article><p>Teaser</p></article></aside>
<section class="discussion"><article><p>Reader</p></article></section></body>"""
    df = spark.createDataFrame([(1, "http://a.example/1", page)], "page_id long, url string, html string")
    assert html_main.extract_main(df).first().text == "Head\nKept text\nLast & least"


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<body><div><button>Menu</div><article><p>One</p><p>Two</p></article></body>", ["One", "Two"]),
        ("<body><button>Menu<article><p>One</p><p>Two</p></article><button>End</button></body>", ["One", "Two"]),
        ("<body><article><p>One <button>Share</p><p>Two</p></article><p>After", ["One", "Two", "After"]),
        ("<body><article><p>One <button>Share</p><p>Two <button>Like</button> more</p></article>", ["One", "Two more"]),
        ("<body><article><p>One</p><object data='x'>No<p>Two</p></article><object>No</object><p>After</p>", ["One", "Two", "After"]),
        ("<body><p>One <svg><svg><text>a</text></svg><text>b</text></svg> more</p><object><object>c</object><p>d</p></object><p>Two", ["One more", "Two"]),
        ("<body><noscript><div><article>No</article></div></noscript><video controls><p>No</video><svg/><p>One", ["One"]),
        ("<body><p>One<script>var a = '<p>No</p>'</script></p><p>Two<script>never closed <p>No</p>", ["One", "Two"]),
        ("<body><button>a" + "<object>b" * 30_000 + "<p>One</p>" * 2, ["One", "One"]),
    ],
)
def test_elements_never_closed(page, blocks):
    assert [x.text for x in html_main.read_page(page) if not x.out] == blocks


def test_templates_are_deduced(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='top'>Same words</div><div class='c{i % 1}'><p>Text {i} " + "more " * i + "</p></div></body>") for i in range(6)]
    found = html_main.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert found.main == ">body>div.c0" and len(found.own_text) == 1


def test_templates_of_uneven_hosts(spark):
    """A null page, an empty one, one of another layout, a banner in nine of ten pages, one that stands twice; two layouts; a repeated slot."""
    strip = "<div class='strip'><p>Special week at our house</p></div>"
    page = "<body>{strip}<div class='top'>Welcome to us</div><div class='content'><h2>Head {n}</h2><div class='part'><p>Text {n} goes on and on and on for a long while.</p></div><div class='part'><p>End {n} of the long text of this page.</p></div></div><p>Come again</p><p>Come again</p></body>"
    rows = [(i, f"http://h.example/{i}", page.format(n=i, strip=strip if i else "")) for i in range(10)]
    rows += [(20, "http://h.example/null", None), (21, "http://h.example/empty", ""), (22, "http://h.example/off", "<body><table><tr><td>Not found here</td></tr></table></body>")]
    rows += [(30 + i, f"http://two.example/{i}", f"<body><div class='{'a' if i % 2 else 'b'}'><p>Unlike text {i} that goes on for long.</p></div><div class='x'>Odd {i}</div></body>") for i in range(6)]
    rows += [(40 + i, f"http://cols.example/{i}", f"<body><div class='col'>Left text {i} that goes on.</div><div class='col'>Right text {i} that goes on.</div><span>Odd {i}</span></body>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in html_main.templates(df).collect()}
    assert found["h.example"].slots == [">body>div.content"] and len(found["h.example"].own_text) == 3
    assert sorted(found["two.example"].slots) == [">body>div.a", ">body>div.b"] and found["cols.example"].slots == [">body>div.col"]
    got = {r.page_id: r.text for r in html_main.extract_main(df).collect()}
    assert [got[i] for i in range(10)] == [f"Head {i}\nText {i} goes on and on and on for a long while.\nEnd {i} of the long text of this page." for i in range(10)]
    assert got[20] == got[21] == "" and got[22] == "Not found here"
    assert [got[30 + i] for i in range(6)] == [f"Unlike text {i} that goes on for long." for i in range(6)]
    assert [got[40 + i] for i in range(4)] == [f"Left text {i} that goes on.\nRight text {i} that goes on." for i in range(4)]
    banner = [(i, f"http://flat.example/{i}", "<body>" + ("<p>Special week</p>" if i else "") + f"<p>Text {i} of the page.</p></body>") for i in range(10)]
    flat = html_main.extract_main(spark.createDataFrame([*banner, (10, "http://flat.example/x", None)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in flat} == {**{i: f"Text {i} of the page." for i in range(10)}, 10: ""}


@pytest.mark.parametrize(
    ("body", "blocks"),
    [
        ('<main><div class="review"><p>One</p></div></main>', ["One"]),
        ('<article><section class="related-work"><p>One</p></section><p>Two</p></article>', ["One", "Two"]),
        ('<article><div class="search-results"><p>One</p></div><p>Two</p></article>', ["One", "Two"]),
        ('<article><div id="social-history"><p>One</p></div><p>Two</p></article>', ["One", "Two"]),
        ('<article><div class="side-by-side"><p>One</p><p>Two</p></div></article>', ["One", "Two"]),
        ('<article><p class="notice">One</p><p>Two</p></article>', ["One", "Two"]),
        ('<header>Site</header><article><header><h1>One</h1><p>Lead</p></header><p>Two</p></article>', ["One", "Lead", "Two"]),
        ('<article><div class="comments"><p>One</p></div></article>', ["One"]),
        ('<main class="page comments-list"><p>One</p></main>', ["One"]),
        ('<div class="content"><div class="cookie-notice">No</div><div class="ad-slot-2">No</div><div class="adobe">One</div><div id="advice">Two</div></div>', ["One", "Two"]),
        ('<article><p>One</p><div class="reader-comments">No</div><ul class="share-buttons"><li>No</ul><form>No</form><nav>No</nav><aside>No</aside><footer>No</footer></article>', ["One"]),
        ('<article class="teaser"><p>No</p></article><article class="post related-work"><p>One</p></article><article class="comment-12"><p>No</p></article>', ["One"]),
    ],
)
def test_names_count_as_a_whole(body, blocks):
    assert html_main.main_text(f"<html><body>{body}</body></html>", [], frozenset()) == "\n".join(blocks)


def test_layouts_of_a_host_against_what_was_put_in(spark):
    """Pages made from known blocks in three layouts, mixed on one host and each on its own, with menus, banners, sidebars and comments."""
    import random

    rnd = random.Random(9)
    words = "river stone light house under going seven where found green their".split()

    def sentence(n=None):
        return " ".join(rnd.choices(words, k=n or rnd.randint(6, 30))).capitalize() + "."

    inner = ["<p>{}</p>", "<p class='advice'>{}</p>", "<div class='related-work'><p>{}</p></div>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]
    banner, menu, foot = sentence(8), "".join(f"<li><a href='#'>{w}</a></li>" for w in words[:5]), sentence(6)
    shells = [
        "<article class='post'><header><h1>{title}</h1></header>{body}<div class='share-links'>Share this</div></article><section class='comments'><p>{noise}</p></section>",
        "<div class='story'><h1>{title}</h1>{body}</div><div class='sidebar'><p>{noise}</p></div>",
        "<table class='grid'><tr><td class='left'>{menu}</td><td class='text'><h1>{title}</h1>{body}</td></tr></table><div class='extra'><span>{noise}</span></div>",
    ]
    rows, truth = [], {}
    for i in range(90):
        layout = i % 3
        site = "mixed" if i < 45 else f"only{layout}"
        title, body = sentence(6), [sentence() for _ in range(rnd.randint(3, 9))]
        shell = shells[layout].format(title=title, body="".join(rnd.choice(inner).format(x) for x in body), noise=sentence(5), menu=f"<ul>{menu}</ul>")
        rows.append((i, f"http://{site}.example/{i}", f"<html><body><div class='strip'>{banner}</div><nav><ul>{menu}</ul></nav>{shell}<footer>{foot}</footer></body></html>"))
        truth[i] = "\n".join([title, *body])
    rnd.shuffle(rows)
    got = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i in truth if got[i] != truth[i]]
    assert not wrong, (wrong, got[wrong[0]], truth[wrong[0]])


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_main.extract_main(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in blocks if x)


def test_chats(spark):
    def conversation(i, *turns):
        return [(i, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(turns)]

    rows = conversation(1, "hi") + conversation(2, "hi", "hello") + conversation(3, "hi", "hello", "more") + conversation(4, "hi", "other") + conversation(5, "hi", "hello", "more") + conversation(6, None, "x")
    rows += [(None, 0, "user", "no id"), (7, None, None, None), (8, 1, "user", "b"), (8, 1, "user", "b"), (9, 1, "user", "b")] + conversation(10, *["turn"] * 150)
    df = spark.createDataFrame([(*x, 7, "p") for x in rows], "conv_id long, turn long, role string, text string, place int, part string")
    out = defaultdict(dict)
    for r in chats.collapse(df).collect():
        out[r.conv_id][r.part] = r
    assert set(out) == {3, 4, 6, None, 7, 8, 10}
    assert out[3][0].n_equal == 2 and out[3][0].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nmore\n<|end|>\n"
    assert out[8][0].n_turns == 2 and out[7][0].rendered == "<||>\n\n<|end|>\n"
    assert sorted(out[10]) == [0, 1, 2] and sum(r.rendered.count("<|end|>") for r in out[10].values()) == 150
    assert chats.collapse(df.limit(0)).count() == 0


def test_hot_conversation(spark):
    """A conversation with most of all turns, and the rows without an id: places and hashes equal plain windows', in small buckets."""
    from pyspark.sql import Window

    id_ = F.col("id")
    rows = spark.range(12_000).select(
        F.when(id_ % 3 == 0, F.lit(None)).when(id_ % 3 == 1, 5).otherwise(id_ % 400 + 10).alias("conv_id"), F.when(id_ % 7 > 0, id_ % 900).alias("turn"),
        F.when(id_ % 2 == 0, "user").alias("role"), F.concat(F.repeat(F.lit("long start "), 8), (id_ % 1500).cast("string")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    plain = chats._turns(rows).withColumn("place", F.row_number().over(order).cast("long"))
    salted = lambda salt: F.sum(F.xxhash64(F.lit(salt), "place", "role", "text").bitwiseAND(F.lit(chats.HALF))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    want = plain.withColumns({"a": salted(1), "b": salted(2)})
    got = chats.prefixes(rows)
    assert sorted(got.select(sorted(got.columns)).collect(), key=str) == sorted(want.select(sorted(got.columns)).collect(), key=str)
