import numpy as np
import pytest

from chronofact.llm import html_main_text as hm
from chronofact.llm.html_blocks import DEEPEST, blocks
from layouts import PAGES, block_scores

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var a="</p><p>no";</script>
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more</div><!-- <p>hidden</p> --><div class="ad">Buy now</div>
<article><h1>A title &lt;here&gt;</h1><p><b>First paragraph&nbsp;with   several words,<br>in two lines.<p>Second &eacute; paragraph of the article
 that is long enough to be text.</p><p></p></article><section class="comments"><div class="comment"><p>Great post, I liked it</p></div></section>
<form><label>Your email</label><button>Send</button></form><footer>&copy; 2024 Site &middot; all rights reserved</footer>"""


def test_blocks_decode_and_imply_ends():
    found = blocks(PAGE)
    texts = [b.text for b in found]
    assert texts == ["Site", "Home", "News", "We use cookies & more", "Buy now", "A title <here>",
                     "First paragraph with several words, in two lines.",
                     "Second é paragraph of the article that is long enough to be text.", "Great post, I liked it", "Your email", "Send",
                     "© 2024 Site · all rights reserved"]
    assert found[1].path == ("html", "body", "nav", "ul", "li") == found[2].path and found[1].link_share == 1.0
    assert found[6].path == ("html", "body", "article", "p") == found[7].path
    assert found[3].path[-1] == "div.cookie.notice"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></p>", "<p>a" * 3_000, "<div>" * 5_000 + "x",
                                  "plain & simple", '<p title="a>b">x</p>', "<p title='open>x</p>", "&#0;&#x110000;&bogus;"])
def test_broken_pages_do_not_crash(page):
    assert all(b.text for b in blocks(page))


@pytest.mark.parametrize("page, texts", [
    ("<head><meta charset=utf-8><title>T</title><p>text one<p>two", ["text one", "two"]),
    ("<html><head><title>T</title><style>p{}</style><script>'</head><body>'</script><link rel=x><div>a</div>", ["a"]),
    ("<head><title>T</title>plain text", ["plain text"]),
    ("<head><title>T</head><body><p>a</p>", ["a"]), ("<head><title>T<body><svg><title>t</title></svg><p>a</p>", ["a"]),
    ("<head><noscript><style>x</style></noscript><script>x</head><body><p>a</p>", ["a"]), ("<head></head><p>a", ["a"]), ("<head><script>x", [])])
def test_head_ends_where_its_tags_are_left_out(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_ends_of_very_deep_elements_leave_their_ancestors_open():
    page = "<article><div class=a>" + "<div>" * 400 + "deep" + "</div>" * 400 + "<p>near</p></div><p>last</p></article><p>out"
    found = {b.text: b.path for b in blocks(page)}
    assert len(found["deep"]) == DEEPEST and found["near"] == ("article", "div.a", "p")
    assert found["last"] == ("article", "p") and found["out"] == ("p",)


@pytest.mark.parametrize("page, text", [
    ("<p>&am<b>p;</b>", "&amp;"), ("<p>a &amp<b>b</b>", "a &b"), ("<p>&lt;b&gt; &eacute;<i>&eacute;</i>", "<b> éé"), ("<p>&#x4<!-- -->1;", "1;")])
def test_references_end_with_their_run_of_text(page, text):
    assert [b.text for b in blocks(page)][0] == text


def test_one_article_is_not_overruled():
    keeps_nothing = hm.Network.fresh()
    keeps_nothing.values["c"] = np.array([-1e6], np.float32)
    for name in ("code", "comments as articles", "teasers"):
        html, want = PAGES[name]
        page = blocks(html)
        assert [b.text for b, y in zip(page, hm.label([page], keeps_nothing, hm.Reader())[0], strict=True) if y] == want
    two = blocks("<article><p>one</p></article><article><p>two</p></article>")
    assert hm.only_article(two) is None and hm.only_article(blocks("<p>x")) is None and hm.only_article([]) is None
    assert [b.article for b in blocks("<p>a<article>b<article>c</article></article>d<article>e")] == [0, 1, 1, 0, 2]


def test_lists_and_tables_imply_ends():
    page = "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<table><tr><td>f<td>g<tr><th>h</table>i<td>j<tr><td>k</table><dl><dt>l<dd>m<dt>n"
    assert {b.text: "/".join(b.path) for b in blocks(page)} == {
        "a": "ul/li", "b": "ul/li/ul/li", "c": "ul/li/ul/li", "d": "ul/li", "e": "table/tr/td", "f": "table/tr/td/table/tr/td",
        "g": "table/tr/td/table/tr/td", "h": "table/tr/td/table/tr/th", "i": "table/tr/td", "j": "table/tr/td", "k": "table/tr/td",
        "l": "dl/dt", "m": "dl/dd", "n": "dl/dt"}


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = hm.Network.fresh()
    net.values = {k: v.astype(np.float64) for k, v in net.values.items()}
    x, lengths = rng.normal(size=(3, 5, hm.WIDTH)), np.array([5, 2, 4])
    y = rng.integers(0, 2, (3, 5)).astype(float)
    mask = np.arange(5)[None, :] < lengths[:, None]

    def loss():
        z = net.logits(x.astype(np.float32), lengths).astype(np.float64)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    grads = net.gradients(x.astype(np.float32), lengths, y)
    for name in ("fx", "fh", "fb", "bx", "bh", "bb", "o", "c"):
        flat = net.values[name].reshape(-1)
        for k in rng.integers(0, len(flat), 3):
            old, step = flat[k], 1e-2
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_padding_changes_nothing():
    rng = np.random.default_rng(1)
    net, pages = hm.Network.fresh(), [rng.normal(size=(n, hm.WIDTH)).astype(np.float32) for n in (3, 9)]
    together = net.logits(*hm.padded(pages))
    for row, page in zip(together, pages, strict=True):
        assert np.allclose(row[:len(page)], net.logits(*hm.padded([page]))[0], atol=1e-5)


@pytest.fixture(scope="module")
def given_pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_main_text_of_given_and_unseen_layouts(spark, given_pages):
    net = hm.train(given_pages)
    got = {r["page_id"]: r["text"] for r in hm.extract(given_pages, net=net).collect()}
    right = [got[r["page_id"]] == "\n".join(b.text for b in blocks(r["html"]) if "article" in b.path) for r in given_pages.collect()]
    assert np.mean(right) > 0.99
    rng, reader = np.random.default_rng(1234), hm.Reader()
    parsed = {k: blocks(h) for k, (h, _) in PAGES.items()}
    kept = hm.label(list(parsed.values()), net, reader)
    precision, recall = block_scores({k: [b.text for b, y in zip(parsed[k], keep, strict=True) if y] for k, keep in zip(parsed, kept, strict=True)})
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)
    words = sorted({w for t in got.values() for w in t.split()})
    pages = [hm.invented(rng, words) for _ in range(150)]
    found = hm.label([p for p, _ in pages], net, reader)
    assert np.mean(np.concatenate([a == (y > 0) for a, (_, y) in zip(found, pages, strict=True)])) > 0.96
    odd = [(1, None, "u"), (2, "", "u"), (None, PAGE, "u"), (2, "<p>" + "word " * 100_000, None)]
    rows = hm.extract(spark.createDataFrame(odd, "page_id long, html string, text string"), net=net).collect()
    assert len(rows) == 4 and rows[0]["text"] == rows[1]["text"] == ""
    assert "Home" not in rows[2]["text"] and "Second é paragraph" in rows[2]["text"]
    assert hm.extract(given_pages.limit(0)).count() == 0
