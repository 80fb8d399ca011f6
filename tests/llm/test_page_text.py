from __future__ import annotations

import random

from capturelake.llm.page_text import extract, induce, main_text, parse, tree_match, unpacked


def page(seed, body, host="a.example.com", article=True):
    draw = random.Random(seed)
    nav = "".join(f'<li><a href="/{i}">menu{draw.randrange(99)}</a></li>' for i in range(draw.randint(2, 6)))
    tag = "article" if article else "div"
    return (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul>{nav}</ul></nav><!-- <p>no</p> --><div class=\"ad\">buy {seed}</div><header>site</header>"
            f"<{tag}>{body}<div class='comments'><p>reader {seed}</p></div></{tag}><p>All rights reserved everywhere.</p>"
            f"<aside>side</aside><form><p>name</p></form><footer>&copy; {host}</footer></body></html>")


CASES = [
    ("<h1>Head &amp; more</h1><p>One <b>two</b>\n three.<p>Four&nbsp;x<br>y", "Head & more\n\nOne two three.\n\nFour x y"),
    ("<p>a</p><ul><li>b<li>c</ul><table><tr><td>d<td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<p>AT&T &#x41;&#66; &lt;tag&gt; 1 < 2</p>", "AT&T AB <tag> 1 < 2"),
    ("<P CLASS='x'>caps</P><script>if (a<b) {}</script><noscript>no</noscript><p title=\"a>b\">quoted", "caps\n\nquoted"),
    ("", ""),
]


def test_cases(spark):
    rows = [(i, f"https://a.example.com/{i}", page(i, body)) for i, (body, _) in enumerate(CASES)]
    rows += [(100 + i, f"http://b.example.com/{i}", page(i, f"<p>text {i}</p>", "b", article=False)) for i in range(9)]
    rows += [(200, None, page(1, "<p>no host</p>")), (201, "nonsense", None), (202, "http://a.example.com", ""), (None, None, "plain"),
             (203, "http://a.example.com", "<p>loose <i>end"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS host", "2 AS wrapper")
    out = extract(df).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    for i, (_, want) in enumerate(CASES):
        assert got[i].text == want and got[i].url == f"https://a.example.com/{i}"
    for i in range(9):
        assert got[100 + i].text == f"text {i}"  # the constant line is template: the pages have no article
    assert (got[200].text, got[201].text, got[202].text, got[203].text, got[None].text) == ("no host", "", "", "loose end", "plain")
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract(df.limit(0)).count() == 0


def test_text_shared_by_copies_stays_content():
    pages = [page(i, "<p>the same article</p>" if i < 3 else f"<p>article {i}</p>") for i in range(12)]
    template = {}
    wrapper = unpacked(induce(pages), template)
    assert main_text(pages[0], wrapper, template) == "the same article"
    assert main_text(pages[5], wrapper, template) == "article 5"


def test_copies_with_other_surroundings_keep_their_text(spark):
    hosts = {"a.example.com": (10, 12, True), "b.example.com": (4, 5, True), "c.example.com": (50, 60, False)}
    rows, want = [], {}
    for host, (copies, n, article) in hosts.items():
        for i in range(n):
            text = "the same article" if i < copies else f"article {i}"
            want[len(rows)] = text
            rows.append((len(rows), f"http://{host}/{i}", page(i, f"<p>{text}</p>", host, article)))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_fixed_lines_of_every_layout_are_template(spark):
    def rare(i, wrapped):
        own = f"<div class='{'alpha' if wrapped else 'beta'}'><p>story {i}</p><p>line of {'alpha' if wrapped else 'beta'}</p></div>"
        return f"<html><body><div class='{'left' if wrapped else 'right'}'>{own}</div><p>notice {'one' if wrapped else 'two'}</p></body></html>"

    rows = [(i, "http://a.example.com/", page(i, f"<p>text {i}</p>" + "<p>x</p><ul><li>y</li></ul>" * 3, article=False)) for i in range(200)]
    rows += [(1000 + i, "http://a.example.com/", rare(i, True)) for i in range(6)]
    rows += [(2000 + i, "http://a.example.com/", rare(i, False)) for i in range(6)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k + i] for k in (1000, 2000) for i in range(6)] == [f"story {i}" for i in range(6)] * 2


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "bottom" + "</div>" * 5000
    assert main_text(deep, None, {}) == "bottom"
    long = "<article>" + "".join(f"<p>p{i}</p>" for i in range(20_000)) + "</article>"
    assert main_text(long, None, {}).count("\n\n") == 19_999
    assert main_text('<p a="unclosed>text</p>', None, {}) in ("", "text")


def test_matching_counts_nodes():
    a, b = parse("<div><p>x</p><ul><li>1</li><li>2</li></ul></div>"), parse("<div><ul><li>1</li></ul><p>y</p></div>")
    assert tree_match(a, a) == 6
    assert tree_match(a, b) == 4
