import pytest
from clinflow.llm import html

PAGE = """<!DOCTYPE html><html><head><title>Head</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="top"><p>Site</p></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post-17"><header><h1>A &amp; B</h1></header><p>First   one,<br>second &lt;line&gt;.<p><b>Unclosed <i>words<p>5 < 6 and a > b</p>
<div class="ad">Buy!</div><ul><li>item one<li>item <a href=x>two</a></ul><aside>Side</aside><form><input value="q">Ask</form>
<table><tr><td>c1<td>c2<tr><td>c3</table><!-- <p>hidden</p> --></article><section id="comments"><article class="comment">Nice!</article></section>
<footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    text = html.main_text(html.text_blocks(PAGE), {})
    assert text.split("\n") == ["A & B", "First one, second <line>.", "Unclosed words", "5 < 6 and a > b", "item one", "item two", "c1", "c2", "c3"]


@pytest.mark.parametrize("page", ["", "plain words", "<p>", "<", "<a <b", "<script>never closed", "</p></div>", "<!-- open", "<p a='>x", "&#0;&bogus;"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html.main_text(html.text_blocks(page), {}), str)


def test_text_without_containers_is_kept():
    assert html.main_text(html.text_blocks("plain &eacute; words<p>more"), {}) == "plain é words\nmore"


def test_hosts_agree_on_a_path(spark):
    shell = "<html><body><div class='story-{0}'><p>{1}</p></div><div class='extra'><p>{2}</p></div></body></html>"
    rows = [(i, f"https://user@Site.example.com:80/p{i}?q", shell.format(i, f"main {i} " * 20, "extra words " * 2)) for i in range(20)]
    rows.append((20, "http://site.example.com/odd", shell.format(20, "short", "a long extra block " * 30)))  # outvoted by its host
    rows.append((21, "http://other.example.com/odd", shell.format(21, "short", "a long extra block " * 30)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: ("main %d " % i * 20).strip() for i in range(20)} | {20: "short", 21: ("a long extra block " * 30).strip()}
    assert {r.page_id: r.text for r in html.extracted(table).collect()} == want


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.org/", f"<body><div class='a{i % 3}'><p>text {i}</p></div><p>x</p></body>") for i in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    near = sorted(map(tuple, html.extracted(table).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html.extracted(table).collect())) == near


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "no url", ""), (1, "no url", ""), (2, None, "<p>text"), (2**60 + 1, "http://x.y/", "<body>" + "<p>w</p>" * 20_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as paths", "4 as _host")
    found = html.extracted(table).collect()
    assert sorted((repr(r.page_id), r.n_chars) for r in found) == sorted(
        [("None", 0), ("1", 0), ("1", 0), ("2", 4), (repr(2**60 + 1), 39_999)])
    assert html.extracted(table.limit(0)).count() == 0
