"""URL rules against brute force and SQL; HTML extraction against hand-written pages and a brute-force search for repeated runs."""

import random

import pytest

from hiremill.llm import html_runs, queries, url_rules
from tests.check import compare, connect

URLS = [None, "", "nothing", "http://", "http://A.Com", "http://a.com/", "https://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://m.www.example.com/en/q", "http://example.com/en",
        "http://example.com/english/", "http://x.net/es/", "http://x.net/ES/", "http://net/fr/a", "http://notexample.com/en/a", "ftp://é.com/en/", "http://a.com?x=/en/", "http://a.com#/", "x://y://z.com/en/",
        "http://example.com//en/", "http://.com/", "http://a..com/x"]


def brute(url, rules):
    host, path = url_rules.split_url(url)
    best = None
    for verdict, rule in rules:
        h, p = url_rules.split_rule(rule)
        if (host == h or host.endswith("." + h) or not h) and path.startswith(p):
            key = (h.count(".") + 1 if h else 0, len(p))
            best = max(best or (-1, -1, "", ""), (*key, rule, verdict)) if best is None or key != best[:2] else best
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_rules_match_brute_force(spark):
    rng = random.Random(6)
    labels, segments = ["a", "b", "com", "net"], ["en", "e", "x", ""]
    rules = dict((".".join(rng.choices(labels, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(segments, k=rng.randint(0, 2))) + rng.choice(["", "/"]), rng.choice(["allow", "block"])) for _ in range(40))
    rules = [(v, r) for r, v in rules.items()] + queries.URL_RULES
    urls = URLS + ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices(segments, k=rng.randint(0, 3))) for _ in range(400)]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for part in (10_000, 7):
        got = url_rules.judge_urls(table, rules, rules_per_part=part)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert [(r.host, r.path, r.rule, r.verdict) for r in got.orderBy("page_id").collect()] == [brute(u, rules) for u in urls]
    with pytest.raises(ValueError):
        url_rules.judge_urls(table, [("maybe", "a.com/")])
    assert url_rules.judge_urls(table.limit(0), rules).count() == 0 and url_rules.judge_urls(table, []).where("rule IS NULL AND verdict = 'allow'").count() == len(urls)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    _, err = compare(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLES[name])
    assert err is None, err


def text_of(source):
    return "\n".join(t for k, t in html_runs.blocks_of(source) if k == html_runs.CONTENT)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
      <article class="post"><header><h1>A &amp; B &lt;c&gt;</h1></header><p>One <b>bold</b>
      two&nbsp;three<br>four<p>Five<div class="ad">Buy</div><div class="share-bar">Share</div><script>var x = "</p>";</script><ul><li>x<li>y</ul>
      <section id="comments"><p>First!</p></section><table><tr><td>1<td>2</table><form><input><label>Mail</label></form><aside>Side</aside></article>
      <div class="cookie-notice">We use cookies</div><footer>End</footer></body></html>"""
    assert text_of(page) == "A & B <c>\nOne bold two three four\nFive\nx\ny\n1\n2"
    assert text_of("<article><p>cut off &am") == "cut off &am" and text_of("<main>a<!-- b") == "a" and text_of("<article>1 < 2 &#x41;&#66;</article>") == "1 < 2 AB"
    assert text_of("<article>" + "<p>x" * 5000) == "\n".join(["x"] * 5000)


def test_repeated_runs_go_and_unique_runs_stay(spark):
    menu, tail = "our shop has many good things for you", "all rights are kept by the owner of this site"
    rows = [(i, f"http://a.com/{i}", f"<div>{menu}</div><p>story number {i} about subject {i * 7} alone</p><p>note {i}: {tail}</p>") for i in range(5)]
    rows += [(10, "http://b.com/", f"<div>{menu}</div>"), (11, None, None), (12, None, ""), (12, None, ""), (13, "http://c.com", "<p>six words that stand here twice</p>"), (13, "http://c.com", "<p>six words that stand here twice</p>")]
    rows += [(20 + i, "http://d.com", f"<article><p>{menu}</p><p>{i}</p></article><div>{tail}</div>") for i in range(2)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_runs.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id, r.text, r.n_chars) for r in got.collect())
    want = [(i, f"story number {i} about subject {i * 7} alone\nnote {i}:") for i in range(5)]
    want += [(10, menu), (11, ""), (12, ""), (12, ""), (13, "six words that stand here twice"), (13, "six words that stand here twice"), (20, f"{menu}\n0"), (21, f"{menu}\n1")]
    assert found == sorted((i, t, len(t)) for i, t in want)
    assert html_runs.extract(pages.limit(0)).count() == 0
    three = {r.page_id: r.text for r in html_runs.extract(pages, page_count=6).collect()}
    assert three[1].startswith(menu)


def test_articles_of_the_pages_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_runs.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:b|br)>", " " if "br" in b else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].split() == " ".join(b for b in blocks if b).split()


def test_names_of_chrome_are_whole_and_quotes_belong_to_attributes():
    from hiremill.llm.html_runs import CHROME, CONTENT, blocks_of

    for name in ("notice-period", "login-guide", "article-share-price", "commentary", "shared"):
        assert blocks_of(f'<article><div class="{name}">Kept text.</div></article>') == [(CONTENT, "Kept text.")], name
    for name in ("ad", "ad-slot", "cookie-notice", "share-buttons", "reader comments", "newsletter_box", "x related"):
        assert blocks_of(f'<article><div class="{name}">Gone.</div></article>') == [(CHROME, "Gone.")], name
    assert blocks_of("<article><p title=don't>Hello world</p><p data-x=\"a > b\" id='c > d'>Second</p></article>") == [(CONTENT, "Hello world"), (CONTENT, "Second")]
