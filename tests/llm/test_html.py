import time

import pytest

from shelfledger.llm import html as H

PAGES = "page_id long, url string, html string, host string, text string"


def page(body, host="a.example", k=1):
    return (k, f"https://{host}/x", f"<html><head><title>t</title></head><body>{body}</body></html>", "clash", "")


def extract(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}


LONG = "A sentence of the article that is long enough to be taken for running text by the score. " * 2


def test_blocks_and_white_space():
    found = H.blocks("<p>a &amp;\n b<br>c<p>d&nbsp;e <b>f</b>g</p><ul><li>x<li>y</ul>tail &lt;z&gt;")
    assert [t for _, t, _, _ in found] == ["a & b c", "d e fg", "x", "y", "tail <z>"]


def test_scripts_comments_and_broken_markup():
    html = "<p>one<!-- <p>no --><script>var t='</p><p>no';</script><style>p{}</style> two</p></div></section>three<p unclosed"
    assert [t for _, t, _, _ in H.blocks(html)] == ["one two", "three<p unclosed"]


def test_everything_but_the_article_goes(spark):
    body = (
        '<nav><ul><li><a href="/">menu</a></li></ul></nav><header>top</header><div class="ad">buy</div>'
        f"<main><article><h1>Title</h1><div class='body-7'><p>{LONG}</p><p>End.</p></div>"
        '<div class="share">share it</div><form>mail <input></form></article>'
        '<section class="comments"><p>reader words that go on and on and on and on and on and on and on</p></section></main>'
        '<aside>side</aside><div class="cookie-notice">we use cookies</div><footer>foot</footer>'
    )
    assert extract(spark, [page(body)])[1] == "\n".join(["Title", LONG.strip(), "End."])


def test_the_host_outvotes_a_page(spark):
    """A page whose longest text stands elsewhere follows the other pages of its host."""
    rows = [page(f"<div class='story-{k}'><p>{LONG}</p></div><div class='box'>x</div>", k=k) for k in range(8)]
    odd = page(f"<div class='story-99'><p>Short story.</p></div><div class='box'>{LONG * 3}</div>", k=50)
    lone = page(f"<div class='box'>{LONG}</div>", host="b.example", k=60)
    found = extract(spark, [*rows, odd, lone])
    assert found[50] == "Short story." and found[60] == LONG.strip() and found[0] == LONG.strip()


def test_text_outside_the_leading_path_stays(spark):
    """A short lead, seven equal sections and a minority template; only what the host repeats goes."""
    legal = "<div class='legal'>The same words stand on every page.</div>"
    names = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = [page(f"<div class='lead'>Lead {k}</div><div class='story'><p>{LONG}{k}</p></div>{legal}", k=k) for k in range(8)]
    rows += [page(f"<div class='lead'>Lead 20</div><div class='other'><p>{LONG}20</p></div>{legal}", k=20)]
    rows += [page(f"<div class='lead'>Copy</div><div class='twin'>{LONG}21</div>{legal}", k=k) for k in (21, 22)]
    rows += [page("".join(f"<div class='{n}'><p>{LONG}{n} {k}</p></div>" for n in names), host="c.example", k=k) for k in (30, 31)]
    found = extract(spark, rows)
    assert all(found[k] == f"Lead {k}\n{LONG}{k}" for k in (*range(8), 20))
    assert found[21] == found[22] == f"Copy\n{LONG}21"
    assert all(found[k] == "\n".join(f"{LONG}{n} {k}" for n in names) for k in (30, 31))


def test_edge_cases(spark):
    rows = [(1, "https://a/x", None, "", ""), (2, None, "", "", ""), (3, "nonsense", "plain text", "", ""), (None, "http://A.b:80/", "<p>x", "", "")]
    rows += [(5, "https://a/x", "<p>" + "word " * 50_000, "", "")] * 2 + [(6, "https://a/y", "<nav>menu</nav>", "", "")]
    found = H.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    text = {r.page_id: r.text for r in found}
    assert text[1] == "" and text[2] == "" and text[3] == "plain text" and text[None] == "x" and text[6] == ""
    assert text[5] == " ".join(["word"] * 50_000)
    assert all(r.n_chars == len(r.text) for r in found)
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_given_pages(spark, folder):
    import re
    from html import unescape

    from shelfledger.llm.queries import op5_html_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in op5_html_text(spark, folder).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(" ".join(x.split()) for x in parts if x.strip())


@pytest.mark.parametrize(
    ("body", "box"),
    [
        ("has-sidebar", "entry"), ("no-sidebar single-post", "text"), ("comments-open", "box"), ("home search", "x"),
        ("js-hidden", "story"), ("", "entry tags-news"), ("", "article share-enabled"), ("", "content-with-side"), ("", "main-content no-ad"),
    ],
)
def test_template_classes_do_not_hide_the_article(body, box):
    """A page of its own, then two of a host that agree."""
    html = (
        f"<body class='{body}'><nav>menu</nav><div class='{box}'><h1>Title</h1><p>{LONG}</p><div class='share'>share</div></div>"
        "<div class='sidebar'><p>other things to read</p></div><div class='comments'><p>I like it</p></div></body>"
    )
    assert H.main_text(html, None) == f"Title\n{LONG.strip()}"
    winner = max(H.path_scores(H.blocks(html)).items(), key=lambda kv: kv[1])[0]
    assert H.main_text(html, [winner], []) == f"Title\n{LONG.strip()}"


def test_votes_change_the_text(spark):
    """A container with a word against it is kept where the host's pages vote for it, and left out elsewhere."""
    lead = "<div class='intro'>Lead {k}</div>"
    rows = [page(lead.format(k=k) + f"<div class='widget-text'><p>{LONG}{k}</p></div>", k=k) for k in range(6)]
    rows += [page(f"<div class='news'><p>{LONG * 12}{k}</p></div><div class='widget-text'><p>{LONG}{k}</p></div>", host="b.example", k=k) for k in range(10, 16)]
    found = extract(spark, rows)
    assert all(found[k] == f"Lead {k}\n{LONG}{k}" for k in range(6))
    assert all(found[k] == f"{LONG * 12}{k}" for k in range(10, 16))


def brute_votes(pages):
    """{host: {path: summed share}} by plain loops."""
    total = {}
    for host, html in pages:
        own = H.path_scores(H.blocks(html))
        for path, score in own.items():
            host_of = total.setdefault(host, {})
            host_of[path] = host_of.get(path, 0.0) + score / sum(own.values())
    return total


def test_votes_equal_plain_sums(spark):
    bodies = [f"<div class='a{k % 3}'><p>{LONG * (k % 4 + 1)}</p></div><section><p>{'x ' * k}y</p></section>" for k in range(30)]
    rows = [page(body, host=f"h{k % 2}.example", k=k) for k, body in enumerate(bodies)]
    voted = H.votes(spark.createDataFrame(rows, PAGES)).collect()
    expected = brute_votes([(f"h{k % 2}.example", row[2]) for k, row in enumerate(rows)])
    assert {(r.host, r.path): pytest.approx(r.score) for r in voted} == {
        (h, p): s for h, paths in expected.items() for p, s in paths.items()
    }


HOSTILE = [
    "< a <b '" * 130_000, "<a '" * 250_000, "<div>" * 200_000 + "x", "<div class=ad>" * 70_000 + "x" + "</p>" * 70_000,
    "<p>a" * 250_000, "<!--" * 250_000, "<a b=\"" * 150_000, "&" * 1_000_000, "</x>" * 250_000, "<b>" * 300_000,
]


@pytest.mark.parametrize("html", HOSTILE, ids=range(len(HOSTILE)))
def test_hostile_markup_is_linear(html):
    began = time.time()
    found = H.blocks(html)
    H.candidate_paths(found)
    H.main_text(html, None)
    assert time.time() - began < 30
