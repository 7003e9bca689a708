"""Block reading, alignment, and neighbour differencing."""

import random

import numpy as np
import pytest

from wavelane.llm import html_text as H


def texts(html):
    return [t for _, t, _ in H.blocks(html)]


@pytest.mark.parametrize("html,want", [
    (None, []), ("", []), ("   ", []), ("plain", ["plain"]),
    ("<p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9;<p>two\n  three&nbsp;x", ["a&b <c> ééé", "two three x"]),
    ("<div>x<br>y</div><script>var t='</p>';</script><style>p{}</style><p>z", ["x y", "z"]),
    ("<nav><ul><li>menu</ul></nav><header>top</header><article><header><h1>T</h1></header><p>body</article><footer>f</footer>", ["T", "body"]),
    ("<p><b>bold<br><p>next</p>", ["bold", "next"]),
    ("<div class='comments'><p>hi</div><div id=sideBar>s</div><div role=navigation>n</div><p>kept", ["kept"]),
    ("<form><p>a</form><aside>b</aside><!-- c --><p>d</p>", ["d"]),
    ("<ul><li>one<li>two</ul><table><tr><td>c<td>d</table>", ["one", "two", "c", "d"]),
    ("</p></div>stray<p", ["stray"]), ("<p>a<span>b</span>c</p>", ["abc"]),
    # Wrappers that hold the page, and names that only contain a part's word.
    ('<div class="page has-sidebar"><article><p>body text</article></div><div class="sidebar">s</div>', ["body text"]),
    ('<div id="content" class="layout-sidebar-right"><p>body text</div><div class="ad-slot">buy</div>', ["body text"]),
    ('<div class="sidebar-wrapper"><div class="ad">x</div><article><p>body</article></div>', ["body"]),
    ('<form id="aspnetForm"><nav>n</nav><article><p>body</p></article></form>', ["body"]),
    ('<article><div class="entry-header"><h1>T</h1></div><p id="social">kept</p><p class="promoted-to-general">too</p></article>', ["T", "kept", "too"]),
    ('<article><p>long body of the page</p><div class="related-posts">r</div><div class="share_buttons">s</div></article>', ["long body of the page"]),
    ('<main><p>story</main><div class="comments"><article class="comment"><p>a long comment of a reader</article><p>more and more</div>', ["story"]),
    ('<div><p>story</div><div class="comment-list"><p>a long comment of a reader</p></div>', ["story"]),
    ('<article><p>one two three</article><div class="related"><article><p>teaser</article></div>', ["one two three"]),
    ("<p class='ad'>x</p><p class='newsletter'>y</p><p>z", ["z"]),
    ("<title>t</title><p>a &am b &unknown; c", ["a &am b &unknown; c"]), ("<p hidden>x</p><p>y", ["y"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(14))], np.int64)
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(14))], np.int64)
        mask = H.shared_lines(a, b)
        assert mask.sum() == lcs(a, b)
        rest = iter(b.tolist())
        assert all(x in rest for x in a[mask].tolist())  # in order


def page(k, body, wrap="div"):
    return (f"<html><head><title>t{k}</title></head><body><div>Site name</div><div>Home | News</div><{wrap}><h1>Title {k}</h1>{body}</{wrap}>"
            f"<div>Terms of use</div></body></html>")


def test_neighbours_remove_the_template(spark):
    quote = "<p>A passage that is quoted by several articles.</p>"
    rows = [(k, f"http://site.org/a/{k}", page(k, f"<p>Story number {k}.</p>"), "t") for k in range(6)]
    rows += [(10 + k, f"http://news.org/a/{k}", page(k, f"<p>Own {k}.</p>{quote}", "article"), "t") for k in range(4)]
    rows += [(20, "http://copy.org/1", page(9, "<p>Same.</p>"), "t"), (21, "http://copy.org/2", page(9, "<p>Same.</p>"), "t")]
    rows += [(30, "http://alone.org/", "<p>Only page</p>", "t"), (31, None, None, "t"), (32, "nothing", "", "t"), (33, "http://alone2.org", "<nav>x</nav>", "t")]
    rows += [(40, "http://twice.org/x", "<p>Twice</p>", "t")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in H.extract(pages).collect()]
    assert len(got) == len(rows)
    found = {k: t for k, _, t, _ in got}
    for k in range(6):
        assert found[k] == f"Title {k}\n\nStory number {k}."
    for k in range(4):
        assert found[10 + k] == f"Title {k}\n\nOwn {k}.\n\nA passage that is quoted by several articles."
    assert found[20] == found[21] and "Same." in found[20]
    assert (found[30], found[31], found[32], found[33]) == ("Only page", "", "", "")
    assert [t for k, _, t, _ in got if k == 40] == ["Twice", "Twice"]
    assert all(n == len(t) for _, _, t, n in got)
    assert H.extract(pages.limit(0)).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(k, f"http://h{k % 3}.org/{rng.randrange(40)}", page(k, f"<p>Text {k % 7}.</p>")) for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r["page_id"]: r["text"] for r in H.extract(pages.coalesce(1)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert {r["page_id"]: r["text"] for r in H.extract(pages.repartition(11)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_page():
    html = "<article>" + "".join(f"<p>line {k} &amp; more</p>" for k in range(20_000)) + "</article>"
    found = texts(html)
    assert len(found) == 20_000 and found[-1] == "line 19999 & more"


def test_declared_content_is_compared_too(spark):
    def story(k, inner, outer=""):
        return f"<body><div>Site</div>{outer}<article><h1>Title {k}</h1><div>Share this story</div>{inner}<p>Read our letter.</p></article><div>Terms</div></body>"

    quote = "<p>A quoted passage.</p>"
    rows = [(k, f"http://a.org/{k:02}", story(k, f"<p>Story number {k} is long enough to tell.</p>" * (1 + k % 3) + quote * (k in (4, 5, 6)))) for k in range(14)]
    rows += [(20 + k, f"http://near.org/{k:02}", f"<article><h1>Same title</h1><p>A long passage that all the copies have.</p><p>{k}</p></article>") for k in range(14)]
    rows += [(40 + k, f"http://teaser.org/{k}", f"<div>Site</div><div><p>Body number {k}.</p></div><article><p>Teaser {k}.</p></article>"
              f"<article class='comment'><p>Comment {k}.</p></article>") for k in range(3)]
    rows += [(50, "http://one.org/", "<main class='has-sidebar'><p>Main.</p></main><div>Beside.</div>"), (51, "http://lone.org/", "<article><p>Alone.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for limit in (H.BROADCAST_LINES, 0):  # short lists and joined ones
        found = {r["page_id"]: r["text"].split("\n\n") for r in H.extract(pages, broadcast_lines=limit).collect()}
        assert len(found) == len(rows)
        for k in range(14):
            assert found[k] == [f"Title {k}"] + [f"Story number {k} is long enough to tell."] * (1 + k % 3) + ["A quoted passage."] * (k in (4, 5, 6))
            assert found[20 + k] == ["Same title", "A long passage that all the copies have.", str(k)]
        for k in range(3):
            assert found[40 + k] == [f"Body number {k}.", f"Teaser {k}."]
        assert (found[50], found[51]) == (["Main.", "Beside."], ["Alone."])


def test_blocks_of_places_do_not_show(spark):
    rng = random.Random(5)
    rows = []
    for k in range(700):
        words = [f"<p>line {rng.randrange(3)}</p>" for _ in range(rng.randrange(5))] + [f"<p>own text of page {k} {'x' * rng.randrange(60)}</p>"]
        rng.shuffle(words)
        rows.append((k, f"http://h{min(k // 5, 9)}.org/{k:04}", f"<div>s{rng.randrange(2)}</div><article>{''.join(words)}</article>"))
    found = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    read = [(u.split("/")[2], H.blocks(h)) for _, u, h in rows]
    hashes = {}
    plain = [(host, np.array([hashes.setdefault((c, t), len(hashes)) for c, t, _ in b], np.int64), np.array([d for *_, d in b], bool),
              np.array([len(t) for _, t, _ in b], np.int64)) for host, b in read]
    for k in range(700):
        keep = H.kept_lines(k, plain)
        assert found[k] == "\n\n".join(t for (_, t, _), own in zip(read[k][1], keep) if own)
