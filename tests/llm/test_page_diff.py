import random

import pytest

from loomspark.llm import page_diff as pd

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad box">Buy</div>
<main><article><h1>Title &amp; more</h1><p>One <b>bold</b>&nbsp;word<br>next &lt;tag&gt;
 line.<p>Two &unknown; &#233;<aside>Side</aside></p><form><p>Mail</p></form><div id="cookie-notice">Cookies</div>
<section class="comments"><p>Reader says</p></section><ul><li>x<li>y</ul></article></main>
<footer>&copy; me</footer></body></html>"""


def text(source):
    page = pd.blocks(source)
    return "\n".join(page.marked or page.open)


def test_marked_article():
    assert text(PAGE) == "Title & more\nOne bold word next <tag> line.\nTwo &unknown; é\nx\ny"


def test_broken_markup():
    assert text("<article><p>a < b <i>c</p><p title=\"x>y\">d</article><p>out") == "a < b c\nd"
    assert text("plain text") == "plain text"
    assert text("<p>a<script>never closed") == "a"
    assert text("<" * 5000 + "<a href='" * 3000) is not None


def length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("limit", [1 << 30, 6])
def test_shared_lines_are_a_longest_common_subsequence(limit):
    random.seed(3)
    for _ in range(600):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 10))] for _ in range(2))
        kept = pd.shared_lines(a, b, limit)
        rest = iter(b)
        assert kept == sorted(set(kept)) and len(kept) == length(a, b) and all(a[k] in rest for k in kept)


def plain_lcs(a, b):
    """Places in ``a`` of a longest common subsequence, by the full table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_every_page_against_plain_differencing(spark):
    """Marked pages give what was put into the article; of the others each is compared with its neighbours, page by page."""
    rng = random.Random(5)
    rows, want, unmarked = [], {}, []
    for k in range(240):
        host, marked = f"h{rng.randint(0, 4)}.org", rng.random() < 0.4
        top, end = [f"menu {j} of {host}" for j in range(rng.randint(1, 3))], [f"legal {host}", f"bottom {rng.randint(0, 1)}"]
        body = [f"line {rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 5))]
        url = f"http://{host}/{rng.choice('abc')}/{k:03d}"
        wrap = lambda lines: "".join(f"<div> {x.replace(' ', '  ')}</div>" for x in lines)
        if marked:
            rows.append((k, url, f"<html><body><nav>{wrap(top)}</nav>{wrap(end)}<article>{wrap(body)}<p>last &amp; least</p></article></body></html>"))
            want[k] = "\n".join([*body, "last & least"])
        else:
            rows.append((k, url, f"<html><body>{wrap(top + body + end)}<script>x</script></body></html>"))
            unmarked.append(((host, url.partition(host)[2], k), top + body + end))
    unmarked.sort()
    for at, ((host, _, k), lines) in enumerate(unmarked):
        sides = []
        for step in (-1, 1):
            near, i = [], at + step
            while 0 <= i < len(unmarked) and unmarked[i][0][0] == host and len(near) < 2:
                near += [unmarked[i][1]] * (unmarked[i][1] != lines)
                i += step
            sides.append(near)
        others = [sides[0][0], sides[1][0]] if all(sides) else sides[0] or sides[1]
        gone = set.intersection(*(plain_lcs(lines, x) for x in others)) if others else set()
        want[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pd.extract(df, 1).collect()}
    assert got == want
    assert sum("menu" not in want[k[2]] for k, _ in unmarked) > 30  # differencing has decided something


def test_a_very_long_page(spark):
    body = "".join(f"<p>paragraph {k}</p>" for k in range(30_000))
    rows = [(1, "http://h.org/a", f"<article>{body}</article>"), (2, "http://h.org/b", f"<div>top</div>{body}"), (3, "http://h.org/c", "<div>top</div><p>short</p>")]
    got = {r.page_id: r.text for r in pd.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 1).collect()}
    assert got[1].count("\n") == 29_999 and got[2] == got[1] and got[3] == "short"


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_unmarked_pages_lose_what_their_nearest_page_has_too(spark, parts):
    page = lambda body: f"<html><body><div>Our site</div>{body}<div>Legal text</div></body></html>"
    rows = [(k, f"http://H{k % 3}.org/news/{k:02d}?q", page(f"<p>story {k}</p><p>of host {k % 3}</p>"), "x") for k in range(12)]
    rows += [(50, "http://alone.org/", page("<p>only</p>"), "x"), (51, None, None, "x"), (52, "no url", PAGE, "x"), (52, "no url", PAGE, "x"), (None, "http://h0.org/", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pd.extract(df, parts).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert all(by_id[k] == f"story {k}" for k in range(1, 12))
    assert by_id[50] == "Our site\nonly\nLegal text" and by_id[51] == "" and by_id[52].startswith("Title")
    assert all(r.n_chars == len(r.text) for r in got)
    assert pd.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_copies_of_unmarked_pages_keep_their_article(spark, parts):
    page = lambda body: f"<html><body><div>Our site</div>{body}<div>Legal text</div></body></html>"
    story = "<p>story</p><p>second line</p>"
    rows = [(1, "http://h.org/a", page("<p>first</p>"))] + [(2, "http://h.org/b", page(story))] * 3
    rows += [(3, "http://h.org/c", page(story)), (4, "http://h.org/d", page(story + "<p>late</p>")), (5, "http://h.org/e", page("<p>fifth</p>"))]
    got = pd.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), parts).collect()
    want = ["first"] + ["story\nsecond line"] * 4 + ["story\nsecond line\nlate", "fifth"]
    if parts == 1:
        assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == want
    assert len(got) == 7 and all("story" in r.text for r in got if r.page_id in (2, 3, 4))


@pytest.mark.parametrize("parts", [1, 4])
def test_pages_that_mark_an_article_are_differenced_too(spark, parts):
    """What neighbours share is told of marked pages as well; the check brings back what of it is the article's."""
    page = lambda k: f"<p>Our site</p><article><p>story {k}</p><p>said by all</p></article><p>extra {k}</p>"
    rows = [(k, f"http://h.org/{k:02d}", page(k)) for k in range(9)]
    rows += [(20 + k, f"http://h.org/{k:02d}x", f"<p>Our site</p><p>plain {k}</p><nav>no</nav>") for k in range(9)]
    got = {r.page_id: r for r in pd.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), parts).collect()}
    assert all(got[k].text == f"story {k}\nsaid by all" for k in range(9))
    assert all((got[k].n_lines, got[k].n_template, got[k].n_restored) == (4, 2, 1) for k in range(9))
    assert all((got[20 + k].text, got[20 + k].n_lines, got[20 + k].n_template, got[20 + k].n_restored) == (f"plain {k}", 2, 1, 0) for k in range(9))
