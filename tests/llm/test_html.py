import html as H
import random
import re

from conftest import SF_SMALL
from evstat.llm import html_text as T
from evstat.llm import queries


def test_small_pages_against_the_article_element(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = queries.op5_line_blocks(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html)[1]
        blocks = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|h2)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<div id="content"><article class="post"><h1>Title &amp; more</h1><p>First  para with <b>bold</b>
and <a href="x">link</a>.</p><div class="ad">Buy now</div><script>var t="</p>";</script>
<p>One.</p><form><input><p>Mail?</p></form><ul><li>item &lt;one&gt;</li><li>item two</li></ul><!-- <p>gone</p> -->
<p>Last&nbsp;para</article></div><aside>Aside text</aside>
<section class="comments"><article><p>I disagree</p></article></section>
<footer>&copy; me</footer></body></html>"""


def test_boilerplate_goes():
    want = ["Title & more", "First para with bold and link.", "One.", "item <one>", "item two", "Last para"]
    assert T.main_text(PAGE) == "\n\n".join(want)
    nested = PAGE.replace("<aside>Aside", '<aside class="x">Aside').replace("</article></div>", '<div id="comments"><article><p>Nested reply</p></article></div></article></div>')
    assert T.main_text(nested) == "\n\n".join(want)


def test_pages_without_article():
    body = "<p>" + "Long paragraph of prose that goes on and on. " * 5 + "</p><p>Short one.</p><p>" + "More prose here, of some length. " * 4 + "</p>"
    page = f"<body><nav><a href=1>a</a></nav><div><a href=1>x</a><br><a href=2>y</a></div><div class=sidebar>side</div>{body}<footer>foot</footer></body>"
    got = T.main_text(page).split("\n\n")
    assert got[0].startswith("Long paragraph") and got[1] == "Short one." and got[2].startswith("More prose") and len(got) == 3


def test_hard_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<html></html>"), (4, "u", "plain text"), (4, "u", "plain text"), (None, "u", "<p>a<p>b &am c"),
            (5, "u", "<article><p>" + "word " * 200_000 + "</p></article>"), (6, "u", "<head><title>x</title><body><p>y</p>"), (7, "u", "a < b <3 <p>c<")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = sorted(((r.page_id or 0, r.text) for r in T.extract(df).collect()), key=lambda x: (x[0], x[1]))
    assert [(i, t) for i, t in got if i != 5] == [(0, "a\n\nb &am c"), (1, ""), (2, ""), (3, ""), (4, "plain text"), (4, "plain text"), (6, "y"),
                                                  (7, "a < b <3\n\nc<")]
    assert len(next(t for i, t in got if i == 5)) == 5 * 200_000 - 1
    assert T.extract(df.limit(0)).count() == 0


def test_linked_headline_and_last_paragraph_stay():
    page = ('<nav><a href=/>Home</a></nav><div><a href=/x>Other</a></div><article><h1><a href=/t>Linked title</a></h1>'
            '<p>Body text.</p><p><a href=/s>Linked end</a></p></article><div>Outside</div>')
    assert T.main_text(page) == "Linked title\n\nBody text.\n\nLinked end"
    assert T.main_text("<article><p><a href=/t>All linked</a></p></article><p>Outside</p>") == "All linked"


def test_short_end_after_an_advert_stays():
    body = "".join(f"<p>{'Long paragraph of prose that goes on. ' * 13}</p>" for _ in range(3))
    end = "A short closing paragraph of some sixty characters, no more."
    page = f"<body><div class=links><a href=1>One</a> | <a href=2>Two</a></div><div class=ad>Buy</div>{body}<div class=ad>Buy now</div><p>{end}</p></body>"
    got = T.main_text(page).split("\n\n")
    assert len(got) == 4 and got[-1] == end
    assert T.main_text(page.replace(end, f"{end}</p><div class=ad>x</div><p><a href=3>Many linked words here</a> and")).split("\n\n") == got


def test_pages_whose_text_is_outside_the_article_elements():
    """Teaser cards as article elements: the higher surge wins, not the element."""
    body = "".join(f"<p>{'Prose of the main text that goes on and on. ' * 8}</p>" for _ in range(4))
    cards = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3><p>More</p></article>" for i in range(3))
    got = T.main_text(f"<body><div>{body}</div><div>{cards}</div></body>").split("\n\n")
    assert len([x for x in got if x.startswith("Prose")]) == 4


def test_given_pages_without_their_markers(spark):
    """The distribution alone finds the article of each given page: same text with the elements renamed."""
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html)
        assert T.main_text(plain) == T.main_text(r.html) != ""


def brute_windows(parts, window=3):
    """Lines as (text, linked); None is a gap.  The level of each line is summed anew; runs of positive levels are judged."""
    lines = [x for p in parts for x in ([p] if p else [("", False)] * window)]
    weight = [0 if linked else len(t) for t, linked in lines]
    level = [sum(weight[max(0, i - 1):i + 2]) for i in range(len(lines))]
    runs, kept = [], []
    for i, x in enumerate(level):
        if x and (not i or not level[i - 1]):
            runs.append([])
        if x:
            runs[-1].append(i)
    for run in runs:
        own, links = sum(weight[i] for i in run), sum(len(lines[i][0]) for i in run if lines[i][1])
        if max(level[i] for i in run) >= 0.25 * max(level) or own >= links:
            kept += [lines[i][0] for i in run if lines[i][0]]
    return "\n\n".join(kept)


def test_against_brute_force_windows():
    rng = random.Random(8)
    for _ in range(300):
        parts = [None if rng.random() < 0.25 else (" ".join(["word"] * rng.choice([1, 2, 5, 30, 80])), rng.random() < 0.4) for _ in range(rng.randint(1, 14))]
        page = "".join("<nav>x</nav>" if p is None else f"<p><a href=1>{p[0]}</a></p>" if p[1] else f"<p>{p[0]}</p>" for p in parts)
        if any(p and not p[1] for p in parts):
            assert T.main_text(page) == brute_windows(parts), page
