import html
import random
import time

import pytest

from cladespark.llm.html_region import Weights, _chosen, best_region, extract, learn, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/a>b">menu one</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy this now</div>
<article><h1>Head &eacute; line</h1><p><b>First<br>para&nbsp;graph
 here with words.<p>Sec<i>ond</i> one &lt;tag&gt; &#65;.</p><aside>side words here</aside><div class="ad">inner ad</div><p>last words of it</p></article>
<section class="comments"><p>reader says that this is a very long comment with many words in it</p></section><footer>&copy; foot words</footer></body></html>"""
WANT = "Head é line First para graph here with words. Second one <tag> A. last words of it"


def test_region_against_all_ranges():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]
        first, last = best_region(scores)
        assert sum(scores[first:last]) == max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])


def test_page_with_and_without_learned_weights(spark):
    assert main_text(PAGE, Weights()) == WANT
    odd = [None, "", "<", "<p>", "plain words only", "<p>open <b>never closed", "&amp;" * 9, "<div " + "x" * 100000, "<p>" + "long words " * 50000]
    rows = [(k, f"u{k}", PAGE, 1) for k in range(30)] + [(100 + k, None, p, 2) for k, p in enumerate(odd)] + [(100, None, None, 2), (None, None, PAGE, 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(frame).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[k].text == WANT and by[k].n_chars == len(WANT) for k in range(30)) and by[None].text == WANT
    assert [by[100 + k].text for k in (0, 1, 3)] == ["", "", ""]
    assert by[104].text == "plain words only" and by[105].text == "open never closed" and by[108].text == ("long words " * 50000).strip()
    weights = learn(frame)
    assert weights.word["article"] > 0 and all(w < 0 for w in weights.tag.values()) and "section.comments" in weights.no_content


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Pages:
    """Pages with the text they were made from: no parser is needed to know it."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.known = 0

    def words(self, least=1):
        self.known += 1
        return " ".join(f"{self.rng.choice(['w', 'é', '&', '<'])}{self.known}x{k}" for k in range(self.rng.randint(least, 9)))

    def run(self, least=1):
        """Running text, some of it in links and other marks; markup and text."""
        out, text = [], []
        for _ in range(self.rng.randint(1, 3)):
            own = self.words(least)
            tag = self.rng.choice(["", "a href='/x>y'", "b", 'span class="price share" title=it\'s', "em"])
            out.append(f"<{tag}>{html.escape(own)}</{tag.split()[0]}>" if tag else html.escape(own).replace(" ", self.rng.choice([" ", "\n\t", "&nbsp;"])))
            text.append(own)
        return " ".join(out), " ".join(text)

    def block(self, depth=0):
        kind = self.rng.choice(["p", "p", "h2", "list", "table", "div", "class", "out"])
        if kind in ("p", "h2"):
            own, text = self.run()
            return f"<{kind}>{own}</{kind}>", text
        if kind == "list":
            rows = [self.run() for _ in range(self.rng.randint(1, 4))]
            return "<ul>" + "".join(f"<li>{r}" for r, _ in rows) + "</ul>", " ".join(t for _, t in rows)
        if kind == "table":
            rows = [self.run() for _ in range(self.rng.randint(1, 3))]
            return "<table>" + "".join(f"<tr><td>{r}</td></tr>" for r, _ in rows) + "</table>", " ".join(t for _, t in rows)
        if kind == "out":
            return self.boilerplate(), ""
        rows = [self.block(depth + 1) for _ in range(self.rng.randint(1, 3))] if depth < 3 else [self.run()]
        name = 'div class="share-price note"' if kind == "class" else "div"
        return f"<{name}>" + "".join(r for r, _ in rows) + "</div>", " ".join(t for _, t in rows if t)

    def boilerplate(self):
        own, _ = self.run()
        kind = self.rng.choice(["nav", "aside", "form", "footer", 'div class="ad"', "section id=comments", "script", "style"])
        return f"<{kind}>{own}</{kind.split()[0]}>" if kind in ("script", "style") else f"<{kind}><ul><li><a href=/>{own}</a></li></ul><p>{own}</p></{kind.split()[0]}>"

    def page(self, named):
        ends = [self.words(6) for _ in range(2)]  # without a named article, an end of few words may be lost
        ends = [(f"<p>{html.escape(own)}</p>", own) for own in ends]
        rows = [ends[0], *(self.block() for _ in range(self.rng.randint(1, 6))), ends[1]]
        around = [" ".join(self.boilerplate() for _ in range(self.rng.randint(0, 3))) for _ in range(2)]
        content = "".join(r for r, _ in rows)
        content = f"<article>{content}</article>" if named else f"<main><div class=body>{content}</div></main>"
        beside = f"<div class=beside>{self.words()}</div>" if named else ""
        return f"<!DOCTYPE html><html><head><title>{self.words()}</title></head><body>{around[0]}<!-- {self.words()} -->{beside}{content}{around[1]}</body></html>", " ".join(t for _, t in rows if t)


@pytest.mark.parametrize("learned", [False, True])
def test_against_pages_of_known_text(spark, learned):
    made = Pages(11)
    pages = [made.page(named=k % 2 == 0) for k in range(300)]
    plain = [(k, f"<body><nav><ul><li><a>menu {k}</a></li></ul></nav><div class=ad>buy it</div><article><h1>t</h1><p>words of it</p></article><footer>foot</footer></body>") for k in range(400)]
    weights = learn(spark.createDataFrame(plain, "page_id long, html string")) if learned else Weights()
    for page, text in pages:
        assert main_text(page, weights) == " ".join(text.split())


@pytest.mark.parametrize("part", ["<a ", "<", "<div>", "</", "<svg>", "<script>", "<!--", '<p title="', "<a b='", "<a =", "<p/ ", "&amp"])
def test_malformed_pages_take_linear_time(part):
    begun = time.time()
    main_text(part * (1_000_000 // len(part)) + "</p>" * 1000, Weights())
    assert time.time() - begun < 20  # seconds here; anything quadratic takes hours


def test_sample_of_one_page_that_fills_the_table(spark):
    frame = spark.createDataFrame([(1, PAGE)] * 3000, "page_id long, html string").repartition(8)
    assert [r.page for r in _chosen(frame, 5, "html", "page_id").collect()] == [PAGE]
    assert learn(frame, sample=5).tag["p"] < 0


@pytest.mark.parametrize("page", ["<article><p>a b c</p></article>", "<body><p>a b c</body>", "<ARTICLE>a\n b<br/>c</ARTICLE>"])
def test_small_pages(page):
    assert main_text(page, Weights()) == "a b c"
