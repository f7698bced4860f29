import math
import random
import time

import pytest

from lociweave.llm import html_extract as h

ARTICLE = "<p>This is an article, with points; and words. It goes on, and on.</p>" * 5


def _brute_scores(blocks):
    """The scores written out: sums per path, a kernel cut at the ends, a mean per path."""
    mean = lambda f, p: sum(f(b) for b in blocks if b.path == p) / sum(b.path == p for b in blocks)
    chars = [math.log(1 + mean(lambda b: max(0, len(b.text) - b.linked), x.path)) for x in blocks]
    marks = [math.log(2 + mean(lambda b: 0 if b.linked >= len(b.text) else sum(c in ".,;:!?…。，、；：！？¿¡" for c in b.text), x.path)) for x in blocks]

    def smooth(v, i):
        weights = {d: w for d, w in zip((-2, -1, 0, 1, 2), (0.06, 0.24, 0.40, 0.24, 0.06), strict=True) if 0 <= i + d < len(v)}
        return sum(w * v[i + d] for d, w in weights.items()) / sum(weights.values())

    fused = [smooth(chars, i) * smooth(marks, i) for i in range(len(blocks))]
    return {p: sum(f for f, b in zip(fused, blocks, strict=True) if b.path == p) / sum(b.path == p for b in blocks) for p in {b.path for b in blocks}}


def test_scores_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        source = ""
        for _ in range(rng.randint(1, 40)):
            words = " ".join(rng.choice(["word", "word, ", "end. ", "¿qué?", "<a href=x>link here</a>"]) for _ in range(rng.randint(1, 30)))
            source += rng.choice(["<p>%s</p>", "<div><p>%s</p></div>", "<ul><li>%s</li></ul>", "<h2>%s</h2>", "%s<br>", "<section>%s"]) % words
        blocks = h.parse(source).blocks
        got, want = h.path_scores(blocks), _brute_scores(blocks)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_paths_are_shared_by_blocks_under_the_same_names():
    page = h.parse("<div><p>a</p><p>b</p></div><div><p>c</p><h2>d</h2></div>")
    one, two, three, head = (b.path for b in page.blocks)
    assert one == two == three != head and len({b.element for b in page.blocks}) == 4


@pytest.mark.parametrize(
    ("body", "blocks"),
    [
        ('<div class="layout no-sidebar"><article>%s</article></div>', 5),
        ('<div class="post has-comments">%s</div>', 5),
        ('<article><div class="search-result">%s</div></article>', 5),
        ("<form>%s</form>", 5),
        ('<div><p title="the hidden valley">A hidden valley, it is.</p>%s</div>', 6),
        ("<div><p hidden>Not seen, at all.</p>%s<p style='display: none'>Nor this.</p><p>a <span hidden>b</span> c.</p></div>", 6),
        ("<article>%s<ul><li><a href=x>Read more links here</a></li><li><a href=y>And here</a></li></ul></article>", 5),
        ("<div><ul><li><a href=x>Read more links here</a></li><li><a href=y>And here</a></li></ul></div><div>%s</div>", 5),
        ("<table><tr><td><a href=x>menu</a></td><td>%s</td></tr></table>", 5),
        ("%s", 5),
        ("<article>%s</article><footer>&copy; someone. All rights, reserved; of course, and more of this.</footer>", 5),
        ("<article><h1>Tiny.</h1><p>Tiny.</p></article><footer>&copy; somebody &middot; a long line, with points; and words. Far longer than the article is.</footer>", 2),
        ("<p>A short article, and no more.</p><footer>Copyright 2020, all rights reserved; of course, and more of this, and this.</footer>", 1),
        ("<div><p>A short article, and no more.</p></div><div class='site-footer'><p>Copyright 2020, all rights reserved; of course, and more of this.</p></div>", 1),
        ('<article>%s<div class="ad-slot"><p>Buy this, and that; now, or never. It is cheap, and good.</p></div></article>', 5),
        ('<article>%s<div class="user-feedback"><p>I, too, think so. It is true, and well said; thank you.</p></div></article>', 5),
        ('<p>An article of one line, and no more.</p><div class="cookie-notice"><p>We use cookies, as all do; go on, or leave. You may, of course, refuse.</p></div>', 1),
        ('<form><p>Short, but whole.</p><aside><p>Far longer, with points; and words, and more of them. It goes on, and on.</p></aside></form>', 1),
        ('<div class="page-with-sidebar">%s</div><div class="left-sidebar"><p>Some other text, of course; it is no part of it.</p></div>', 5),
        ('<aside>%s</aside>', 5),
        ('<article>%s</article><div class="comments"><article>I, too, think so.</article><article>So do I, sir.</article></div>', 5),
    ],
)
def test_layouts(body, blocks):
    got = h.main_text(f"<html><body>{body.replace('%s', ARTICLE)}</body></html>")
    assert got.count("\n") + 1 == blocks, got


def test_the_scores_decide(monkeypatch):
    """Without the ratios lists of links and lines without points are taken for the article."""
    links = "".join(f"<li><a href=/{k}>chapter {k} of it</a></li>" for k in range(9))
    page = f"<html><body><div><ul>{links}</ul></div><div>{ARTICLE}</div><div><span>imprint</span></div></body></html>"
    before = h.main_text(page)
    monkeypatch.setattr(h, "path_scores", lambda blocks: {b.path: 1.0 for b in blocks})
    assert before.count("\n") == 4 and h.main_text(page) != before


@pytest.mark.parametrize("source", ["<div>x" * 100_000, "<p>" * 50_000 + "</div>" * 50_000, "<span>" * 40_000 + "<p>x" * 40_000, "<div class=comment><article>x.</article></div>" * 20_000, "<a 'x" * 50_000, "<!-- x" * 50_000])
def test_deep_and_broken_markup_is_linear(source):
    began = time.perf_counter()
    h.main_text(source)
    assert time.perf_counter() - began < 30


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, f"<article>{ARTICLE}</article>", "u", "v")] * 3 + [(2, None, None, None), (None, "", "u", "v")]
    pages = spark.createDataFrame(rows, "page_id long, text string, N_chars string, __html string")
    got = h.with_main_text(pages, "text").collect()
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [0, 0, *[len(h.main_text(rows[0][1]))] * 3] and {r["__html"] for r in got} == {"v", None}
    assert h.with_main_text(pages.limit(0), "text").columns == ["page_id", "__html", "text", "n_chars"]
