"""Scores and contents of pages against a restatement that walks the tree for each."""

import random
import time

from tidemill.sources import web
from tidemill.sources.web import BLOCKS, CLOSED_BLOCKS, CONTENT_BONUS, CONTROLS, DROPPED, NAVIGATION_HINTS, Page, tidy


def _inside(p, i, tags):
    return [j for j in range(i + 1, p.stop[i]) if p.tag[j] in tags and not any(p.tag[k] in DROPPED for k in [j, *p.above(j)])]


def plain_score(p, i):
    marker, role = p.marker(i), p.attrs[i].get("role", "").lower()
    said = lambda j: " ".join(p.texts[p.begin[j] : p.said[j]])
    blocks = tidy("\n".join(said(j) for j in _inside(p, i, BLOCKS)))
    kind = 2000 if p.tag[i] == "main" or role == "main" else 1000 if p.tag[i] == "article" else 0
    gain = sum(v for k, v in CONTENT_BONUS.items() if k in marker) - (6000 if any(h in marker for h in NAVIGATION_HINTS) else 0)
    return len(blocks) + 0.08 * min(len(tidy(said(i))), 30_000) + kind + gain - 0.7 * sum(len(tidy(said(j))) for j in _inside(p, i, ("a",))) - 80 * len(_inside(p, i, CONTROLS))


def plain_blocks(p, root):
    out = []
    for i in _inside(p, root, BLOCKS):
        if not any(p.tag[j] in CLOSED_BLOCKS for j in p.above(i) if j > root) and (text := p.text(i)):
            out.append(f"{'#' * int(p.tag[i][1])} {text}" if p.tag[i][0] == "h" else text)
    return out or [t for t in [p.text(root)] if t]


def test_scores_and_blocks_of_random_pages():
    rng = random.Random(11)
    tags = [*BLOCKS, "div", "section", "article", "main", "a", "button", "nav", "script", "span", "br", "input", "title"]
    words = ["", " ", "\n", "\n\n\n", " \t\n", "a", "b c", "é", "́x", "ﬁ", " ", "　", "\r", "\r\n", "x\r", "\x01", "word " * 5, "끝 \n\n \n", "&amp;", " "]
    seen = 0
    for _ in range(400):
        html, opened = "", []
        for _ in range(rng.randint(1, 60)):
            r = rng.random()
            if r < 0.45:
                t = rng.choice(tags)
                hint = rng.choice(["", "", " class='content'", " id='article_body'", " class='menu'", " role='main'"])
                html += f"<{t}{hint}>"
                opened.append(t)
            elif r < 0.65 and opened:
                html += f"</{opened.pop(rng.randrange(len(opened)))}>"
            else:
                html += rng.choice(words)
        p = Page(html)
        root = p.root()
        p._measure()
        for i in range(len(p.tag)):
            assert abs(p.score(i) - plain_score(p, i)) < 1e-6, (html, i)
            seen += 1
        if root is not None:
            assert p.blocks(root) == plain_blocks(p, root)
    assert seen > 3000


def test_a_page_of_fifty_thousand_nested_nodes():
    html = "".join(f"<div class='content c{i}'>word {i} <a href='x'>link</a>" for i in range(25_000)) + "<p>deep</p>" + "</div>" * 25_000
    began = time.time()
    page = web.parse(html, "https://h.org")
    assert time.time() - began < 30 and page["text"].endswith("deep")
    p = Page(html)
    assert len(p.tag) > 50_000 and p.root() is not None
