"""Main text of web pages: a conditional random field over the leaf blocks of a page.

Features are the tags and marks of a block's ancestors and the shape of its text. The
field is trained on labelled pages, which are composed from fragments of a bounded sample
of the table and known layouts; a page's labels are those of the most likely chain.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm import crf
from barlytics.llm.html_blocks import Block, blocks
from barlytics.llm.tables import drawn, slices, strings

#: Expected number of pages whose fragments the labelled pages are composed of, at most.
MAX_SAMPLE = 200
#: Labelled pages that the field is trained on.
LABELLED = 600
#: Layouts whose features a worker remembers.
REMEMBERED = 50_000

_SENTENCE_END = re.compile(r"[.!?…。»\"”)]$")
_CUES = re.compile(
    r"(?i)©|\bcopyright\b|all rights reserved|cookie|privacy|subscribe|newsletter|sign (?:in|up)|log ?in|advert|sponsored|"
    r"share (?:this|on)|\bcomments?\b|\breply\b|read more|related|posted by|terms of|follow us|search"
)


# ------------------------------------------------------------------ features


def path_features(path: tuple) -> list[str]:
    found = []
    for depth, (tag, own) in enumerate(reversed(path)):
        if depth == 0:
            found.append(f"tag {tag}")
        elif depth == 1:
            found.append(f"parent {tag}")
        if tag not in ("html", "body"):
            found.append(f"in {tag}")
        found += [f"mark {m}" for m in own]
    return list(dict.fromkeys(found))


def text_features(block: Block, first: bool, last: bool) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    share = 4 * block.linked // max(len(text), 1)
    found = ["any", f"words {min(n.bit_length(), 8)}", f"links {share}", f"stops {min(text.count('. ') + text.count(', '), 3)}"]
    if _SENTENCE_END.search(text):
        found.append("sentence")
    if n < 40 and (cue := _CUES.search(text)):
        found.append(f"cue {cue[0].lower()}")
    if first:
        found.append("first")
    if last:
        found.append("last")
    return found


def features(page: list[Block]) -> list[list[str]]:
    return [path_features(b.path) + text_features(b, i == 0, i == len(page) - 1) for i, b in enumerate(page)]


# ------------------------------------------------------------------ labelled pages

#: Layouts of a main part: begin and end markup.
MAIN = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
    ('<div id="content"><div class="post">', "</div></div>"), ('<section class="entry-content">', "</section>"), ('<div class="article-body">', "</div>"),
    ('<div id="main" role="main">', "</div>"), ('<div class="story text">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("<div>", "</div>"), ("", ""), ("", ""), ("", ""), ('<td class="main-content">', "</td>"),
    ('<div class="page"><article class="post hentry">', "</article></div>"),
]
#: Tags and attributes of parts that do not belong to it.
BESIDE = [
    "nav", 'div class="menu"', 'ul class="navbar"', 'div id="navigation" role="navigation"', 'div class="breadcrumbs"', "header",
    'div class="header"', 'div id="top-bar"', 'header class="site-header"', "footer", 'div class="footer"', 'div id="footer" role="contentinfo"', "aside",
    'div class="sidebar"', 'div id="side" role="complementary"', 'aside class="widget"', 'div class="ad"', 'div class="advert"', 'div class="ads banner"',
    'div id="sponsored"', 'section class="promo"', 'div class="cookie-notice"', 'div class="notice"', 'div id="gdpr-consent"', 'div class="alert warning"',
    'div role="alert"', "form", 'form class="search"', 'div class="newsletter-signup"', 'div id="login"', 'div class="comments"', 'section id="comments"',
    'div class="comment-list"', 'ol class="commentlist"', 'div id="respond"', 'div class="related-posts"', 'div class="share social"', 'div class="tags"',
    'div class="pagination"', "noscript", 'div class="popup modal"', "dialog", "menu", 'div class="disclaimer"',
]
#: Parts that stand inside a main part.
INSIDE = ['div class="ad"', 'div class="advert"', "aside", 'div class="share"', 'div class="related"', "form", "nav", 'div class="comments"', 'section class="comments"', "footer"]
#: Letters that tell the label of a composed block; they are taken out again.
IS_MAIN, IS_BESIDE = "\ue001", "\ue000"
_PROSE = ('div class="comment', 'section id="comm', 'section class="comm', 'ol class="comm', "aside", 'div class="sidebar"', 'div class="promo', "footer", "noscript", 'div class="disc')


def compose(fragments: list[str], r: random.Random) -> list[tuple[str, int]]:
    """A random page as (markup, label) pieces, in order; markup without text has label -1."""
    out: list[tuple[str, int]] = []

    def words(low: int, high: int) -> str:
        have = r.choice(fragments).split()
        begin = r.randrange(max(len(have) - low, 1))
        return " ".join(have[begin : begin + r.randint(low, high)]) or "text"

    def paragraph() -> str:
        return r.choice(fragments) if r.random() < 0.7 else words(1, 12)

    def part(tag: str) -> None:
        name = tag.split()[0]
        out.append((f"<{tag}>", -1))
        style = r.random()
        if tag.startswith(_PROSE) and style < 0.7:
            for _ in range(r.randint(1, 5)):
                wrap = r.choice(["p", "p", "li", 'div class="comment"', "blockquote"]) if "comm" in tag else r.choice(["p", "p", "div", "span", "h3"])
                out.append((f"<{wrap}>{paragraph()}</{wrap.split()[0]}>", 0))
        elif style < 0.35:
            for _ in range(r.randint(2, 8)):
                out.append((f'<li><a href="#">{words(1, 3)}</a></li>', 0))
        elif style < 0.55:
            out.append((r.choice(["&copy; ", "Copyright ", "", "Advertisement ", "Subscribe ", ""]) + words(2, 14), 0))
        elif "form" in name or style < 0.65:
            out.append((f"<label>{words(1, 3)}</label><input>", 0))
            out.append((f"<button>{words(1, 2)}</button>", 0))
        else:
            for _ in range(r.randint(1, 3)):
                out.append((f"<p>{words(2, 25)}</p>" if style < 0.85 else f"<div>{words(2, 25)}</div>", 0))
        out.append((f"</{name}>", -1))

    for _ in range(r.randint(0, 4)):
        part(r.choice(BESIDE))
    begin, end = r.choice(MAIN)
    out.append((begin, -1))
    if r.random() < 0.8:
        heading = r.choice(["h1", "h1", "h2"])
        out.append((f"<{heading}>{words(2, 12)}</{heading}>", 1))
    ends = r.random() < 0.7
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.06:
            part(r.choice(INSIDE))
        elif kind < 0.1:
            out.append((f"<h{r.randint(2, 4)}>{words(1, 8)}</h{2}>" if not ends else f"<h3>{words(1, 8)}</h3>", 1))
        elif kind < 0.16:
            out += [("<ul>", -1), *((f"<li>{words(1, 20)}</li>", 1) for _ in range(r.randint(2, 5))), ("</ul>", -1)]
        elif kind < 0.2:
            out.append((f"<blockquote>{paragraph()}</blockquote>", 1))
        elif kind < 0.24:
            out.append((f"<pre>{words(3, 30)}</pre>", 1))
        elif kind < 0.27:
            out += [("<table><tr>", -1), *((f"<td>{words(1, 5)}</td>", 1) for _ in range(4)), ("</tr></table>", -1)]
        elif kind < 0.34:
            out.append((f'<p>{words(1, 6)} <a href="#">{words(1, 4)}</a> {words(1, 30)}</p>', 1))
        elif kind < 0.4:
            out.append((f"<p><b>{paragraph()}<br>", 1))
        else:
            out.append((f"<p>{paragraph()}" + ("</p>" if ends else ""), 1))
    out.append((end, -1))
    for _ in range(r.randint(0, 4)):
        part(r.choice(BESIDE))
    return out


def labelled(fragments: list[str], n: int = LABELLED, seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    """Chains of ``n`` composed pages: features and labels of their blocks."""
    r = random.Random(seed)
    chains = []
    for _ in range(n):
        pieces = compose([f.replace("<", "&lt;") for f in fragments], r)
        # each piece that has text begins with a mark that tells its label
        page = "".join(_marked(markup, label) for markup, label in pieces)
        found, labels = [], []
        for b in blocks(f"<html><body>{page}</body></html>"):
            label = IS_MAIN in b.text
            text = b.text.replace(IS_MAIN, "").replace(IS_BESIDE, "").strip()
            if text:
                found.append(b._replace(text=text))
                labels.append(int(label))
        if found:
            chains.append((features(found), labels))
    return chains


def _marked(markup: str, label: int) -> str:
    if label < 0:
        return markup
    begin = re.match(r"(?:<[^>]*>)*", markup).end()
    return markup[:begin] + (IS_MAIN if label else IS_BESIDE) + markup[begin:]


FILLER = ["Some words that stand for a text of a page, with a few marks.", "Another line of text.", "One more, which is longer than the others, so that lengths differ, and ends here."]


def fit(pages: DataFrame, max_sample: int = MAX_SAMPLE, n_labelled: int = LABELLED) -> crf.Model:
    """Trains the field; pages are drawn at a rate that makes ``max_sample`` the expected number."""
    n = pages.count()
    rate = min(1.0, max_sample / max(n, 1))
    draw = F.xxhash64(F.lit("pages"), F.col("page_id"), F.col("url"))
    sample = pages.filter(F.col("html").isNotNull() & drawn(draw, rate)).select("html").sort("html")
    found = [b.text for row in sample.collect() for b in blocks(row["html"])]
    return crf.train(labelled(sorted(set(found)) or FILLER, n_labelled))


# ------------------------------------------------------------------ extraction


def main_blocks(page: str, model: crf.Model, path_score) -> list[str]:
    found = blocks(page)
    weight = model.weights.get
    last = len(found) - 1
    scores = [path_score(b.path) + sum(weight(f, 0.0) for f in text_features(b, i == 0, i == last)) for i, b in enumerate(found)]
    return [b.text for b, label in zip(found, crf.viterbi(scores, model)) if label]


def extract(pages: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Blocks of the main text are joined by one line feed, in page order. A null or empty
    page has an empty text; repeated rows are read one by one.
    """
    model = fit(pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_score = lru_cache(REMEMBERED)(lambda path: sum(model.weights.get(f, 0.0) for f in path_features(path)))
        for part in slices(batches):
            texts = ["\n".join(main_blocks(h, model, path_score)) for h in strings(part["html"])]
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
