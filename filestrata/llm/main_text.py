"""Main text of web pages by gradient-boosted trees over the nodes of their block elements.

Every node gets the log-odds of being part of the article, from its subtree's text density, attribute
words, depth and siblings. Choices for single nodes can contradict each other; decoding takes the tree as a whole: a node
may only be kept if its parent is, and the set of largest summed odds wins, each node weighted by its own
text. Kept nodes give their runs of text in page order, one line each.

The trees are trained here on pages drawn from a generator of layouts (`drawn_page`) with known main text;
names of elements and attributes are sometimes withheld, so that shape and density have to carry the choice. A null or empty
page, and one without text, has an empty text. Rows come back as often as they went in.
"""
from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import boosting, frames
from .dom import Page

#: Generated pages that the trees are trained on.
TRAINING_PAGES = 500
_SYLLABLES = "ka lo mi ren ta vos el um ar sti pon de ra chi nu ber gol fen wy os".split()


def _words(draw: random.Random, n: int) -> str:
    words = ["".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) for _ in range(n)]
    for i in range(len(words)):
        if i == 0 or draw.random() < 0.1:
            words[i] = words[i].capitalize()
        if draw.random() < 0.15:
            words[i] += draw.choice(".,.;")
    return " ".join(words) + draw.choice([".", ".", "", "?"])


def _element(draw: random.Random, names: list[str], classes: list[str], inside: str, kept: bool | None = None, shy: float = 0.25) -> str:
    """An element with one of the names, often a plain one, and often a class."""
    name = draw.choice(names) if draw.random() > shy else "div"
    shown = f' {draw.choice(["class", "class", "id", "role"])}="{draw.choice(classes)}"' if classes and (name == "div" or draw.random() < 0.6) and draw.random() > 0.08 else ""
    mark = "" if kept is None else f' data-kept="{int(kept)}"'
    return f"<{name}{shown}{mark}>{inside}</{name}>"


def _links(draw: random.Random, n: int) -> str:
    items = [f'<a href="/{i}">{_words(draw, draw.randint(1, 3))}</a>' for i in range(n)]
    kind = draw.random()
    if kind < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return " | ".join(items) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in items)


def _paragraphs(draw: random.Random, n: int, longest: int) -> str:
    out = []
    for _ in range(n):
        text = _words(draw, max(1, int(longest ** draw.random())))
        if draw.random() < 0.2:
            text = f"<b>{text}<br>" if draw.random() < 0.5 else f'<i>{text}</i> <a href="#">{_words(draw, 2)}</a> {_words(draw, 8)}'
        out.append(f"<p>{text}" + ("</p>" if draw.random() < 0.85 else ""))
    return "".join(out)


def drawn_page(draw: random.Random) -> str:
    """A page whose elements carry `data-kept`: 1 on the article, 0 on what does not belong to it."""
    body = []
    if draw.random() < 0.5:
        body.append(_element(draw, ["header"], ["header", "site-header", "masthead", "top"], _words(draw, draw.randint(1, 6)) + _links(draw, draw.randint(0, 4)), False))
    if draw.random() < 0.8:
        body.append(_element(draw, ["nav", "menu"], ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumbs"], _links(draw, draw.randint(2, 12)), False))
    extras = [
        lambda: _element(draw, ["div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo-box", "banner"],
                         _paragraphs(draw, 1, 40) if draw.random() < 0.4 else _words(draw, draw.randint(2, 40)), False, 0.8),
        lambda: _element(draw, ["aside"], ["sidebar", "widget", "related", "rail"], f"<h3>{_words(draw, 2)}</h3>" + (_links(draw, draw.randint(2, 8)) if draw.random() < 0.6 else _paragraphs(draw, draw.randint(1, 3), 30)), False),
        lambda: _element(draw, ["div", "section"], ["cookie-notice", "notice", "consent", "alert", "popup", "notification"], _words(draw, draw.randint(5, 30)) + "<button>" + _words(draw, 1) + "</button>", False, 0.8),
        lambda: _element(draw, ["form"], ["newsletter", "subscribe", "search-form", "login"], f"<label>{_words(draw, 3)}</label><input name='q'>" + (f"<p>{_words(draw, 12)}</p>" if draw.random() < 0.5 else ""), False, 0.1),
        lambda: _element(draw, ["div"], ["share", "social", "tags", "meta"], _links(draw, draw.randint(2, 5)), False, 0.8),
    ]
    comments = lambda: _element(draw, ["section", "div"], ["comments", "comment-list", "discussion", "replies", "reader-comments"], f"<h3>{_words(draw, 2)}</h3>" * draw.randint(0, 1) + "".join(
        _element(draw, ["div", "article", "li"], ["comment", "reply"], f"<b>{_words(draw, 1)}</b> {_words(draw, draw.randint(3, 40))}" if draw.random() < 0.5 else _paragraphs(draw, draw.randint(1, 2), 30))
        for _ in range(draw.randint(1, 6))), False)
    heading = f"<h1>{_words(draw, draw.randint(1, 12))}</h1>" if draw.random() < 0.85 else ""
    article = [heading, _paragraphs(draw, draw.choice([0, 1, 1, 2, 4, 8, 15]), draw.choice([5, 60, 200]))]
    if not heading and article[1] == "":
        article.append(_words(draw, draw.randint(1, 40)))
    if draw.random() < 0.3:
        article.append("<ul>" + "".join(f"<li>{_words(draw, draw.randint(2, 25))}</li>" for _ in range(draw.randint(2, 6))) + "</ul>")
    if draw.random() < 0.3:
        article.append(f"<h2>{_words(draw, 4)}</h2>" + _paragraphs(draw, 2, 80))
    if draw.random() < 0.25:
        article.append(draw.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td><td>12</td></tr></table>"]).format(_words(draw, 15)))
    if draw.random() < 0.3:
        article.insert(draw.randint(1, len(article)), draw.choice(extras)())
    content = _element(draw, ["article", "main", "article", "section"], ["article", "content", "post-body", "entry-content", "story", "main-text"], "".join(article), True)
    middle = [content] + [f() for f in draw.sample(extras, draw.randint(0, 3))] + [comments()] * (draw.random() < 0.35)
    if draw.random() < 0.5:
        draw.shuffle(middle)
    inside = "".join(middle)
    body.append(f'<div class="{draw.choice(["wrap", "page", "container", "layout"])}">{inside}</div>' if draw.random() < 0.4 else inside)
    if draw.random() < 0.85:
        body.append(_element(draw, ["footer"], ["footer", "site-footer", "copyright", "bottom"], "&copy; " + _words(draw, draw.randint(2, 25)) + (_links(draw, 3) if draw.random() < 0.3 else ""), False))
    return f"<html><head><title>{_words(draw, 4)}</title></head><body>{''.join(body)}</body></html>"


def _targets(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Per node whether it is to be kept, and its weight: its own text, or little for what only contains others."""
    n = len(page.tags)
    own = np.zeros(n)
    for node, text in page.runs:
        own[node] += len(text)
    inside, kept_below, kept = np.zeros(n, dtype=bool), np.zeros(n), np.zeros(n, dtype=bool)
    for i in range(n):
        inside[i] = page.marks[i] == "1" or page.marks[i] == "" and i > 0 and inside[page.parents[i]]
        kept_below[i] = own[i] * inside[i]
    for i in range(n - 1, -1, -1):
        kept[i] = inside[i] or kept_below[i] > 0
        if i:
            kept_below[page.parents[i]] += kept_below[i]
    return kept, node_weights(own)


def node_weights(own: np.ndarray) -> np.ndarray:
    return 0.3 + np.log1p(own)


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> boosting.Trees:
    """The model, fitted once a driver."""
    draw = random.Random(seed)
    drawn = [Page(drawn_page(draw)) for _ in range(pages)]
    targets = [_targets(p) for p in drawn]
    return boosting.fit(np.concatenate([p.features() for p in drawn]), np.concatenate([k for k, _ in targets]).astype(float),
                        np.concatenate([w for _, w in targets]))


def decoded(page: Page, odds: np.ndarray) -> str:
    """The text of the best set of nodes in which every kept node's parent is kept."""
    n = len(page.tags)
    own = np.zeros(n)
    for node, text in page.runs:
        own[node] += len(text)
    gain = (odds * node_weights(own)).tolist()
    gain[0] = 0.0
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parents[i]] += gain[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and gain[i] > 0
    return "\n".join(text for node, text in page.runs if kept[node])


def main_text(pages: DataFrame, trees: boosting.Trees | None = None) -> DataFrame:
    """`page_id, url, text, n_blocks` of each page, whole however long."""
    shared = frames.shared(pages.sparkSession, "trees", trees or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, "html"):
            trees_of = [Page(source) for source in batch.column("html").to_pylist()]
            odds = shared().odds(np.concatenate([p.features() for p in trees_of]))
            ends = np.cumsum([len(p.tags) for p in trees_of])
            found = [decoded(p, odds[end - len(p.tags):end]) for p, end in zip(trees_of, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), frames.longs([len(p.runs) for p in trees_of])],
                ["page_id", "url", "text", "n_blocks"])

    sources = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return sources.mapInArrow(run, "page_id long, url string, text string, n_blocks long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(frames.table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
