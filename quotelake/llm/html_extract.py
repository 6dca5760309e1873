"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each page is a sequence of leaf blocks; a block's features are its ancestor tags, the words in its ancestors' class,
id and role, the nearest ancestor that tells a region, and properties of its text (length, share of linked text, closing punctuation). The model is trained on
labelled pages: a bounded sample of `TRAIN_PAGES` pages of the table itself whose markup names its article, and the
same texts laid out again in page plans with known regions (sidebars, notices, forms, reader comments and others), so
that it also knows regions the sample lacks. Weights are maximum likelihood with a quadratic penalty; decoding is
Viterbi over every block of the whole page. Pages are read in one narrow pass; only the weights are broadcast.

Defined cases: null or empty html gives an empty text; a page without main blocks gives an empty text; broken markup is
read as far as it goes; repeated rows each come back; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.htmlblocks import Block, read_page

#: Sampled pages for training, the longest page taken for it, planned pages, and blocks in a training sequence.
TRAIN_PAGES = 200
TRAIN_CHARS = 100_000
PLANS = 700
TRAIN_BLOCKS = 48
STEPS = 150
PENALTY = 1e-4

# Page plans for training: (container markup, label, items). Regions carry the names that sites commonly give them.
_MAIN = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body entry">',
         '<section class="article-text story">', '<div role="main">', '<div class="page"><div class="text">', "<td>", "<div>", ""]
_OTHER = {
    "menu": ["<nav>", '<div class="menu">', '<ul class="navigation navbar">', '<div id="breadcrumbs">', '<div role="navigation">'],
    "header": ["<header>", '<div id="header">', '<div class="site-header masthead banner">', '<div class="top logo">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="copyright legal bottom">', '<div role="contentinfo">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="related" class="widget">', '<div class="recommended more-links">',
             '<div role="complementary">', '<section class="trending popular">'],
    "notice": ['<div class="cookie-notice">', '<div id="cookie-consent" class="banner">', '<div class="alert message">',
               '<div class="gdpr popup modal overlay">', '<div role="alert" class="notice">', "<dialog>"],
    "advert": ['<div class="ad">', '<div class="advert ads">', '<div class="sponsored promo">', '<div id="advertisement">'],
    "form": ["<form>", '<div class="newsletter subscribe"><form>', '<form class="search login">', "<fieldset>"],
    "comment": ['<section id="comments">', '<div class="comment-list">', '<div class="comments reader-comments">',
                '<ol class="comment responses">', '<div class="discussion replies">'],
    "share": ['<div class="share social">', '<div class="tags meta byline">', '<figure class="ad">'],
}


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        n, linked = len(b.text.split()), b.linked / max(1, len(b.text))
        f = {f"tag {t}" for t in b.tags} | {f"name {n}" for n in b.names} | {f"near {n}" for n in b.near}
        f.add(f"own {b.tags[-1] if b.tags else ''}")
        f.add("words " + next(str(k) for k in (1, 3, 8, 20, 60, 1 << 60) if n <= k))
        f.add("linked " + ("none" if not linked else "some" if linked < 0.5 else "most"))
        f.add("ends " + ("stop" if b.text[-1] in ".!?…。" else "open"))
        f.update(x for x, yes in (("first", i == 0), ("last", i == len(blocks) - 1), ("sign", "©" in b.text)) if yes)
        f.add("always")
        out.append(sorted(f))
    return out


@dataclass
class Field:
    """Weights of a two-label chain: one row per feature, transitions and start scores."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for i, names in enumerate(features(blocks)):
            known = [self.index[x] for x in names if x in self.index]
            out[i] = self.emit[known].sum(0)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """Most likely labels by Viterbi; equal scores prefer label 0."""
        if not blocks:
            return []
        scores = self.scores(blocks).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        best, back = [a + b for a, b in zip(self.start.tolist(), scores[0], strict=True)], []
        for e0, e1 in scores[1:]:
            from0, from1 = best[1] + s10 > best[0] + s00, best[1] + s11 > best[0] + s01
            best = [(best[1] + s10 if from0 else best[0] + s00) + e0, (best[1] + s11 if from1 else best[0] + s01) + e1]
            back.append((int(from0), int(from1)))
        label = int(best[1] > best[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS) -> Field:
    """Maximum likelihood by gradient ascent (Adam) over padded sequences; forward-backward in numpy."""
    pages = [
        (b[i:i + TRAIN_BLOCKS], y[i:i + TRAIN_BLOCKS]) for b, y in pages for i in range(0, len(b), TRAIN_BLOCKS)
    ]
    named = [features(b) for b, _ in pages]
    index = {x: i for i, x in enumerate(sorted({x for page in named for block in page for x in block}))}
    size, most = len(pages), max((len(b) for b, _ in pages), default=1)
    x = np.zeros((size, most, len(index)), dtype=np.float32)
    y = np.zeros((size, most), dtype=np.int64)
    mask = np.zeros((size, most), dtype=bool)
    for p, (page, (_, labels)) in enumerate(zip(named, pages, strict=True)):
        for t, names in enumerate(page):
            x[p, t, [index[n] for n in names]] = 1
        y[p, :len(labels)], mask[p, :len(labels)] = labels, True
    total = max(1, mask.sum())
    gold = np.eye(2)[y] * mask[..., None]
    both = mask[:, 1:, None, None] * np.eye(2)[y[:, :-1]][..., :, None] * np.eye(2)[y[:, 1:]][..., None, :]
    flat = x.reshape(-1, len(index))
    params = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        emit, step, start = params
        e = (flat @ emit.astype(np.float32)).reshape(size, most, 2).astype(float) * mask[..., None]
        ahead, behind = np.zeros((size, most, 2)), np.zeros((size, most, 2))
        ahead[:, 0] = e[:, 0] + start
        for t in range(1, most):
            into = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + e[:, t]
            ahead[:, t] = np.where(mask[:, t, None], into, ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            out = np.logaddexp.reduce(step + (e[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], out, 0)
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None, None]
        node = np.exp(ahead + behind - norm) * mask[..., None]
        edge = np.exp(
            ahead[:, :-1, :, None] + step + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - norm[..., None]
        ) * mask[:, 1:, None, None]
        grads = [
            flat.T @ (gold - node).reshape(-1, 2).astype(np.float32) / total - PENALTY * emit,
            (both - edge).sum((0, 1)) / total - PENALTY * step, (gold - node)[:, 0].sum(0) / total - PENALTY * start,
        ]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + 0.1 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return Field(index, *params)


def _closing(markup: str) -> str:
    tags = [part.split(">")[0].split()[0] for part in markup.split("<")[1:]]
    return "".join(f"</{t}>" for t in reversed(tags))


def _region(rng: random.Random, kind: str, markup: str, short: list[str], long: list[str]) -> str:
    pick = lambda pool: rng.choice(pool or ["text"])
    link = lambda: f'<li><a href="#">{pick(short)}</a></li>'
    body = {
        "menu": lambda: "<ul>" + "".join(link() for _ in range(rng.randint(2, 7))) + "</ul>",
        "header": lambda: f"<h1>{pick(short)}</h1>" if rng.random() < 0.5 else f"<p>{pick(short)}</p>",
        "footer": lambda: f"<p>&copy; {pick(short)}</p>" if rng.random() < 0.5 else f"&copy; {pick(short)}",
        "side": lambda: f"<h3>{pick(short)}</h3><ul>" + "".join(link() for _ in range(3)) + f"</ul><p>{pick(long + short)}</p>",
        "notice": lambda: f"<p>{pick(long + short)}</p><button>{pick(short)}</button>",
        "advert": lambda: pick(short + long) if rng.random() < 0.5 else f"<p>{pick(short + long)}</p>",
        "form": lambda: f"<label>{pick(short)}</label><input><p>{pick(short + long)}</p><button>{pick(short)}</button>",
        "comment": lambda: f"<h3>{pick(short)}</h3>" + "".join(
            f"<div><b>{pick(short)}</b><p>{pick(long)}</p></div>" for _ in range(rng.randint(1, 4))),
        "share": lambda: f'<a href="#">{pick(short)}</a> <a href="#">{pick(short)}</a>',
    }[kind]()
    return markup + body + _closing(markup)


def planned_page(rng: random.Random, short: list[str], long: list[str]) -> tuple[str, str]:
    """A page in a random plan (with `mark` around its main part) and that part's label word."""
    main_markup = "<article>" if rng.random() < 0.3 else rng.choice(_MAIN)
    title = rng.choice(short or ["title"])
    pool = short if short and rng.random() < 0.25 else long + short or ["text"]
    paragraphs = [f"<p>{rng.choice(pool)}</p>" for _ in range(rng.choice((0, 1, 1, 2, 4, 8)))]
    if rng.random() < 0.3:
        paragraphs.append("<ul>" + "".join(f"<li>{rng.choice(short or ['point'])}</li>" for _ in range(3)) + "</ul>")
    if rng.random() < 0.3:
        paragraphs.insert(len(paragraphs) // 2, f"<h2>{rng.choice(short or ['part'])}</h2>")
    if rng.random() < 0.2:
        paragraphs.append(f"<blockquote>{rng.choice(long or ['quote'])}</blockquote>")
    inside = lambda kind: f"<x-other>{_region(rng, kind, rng.choice(_OTHER[kind]), short, long)}</x-other>"
    for kind in ("advert", "share", "side", "form", "notice", "comment"):
        if rng.random() < 0.3:
            place = len(paragraphs) if kind == "comment" else rng.randint(0, len(paragraphs))
            paragraphs.insert(place, inside(kind))
    head = f"<h1>{title}</h1>" if rng.random() < 0.8 or not paragraphs else ""
    main = f"{main_markup}<x-main>{head}{''.join(paragraphs)}</x-main>{_closing(main_markup)}"
    crowd = rng.choice((0, 0.5, 0.7))
    before = [k for k in ("header", "menu", "notice", "advert", "form") if rng.random() < crowd]
    after = [k for k in ("side", "comment", "advert", "notice", "form", "share", "footer") if rng.random() < crowd]
    out = lambda kinds: "".join(_region(rng, k, rng.choice(_OTHER[k]), short, long) for k in kinds)
    return f"<html><head><title>{title}</title></head><body>{out(before)}{main}{out(after)}</body></html>", "x-main"


def _labelled(html: str, main: tuple[str, ...]) -> tuple[list[Block], list[int]]:
    """Blocks with label 1 inside `main`, taking the marks of planned pages off the features again."""
    blocks, labels = read_page(html).blocks, []
    for b in blocks:
        label = int(any(t in main for t in b.tags) and "x-other" not in b.tags)
        labels.append(label)
        b.tags = tuple(t for t in b.tags if not t.startswith("x-"))
    return blocks, labels


def training_pages(sample: list[str], seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Sampled pages that name their article, and planned pages built from their texts."""
    rng, real = random.Random(seed), []
    short, long = [], []
    for html in sample:
        blocks, labels = _labelled(html, ("article", "main"))
        if any(labels):
            real.append((blocks, labels))
        for b in blocks:
            (long if len(b.text.split()) > 12 else short).append(
                b.text[:400].replace("&", "&amp;").replace("<", "&lt;"))
    plans = []
    for _ in range(PLANS):
        html, mark = planned_page(rng, short, long)
        plans.append(_labelled(html, (mark,)))
    return real + plans


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = TRAIN_PAGES) -> Field:
    """A model trained on a sample of at most `limit` pages, the first in the order of a hash of id and html.

    The hashes are chosen first, so a task sends numbers, not pages; only the chosen pages reach the driver.
    """
    rows = pages.select(F.col(html_col).cast("string").alias("h"), F.xxhash64(F.col(id_col), F.col(html_col)).alias("k"))
    rows = rows.where(F.length("h").between(1, TRAIN_CHARS))
    chosen = rows.select("k").distinct().orderBy("k").limit(limit)
    sample = rows.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect()
    return train(training_pages([r["h"] for r in sample]))


def main_text(model: Field, html: str | None) -> str:
    blocks = read_page(html).blocks
    return "\n\n".join(b.text for b, y in zip(blocks, model.decode(blocks), strict=True) if y)


def extract(
    pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages, id_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(shared.value, h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], names=["id", "url", "text"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "id long, url string, text string")
