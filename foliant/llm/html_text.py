"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks of text. Each block has the hashed names, classes, ids and roles on its tag path, hashed
words and a few counts; a bidirectional LSTM in numpy reads the sequence of all blocks, so a block is judged by what
stands before and after it in the whole page. Blocks labelled as article text are joined in page order.

Training is one task over at most ``MOST_PAGES`` pages (those with the smallest hash of their id). The table has no
labels, so the task writes pages of its own from these pages' words: a grammar of many layouts (articles, menus,
headers, footers, side bars, notices, adverts, forms, reader comments) marks what is article text. The model is some
150 KB.

Defined cases: a null or empty html gives an empty text; a page without article blocks too; repeated rows get equal
results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAGES = 300
TRAIN_PAGES = 500
TAGS, WORDS = 512, 512  # hash buckets
TAG_DIM, WORD_DIM, COUNTS, HIDDEN = 12, 6, 9, 12
EPOCHS = 14
CELLS = 20_000
# Elements whose content is never shown as text, and elements that part blocks.
UNSEEN = "script|style|noscript|template|title|svg|iframe|textarea|select|object|canvas|head"
PARTING = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("head meta link base title style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Quotes count right behind an equals sign only, and only if they close; a tag ends at the next < or the end of the page if
# nothing else ends it. So every character is looked at a few times at most, and no part of a tag becomes text.
INSIDE = r"(?>[^<>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<skip>{UNSEEN.replace('|head', '')})\b{INSIDE}(?:>|(?=<)|\Z).*?(?:</(?P=skip)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>{INSIDE})(?:>|(?=<)|\Z)|<[!?/][^>]*+>?|(?P<text>[^<]+)|<",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"\w+")


@lru_cache(100_000)
def _bucket(name: str, n: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % n


@lru_cache(20_000)
def _features(tag: str, attrs: str) -> tuple[int, ...]:
    out = {_bucket(f"<{tag}", TAGS)}
    for kind, a, b, c in ATTRIBUTE.findall(attrs):
        for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
            out.add(_bucket(f"{'role' if kind.lower() == 'role' else 'class'}={word}", TAGS))
    return tuple(out)


class Block:
    """A leaf block: its text, the hashed names on its path, the share of it inside links, its tag, and a training mark."""

    __slots__ = ("text", "path", "links", "tag", "marked")

    def __init__(self, text: str, path: list[int], links: float, tag: str, marked: bool) -> None:
        self.text, self.path, self.links, self.tag, self.marked = text, path, links, tag, marked


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], bool]] = []
    names: Counter[str] = Counter()  # of what is on the stack, so that no block or closing tag looks through it
    features: Counter[int] = Counter()
    marks = 0
    parts: list[str] = []
    linked, in_link, hidden = 0, 0, 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, sorted(features), min(1.0, linked / len(text)), stack[-1][0] if stack else "", marks > 0))
            linked = 0

    def leave() -> str:
        nonlocal marks
        name, own, marked = stack.pop()
        names[name] -= 1
        marks -= marked
        for f in own:
            features[f] -= 1
            if not features[f]:
                del features[f]
        return name

    for m in TOKEN.finditer(html):
        text = m["text"]
        if text is None and m[0] == "<":
            text = "<"
        if text is not None:
            if not hidden:
                text = entities.unescape(text) if "&" in text else text
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "head":
            hidden = 0 if m["close"] else 1
            continue
        if tag not in IN_HEAD:  # the first element of the body ends a head that is not closed
            hidden = 0
        if tag == "a":
            in_link = max(0, in_link - 1) if m["close"] else 1
            continue
        if tag not in PARTING:
            continue
        end()
        if m["close"]:
            if names[tag]:
                while leave() != tag:
                    pass
        elif tag not in VOID:
            if stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"))):
                leave()
            attrs = m["attrs"]
            stack.append((tag, _features(tag, attrs), 'data-main="1"' in attrs))
            names[tag] += 1
            features.update(stack[-1][1])
            marks += stack[-1][2]
    end()
    return out


def inputs(page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Path ids, word ids and counts of a page's blocks."""
    counts = np.zeros((len(page), COUNTS), np.float32)
    paths, words = [], []
    for i, b in enumerate(page):
        ws = WORD.findall(b.text.lower())
        words.append([_bucket(w, WORDS) for w in ws])
        paths.append(b.path)
        n = len(b.text)
        counts[i] = (
            np.log1p(n) / 8,
            np.log1p(len(ws)) / 6,
            b.links,
            sum(map(b.text.count, ".,;!?")) / (len(ws) + 1),
            b.tag[:1] == "h" and b.tag[1:].isdigit(),
            b.tag == "li",
            b.tag == "p",
            i / len(page),
            n > 120,
        )
    return paths, words, counts


def _counted(ids: list[list[int]], n: int) -> np.ndarray:
    """Rows of mean one-hot vectors."""
    out = np.zeros((len(ids), n), np.float32)
    lengths = np.array([len(x) for x in ids])
    flat = np.array([j for x in ids for j in x], np.int64)
    np.add.at(out, (np.repeat(np.arange(len(ids)), lengths), flat), 1)
    return out / np.maximum(lengths, 1)[:, None].astype(np.float32)


SHAPES = {
    "tags": (TAGS, TAG_DIM),
    "words": (WORDS, WORD_DIM),
    "wf": (TAG_DIM + WORD_DIM + COUNTS + HIDDEN, 4 * HIDDEN),
    "wb": (TAG_DIM + WORD_DIM + COUNTS + HIDDEN, 4 * HIDDEN),
    "bf": (4 * HIDDEN,),
    "bb": (4 * HIDDEN,),
    "out": (2 * HIDDEN + TAG_DIM + WORD_DIM + COUNTS,),
    "bias": (1,),
}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (pages, steps, HIDDEN) of one direction; state passes unchanged over padding."""
    n, steps, d = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    drive = x.reshape(-1, d) @ w[:d] + b
    drive = drive.reshape(n, steps, -1)
    out = np.zeros((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        z = drive[:, t] + h @ w[d:]
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[:, t, None]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc))
        c = m * new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[:, t] = h
    return out


def _lstm_back(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, steps, d = x.shape
    dw, dz_all = np.zeros_like(w), np.zeros((n, steps, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = keep[t]
        m = mask[:, t, None]
        dh = dh + dout[:, t]
        do, dnew = dh * m * tc, dh * m * o * (1 - tc * tc) + dc * m
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
        dw[d:] += h.T @ dz
        dz_all[:, t] = dz
        dh, dc = dh * (1 - m) + dz @ w[d:].T, dc * (1 - m) + dnew * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    dw[:d] = x.reshape(-1, d).T @ flat
    return (flat @ w[:d].T).reshape(x.shape), dw, flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


def _forward(model: dict, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
    """Logits (pages, steps)."""
    hf = _lstm(x, mask, model["wf"], model["bf"], keep and keep[0])
    hb = _lstm(x[:, ::-1], mask[:, ::-1], model["wb"], model["bb"], keep and keep[1])[:, ::-1]
    both = np.concatenate([hf, hb, x], axis=2)
    if keep is not None:
        keep[0].append(both)
    return both @ model["out"] + model["bias"][0]


def fit(pages: list[list[Block]], epochs: int = EPOCHS, seed: int = 5) -> dict:
    """Trains on pages whose blocks are marked; Adam on the mean log loss per block."""
    rng = np.random.default_rng(seed)
    model = {k: (rng.standard_normal(s) * (0.3 if len(s) == 2 and s[0] in (TAGS, WORDS) else 0.2)).astype(np.float32) * (len(s) > 1) for k, s in SHAPES.items()}
    model["bf"][HIDDEN : 2 * HIDDEN] = model["bb"][HIDDEN : 2 * HIDDEN] = 1
    data = []
    for p in pages:
        if p:
            paths, words, counts = inputs(p)
            data.append((_counted(paths, TAGS), _counted(words, WORDS), counts, np.array([b.marked for b in p], np.float32)))
    data.sort(key=lambda d: len(d[3]))
    groups = [data[i : i + 24] for i in range(0, len(data), 24)]
    m, v, t = {k: np.zeros_like(a) for k, a in model.items()}, {k: np.zeros_like(a) for k, a in model.items()}, 0
    for epoch in range(epochs):
        for at in rng.permutation(len(groups)):
            group = groups[at]
            tags, words, counts, marks = [np.concatenate([g[i] for g in group]) for i in range(4)]
            dropped = tags * (rng.random(tags.shape, dtype=np.float32) > 0.15)  # names may be missing
            flat = np.concatenate([dropped @ model["tags"] * 2, words @ model["words"] * 2, counts], axis=1)
            cuts = np.cumsum([len(g[3]) for g in group])[:-1]
            x, mask = _padded(np.split(flat, cuts))
            y, _ = _padded([a[:, None] for a in np.split(marks, cuts)])
            keep: tuple[list, list] = ([], [])
            p = _sigmoid(_forward(model, x, mask, keep))
            both = keep[0].pop()
            dl = ((p - y[:, :, 0]) * mask / mask.sum()).astype(np.float32)
            grads = {"out": (both * dl[:, :, None]).sum(axis=(0, 1)), "bias": np.array([dl.sum()], np.float32)}
            dboth = dl[:, :, None] * model["out"]
            dxf, grads["wf"], grads["bf"] = _lstm_back(x, mask, model["wf"], keep[0], dboth[:, :, :HIDDEN])
            dxb, grads["wb"], grads["bb"] = _lstm_back(x[:, ::-1], mask[:, ::-1], model["wb"], keep[1], dboth[:, ::-1, HIDDEN : 2 * HIDDEN])
            dx = (dxf + dxb[:, ::-1] + dboth[:, :, 2 * HIDDEN :])[mask > 0]
            grads["tags"], grads["words"] = dropped.T @ dx[:, :TAG_DIM] * 2, words.T @ dx[:, TAG_DIM : TAG_DIM + WORD_DIM] * 2
            t += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model[k] = model[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7) - (1e-4 if k == "words" else 0) * model[k]
                model[k] = model[k].astype(np.float32)
    return model


def _means(table: np.ndarray, ids: list[list[int]]) -> np.ndarray:
    """Twice the mean of the table's rows for each list of ids; zeros for an empty list."""
    lengths = np.array([len(x) for x in ids])
    out = np.zeros((len(ids), table.shape[1]), np.float32)
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
    some = lengths > 0
    if len(flat):
        out[some] = np.add.reduceat(table[flat], (np.cumsum(lengths) - lengths)[some]) * 2 / lengths[some, None]
    return out


def label(model: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are article text; pages of like length go through the network together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:  # pages of like length, of CELLS blocks in all with their padding, or one page
        n = next((n for n in range(min(64, len(order)), 1, -1) if n * len(pages[order[n - 1]]) <= CELLS), 1)
        some, order = order[:n], order[n:]
        paths, words, counts = zip(*[inputs(pages[i]) for i in some], strict=True)
        means = [_means(model["tags"], list(chain.from_iterable(paths))), _means(model["words"], list(chain.from_iterable(words)))]
        vectors = np.concatenate([*means, np.concatenate(counts)], axis=1)
        x, mask = _padded(np.split(vectors, np.cumsum([len(pages[i]) for i in some])[:-1]))
        logits = _forward(model, x, mask)
        for r, i in enumerate(some):
            out[i] = logits[r, : len(pages[i])] > 0
    return out


# The layouts that training pages are written in. Names that pages give their parts.
_MAIN = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div itemprop="articleBody"', 'div class="text"', "div", "section")
_ASIDE = {
    "menu": ("nav", 'ul class="menu"', 'div class="navbar"', 'div id="navigation"', 'div role="navigation"', 'ol class="breadcrumb"', 'div class="topnav links"'),
    "header": ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header banner"', 'div role="banner"'),
    "footer": ("footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="site-footer legal"'),
    "sidebar": ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related posts"', 'div role="complementary"', 'section class="recommended"'),
    "notice": ('div class="cookie-notice"', 'div class="banner alert"', 'div id="consent"', 'div class="notice"', 'div role="alert"', 'div class="newsletter popup"'),
    "advert": ('div class="ad"', 'div class="advertisement"', 'div class="sponsored promo"', 'div id="ads"', 'aside class="ad-slot"', 'div class="adsbox"'),
    "form": ("form", 'form class="search"', 'div class="login"', 'form id="subscribe"', 'div class="contact-form"'),
    "comments": ('div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div id="disqus"', 'div class="replies discussion"', 'section class="reader-comments"'),
}


def written_page(rng: np.random.Generator, words: list[str]) -> str:
    """A page in a random layout; what is article text carries a mark that only training reads."""
    pick = lambda a: a[int(rng.integers(len(a)))]
    say = lambda lo, hi: " ".join(pick(words) for _ in range(int(rng.integers(lo, hi))))
    prose = lambda: say(1, 6) + "." if rng.random() < 0.15 else say(12, 90) + "."

    def wrapped(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>" if rng.random() < 0.97 else f"<{opening}>{inner}"

    def paragraphs(lo: int, hi: int) -> str:
        out = []
        for _ in range(int(rng.integers(lo, hi))):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{prose()}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.8:
                out.append(f"<h{rng.integers(2, 4)}>{say(2, 8)}</h{2}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<p><b>{prose()}<br>")
            elif kind < 0.96:
                out.append(f"<blockquote>{prose()}</blockquote>")
            else:
                out.append(f"<p>{say(5, 20)} <a href='/x'>{say(1, 5)}</a> {say(5, 20)}.</p>")
        return "".join(out)

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{say(1, 4)}</a></li>' for _ in range(int(rng.integers(lo, hi)))) + "</ul>"

    def aside(kind: str) -> str:
        opening = pick(_ASIDE[kind])
        if kind == "menu":
            return wrapped(opening, links(3, 9))
        if kind == "form":
            return wrapped(opening, f"<label>{say(1, 4)}</label><input name=q><button>{say(1, 3)}</button><p>{say(2, 15)}</p>")
        if kind == "comments":
            each = "".join(f'<div class="{pick(("comment", "reply", "user-post"))}"><span>{say(1, 3)}</span><p>{prose()}</p></div>' for _ in range(int(rng.integers(1, 7))))
            return wrapped(opening, (f"<h3>{say(1, 4)}</h3>" if rng.random() < 0.5 else "") + each)
        if kind == "sidebar":
            return wrapped(opening, f"<h4>{say(1, 4)}</h4>" + (links(2, 7) if rng.random() < 0.6 else f"<p>{prose()}</p>"))
        if kind == "header":
            return wrapped(opening, f"<div>{say(1, 8)}</div>" + (links(2, 6) if rng.random() < 0.5 else ""))
        if kind == "footer":
            return wrapped(opening, f"&copy; {say(1, 5)} &middot; {say(2, 14)}." + (links(2, 6) if rng.random() < 0.4 else ""))
        return wrapped(opening, f"{say(4, 40)}." if rng.random() < 0.6 else f"<p>{say(4, 40)}.</p>")

    def some(kinds: str, chance: float) -> list[str]:
        return [aside(k) for k in kinds.split() if rng.random() < chance]

    heading = f"<h1>{say(3, 14)}</h1>" if rng.random() < 0.9 else ""
    if rng.random() < 0.15:
        halves = [f'<div data-main="1">{p}</div>' for p in (heading + paragraphs(2, 8), paragraphs(1, 8))]
        main = wrapped(pick(_MAIN[:9]), aside("advert").join(halves))
    else:
        opening = pick(_MAIN if rng.random() < 0.5 else _MAIN[:1])
        main = wrapped(opening + ' data-main="1"', heading + paragraphs(1, 16))
    before = some("header menu notice advert sidebar form", 0.4)
    after = some("sidebar advert comments form notice footer", 0.4)
    if rng.random() < 0.6:
        before.insert(0, aside("menu"))
    if rng.random() < 0.6:
        after.append(aside("footer"))
    body = "".join(before) + main + "".join(after)
    if rng.random() < 0.3:
        body = f'<div class="{pick(("wrapper", "page", "container", "row"))}">{body}</div>'
    return f"<html><body>{body}</body></html>"


def train(pages: DataFrame, most_pages: int = MOST_PAGES) -> dict:
    """Fits the labeller in one task over a bounded sample; the driver gets the weights alone."""
    sample = pages.select("page_id", "html").where("html is not null").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(most_pages)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t for b in batches for t in b.column(1).to_pylist()))
        words = sorted({w for t in rows for b in blocks(t) for w in b.text.split(" ") if w.isalpha()}, key=lambda w: (zlib.crc32(w.encode()), w))[:200_000] or ["word"]
        rng = np.random.default_rng(11)
        model = fit([blocks(written_page(rng, words)) for _ in range(TRAIN_PAGES)])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([model[k].ravel() for k in SHAPES]).astype("<f4").tobytes()], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(learn, "model binary").first()
    flat, model, at = np.frombuffer(row[0], "<f4") if row else np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()), np.float32), {}, 0
    for k, s in SHAPES.items():
        model[k] = flat[at : at + int(np.prod(s))].reshape(s)
        at += int(np.prod(s))
    return model


def main_text(pages: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    model = train(pages, most_pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cut = [blocks(t or "") for t in part.column(2).to_pylist()]
                texts = [" ".join(b.text for b, y in zip(p, ys, strict=True) if y) for p, ys in zip(cut, label(model, cut), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string").select("*", F.length("text").cast("long").alias("n_chars"))
