"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of the elements around it
(tags, classes, ids, roles). A bidirectional LSTM in numpy reads for each block the hashed path, hashed words and some
figures (length, share of linked text, punctuation), in page order, and labels every block with the whole document in
view. The blocks labelled as article, whole, are the page's text.

The model is trained here, once for each process and parameters, on pages that a generator makes by rule from many
templates (article, section or div with telling or dumb class names; menus, headers, sidebars, notices, adverts,
forms, reader comments and footers around and inside the article). No page of the input is used for it.

Null and empty html give an empty text; unclosed and crossed tags, raw text elements, comments and character
references follow the usual repairs; a quote that is never closed ends with its tag; repeated pages each get a row; other
columns are ignored, whatever they are called; blocks of exactly the least probability count as article. Very long
pages are read in parts of PART blocks, with the state of the network carried from part to part in both directions, so
that every block is labelled as if the page were read at once. Of elements nested deeper than NESTED the innermost ones
give a block its path.
"""

from __future__ import annotations

import html as html_escapes
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tune

#: Elements whose content is no markup, that never show text, that stand alone, that do not break a block.
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
HIDDEN_TEXT = frozenset("head svg template select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math object q rp rt ruby s samp select small span strike strong sub sup svg template time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A quote counts only behind "=" and where it is closed; no part is tried in two ways.
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
DIM, HIDDEN, PART, NESTED = 96, 16, 2000, 256
PAGES, EPOCHS, BATCH, RATE, SEED = 480, 7, 24, 0.02, 7


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    page = page or ""

    opened: Counter[str] = Counter()

    def path() -> tuple[str, ...]:
        """Marks of the innermost NESTED elements."""
        return tuple(x for name, marks in stack[-NESTED:] if name not in INLINE for x in (name, *marks))

    def hidden() -> bool:
        return any(opened[name] for name in HIDDEN_TEXT)

    def close(k: int):
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def close_block():
        nonlocal linked
        if parts:
            text = " ".join(html_escapes.unescape("".join(parts)).split())
            if text:
                out.append(Block(path(), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def take(text: str):
        nonlocal linked
        if text and not hidden():
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    at, last = 0, page.rfind(">") + 1
    for m in iter(lambda: _TAG.search(page, at, last), None):
        take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if at == last and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>", "<!-->", "<!--->")):
                at = len(page)
                break
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE and not hidden():
                close_block()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if name in INLINE and name not in HIDDEN_TEXT and stack[k][0] not in INLINE:
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in CLOSES_P and (opened["svg"] or opened["select"]):  # what was never closed
            close(next(k for k, (n, _) in enumerate(stack) if n in ("svg", "select")))
        if name not in INLINE and not hidden():
            close_block()
        if name not in INLINE:
            if name == "body":
                stack[:] = [s for s in stack if s[0] != "head"]
                opened["head"] = 0
            if name in CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name)
            while same and stack and (stack[-1][0] in same or stack[-1][0] in INLINE or stack[-1][0] == "p"):
                close(len(stack) - 1)
        elif name == "br":
            take(" ")
        if name not in VOID and not m[3].endswith("/"):
            marks = tuple(f".{w}" for _, v in _ATTR.findall(m[3]) for w in _NAME.findall(v.lower())) if m[3] else ()
            stack.append((name, marks))
            opened[name] += 1
    take(page[at:])
    close_block()
    return out


def vector(b: Block) -> np.ndarray:
    """Hashed path (with depth-free marks), mean of the hashed words of the whole block and figures."""
    v = np.zeros(DIM, np.float32)
    for k, x in enumerate(b.path):
        v[zlib.crc32(x.encode()) % 64] += 1.0
    if b.path:
        v[zlib.crc32(("leaf " + b.path[-1]).encode()) % 64] += 0.5
    v[:64] = np.minimum(v[:64], 2)
    found = _WORD.findall(b.text.lower())
    for w in found:
        v[64 + zlib.crc32(w.encode()) % 24] += 1 / max(1, len(found))
    n = len(b.text)
    v[88:96] = (min(n, 600) / 300, n > 80, b.linked / n, b.text.count(".") / max(1, len(found)) * 4, b.text[-1] in ".!?", len(found) < 6, "©" in b.text or "@" in b.text, 1.0)
    return v


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic output; Adam for training."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = scale(DIM, 4 * HIDDEN)
            self.w[f"h{d}"] = scale(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w[f"b{d}"] = bias
        self.w["o"], self.w["c"] = scale(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = True):
        """x: time, pages, DIM. Padding keeps the state. The outputs, what training needs, and the last state."""
        wh, gates_x = self.w[f"h{d}"], x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c = state or (np.zeros((x.shape[1], HIDDEN), np.float32),) * 2
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = gates_x[t] + h @ wh
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            y = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, y, m))
            c, h = np.where(m, new, c), np.where(m, o * y, h)
            out[t] = h
        return out, kept, (h, c)

    def _chance(self, h: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(h @ self.w["o"] + self.w["c"], -30, 30)))

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = True):
        hf, kf, _ = self._pass(x, mask, "f", None, keep)
        hb, kb, _ = self._pass(x, mask, "b", None, keep)
        h = np.concatenate([hf, hb], 2)
        return self._chance(h), (h, kf, kb)

    def long(self, page: list[Block], part: int = PART) -> np.ndarray:
        """The labels of one page, read part by part from both ends with the state carried on."""
        starts = range(0, len(page), part)
        read = lambda b: stacked([np.array([vector(x) for x in page[b : b + part]])])
        outs = {}
        for d, order in (("f", starts), ("b", reversed(starts))):
            state, out = None, np.zeros((len(page), HIDDEN), np.float32)
            for b in order:
                x, mask = read(b)
                got, _, state = self._pass(x, mask, d, state, keep=False)
                out[b : b + part] = got[:, 0]
            outs[d] = out
        return self._chance(np.concatenate([outs["f"], outs["b"]], 1))

    def _back(self, grads, x, dh_out, kept, d):
        dh_next = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc_next = dh_next.copy()
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        for t, h, c, i, f, o, g, y, m in reversed(kept):
            dh = dh_out[t] + dh_next
            dhm = np.where(m, dh, 0)
            dc = np.where(m, dc_next, 0) + dhm * o * (1 - y * y)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dhm * y * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"h{d}"] += h.T @ dz
            dz_all[t] = dz
            dh_next = np.where(m, dz @ self.w[f"h{d}"].T, dh)
            dc_next = np.where(m, dc * f, dc_next)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"x{d}"] += x.reshape(-1, DIM).T @ flat
        grads[f"b{d}"] += flat.sum(0)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Labeller:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for k in range(0, len(order), BATCH):
                some = [pages[i] for i in order[k : k + BATCH]]
                x, mask = stacked([p for p, _ in some])
                y = np.zeros(mask.shape, np.float32)
                for j, (_, lab) in enumerate(some):
                    y[: len(lab), j] = lab
                p, (h, kf, kb) = self.forward(x, mask)
                dz = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
                grads = {n: np.zeros_like(v) for n, v in self.w.items()}
                grads["o"] = np.einsum("tp,tph->h", dz, h)
                grads["c"][0] = dz.sum()
                dh = dz[:, :, None] * self.w["o"]
                self._back(grads, x, dh[:, :, :HIDDEN], kf, "f")
                self._back(grads, x, dh[:, :, HIDDEN:], kb, "b")
                step += 1
                lr = rate * (1 - 0.8 * epoch / max(1, epochs))
                for n, g in grads.items():
                    m1[n] = 0.9 * m1[n] + 0.1 * g
                    m2[n] = 0.99 * m2[n] + 0.01 * g * g
                    self.w[n] -= (lr * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]], part: int = PART) -> list[np.ndarray]:
        """Probability of each block of each page to be article text."""
        out = [self.long(p, part) if len(p) > part else np.zeros(len(p)) for p in pages]
        order = sorted((k for k, p in enumerate(pages) if 0 < len(p) <= part), key=lambda k: len(pages[k]))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            p, _ = self.forward(*stacked([np.array([vector(b) for b in pages[i]]) for i in some]), keep=False)
            for j, i in enumerate(some):
                out[i] = p[: len(pages[i]), j]
        return out


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded vectors (time, pages, DIM) and the mask of what is there."""
    n = max(len(p) for p in pages)
    x, mask = np.zeros((n, len(pages), DIM), np.float32), np.zeros((n, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def made_page(r: random.Random) -> tuple[str, list[str]]:
    """A page by rule and the texts of its article's blocks. Every word is random, so that only layout and length tell."""
    letters = "abcdefghijklmnoprstuväéñ"
    word = lambda: "".join(r.choices(letters, k=r.randint(1, 8)))
    pick = lambda *x: r.choice(x)
    upto = lambda a, b: range(r.randrange(a, b))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in upto(a, b))

    def sentence() -> str:
        return words(2, 16).capitalize() + pick(".", ".", ".", "!", "?", ".")

    def prose() -> str:
        k = r.random()
        if k < 0.04:
            return " ".join([word().capitalize()] * r.randrange(3, 60))
        if k < 0.08:
            return " ".join(word() + pick("%%%", "***", "|", "###", "!!", "$$$") for _ in upto(3, 60))
        if k < 0.11:
            return words(5, 60).upper() + pick(".", "", "!")
        if k < 0.14:
            return words(5, 60)
        if k < 0.15:  # a text laid out with <br> is one very long block
            return " ".join(sentence() for _ in upto(50, 300))
        return " ".join(sentence() for _ in upto(1, 7)) if k < 0.88 else words(1, 3).capitalize() + "."

    keep: list[str] = []

    def kept(text: str) -> str:
        keep.append(text)
        return text

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def comments() -> str:
        one = lambda: f'<div class="comment"><span class="author">{word()}</span><p>{prose()}</p></div>'
        return f'<{(e := pick("section", "div"))} {pick("class", "id")}="{pick("comments", "comment-list", "responses", "discussion", "reader-comments")}"><h3>{words(1, 3)}</h3>' + "".join(one() for _ in upto(1, 5)) + f"</{e}>"

    def junk() -> str:
        k = r.randrange(8)
        if k == 0:
            return f'<div class="{pick("ad", "ads", "advert", "sponsored", "banner", "promo")}">{prose()}</div>'
        if k == 1:
            return f'<{(e := pick("aside", "div"))} class="{pick("sidebar", "side", "related", "widget")}"><h3>{words(1, 3)}</h3>{links(r.randrange(2, 6)) if r.random() < 0.6 else f"<p>{prose()}</p>"}</{e}>'
        if k == 2:
            return f'<div class="{pick("cookie-notice", "notice", "cookie", "consent", "newsletter", "popup", "alert")}"><p>{prose()}</p><button>{word()}</button></div>'
        if k == 3:
            return f'<form action="/{word()}" class="{pick("search", "subscribe", "login", "signup")}"><label>{words(1, 4)}</label><input name="q"><button>{word()}</button></form>'
        if k == 4:
            return comments()
        if k == 5:
            return f'<div class="{pick("share", "social", "tags", "breadcrumb", "breadcrumbs", "pagination")}">{links(r.randrange(2, 5)) if r.random() < 0.5 else "".join(f"<a href=/{word()}>{word()}</a> " for _ in range(3))}</div>'
        if k == 6:
            return f'<{(e := pick("nav", "div"))} class="{pick("menu", "nav", "navigation", "navbar", "toc")}">{links(r.randrange(3, 9))}</{e}>'
        return f'<div class="{pick("related", "recommended", "more")}"><h4>{words(1, 3)}</h4>{links(r.randrange(2, 5))}</div>'

    title = sentence() if r.random() < 0.5 else words(2, 9)
    top = [f"<nav>{links(r.randrange(3, 8))}</nav>"] if r.random() < 0.7 else []
    if r.random() < 0.5:
        top.append(f'<header class="{pick("site-header", "header", "top", "masthead")}"><a href="/">{words(1, 3)}</a><p>{words(2, 8)}</p></header>')
    top += [junk() for _ in upto(0, 3)]
    body = []
    if r.random() < 0.9:
        head = f"<h1>{kept(title)}</h1>"
        body.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
    if r.random() < 0.3:
        first = f"{title} {prose()}"
        body.append(f"<p><b>{kept(first)}<br>")
    for _ in upto(1, 14):
        k = r.random()
        if k < 0.74:
            body.append(f"<p>{'<b>' if r.random() < 0.1 else ''}{kept(prose())}" + ("</p>" if r.random() < 0.9 else ""))
        elif k < 0.8:
            body.append(f"<h{(n := r.randrange(2, 5))}>{kept(words(1, 6))}</h{n}>")
        elif k < 0.85:
            body.append("<ul>" + "".join(f"<li>{kept(sentence())}</li>" for _ in upto(2, 5)) + "</ul>")
        elif k < 0.88:
            body.append(f"<blockquote>{kept(prose())}</blockquote>")
        elif k < 0.91:
            body.append("<table>" + "".join(f"<tr><td>{kept(words(1, 3))}</td><td>{kept(words(1, 3))}</td></tr>" for _ in upto(1, 4)) + "</table>")
        else:
            body.append(junk())
    e, marks = pick(("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' class="article-body"'), ("div", ' id="content"'), ("section", ' class="entry-content"'), ("div", ' class="post"'), ("div", ' role="main"'), ("div", ' class="story"'))
    article = f"<{e}{marks}>" + "".join(body) + f"</{e}>"
    below = [junk() for _ in upto(0, 3)]
    if r.random() < 0.3:
        below.append(comments())
    if r.random() < 0.9:
        below.append(f"<footer>{pick('&copy; ', '')}{word()}.{word()} &middot; {prose()}</footer>" if r.random() < 0.7 else f'<div class="footer">&copy; {prose()}</div>')
    middle = article if r.random() < 0.7 else f'<div class="{pick("wrapper", "container", "page", "row")}">{article}{junk() if r.random() < 0.3 else ""}</div>'
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>p{{}}</style></head><body>" + "".join(top) + middle + "".join(below) + "</body></html>", keep


_trained: dict[tuple, Labeller] = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The model for these parameters, trained at its first use in this process."""
    if (pages, epochs, seed) not in _trained:
        r = random.Random(seed)
        rows = []
        for _ in range(pages):
            page, keep = made_page(r)
            left = [" ".join(html_escapes.unescape(k).split()) for k in keep]
            found, y = blocks(page), []
            for b in found:
                hit = b.text in left
                y.append(float(hit))
                if hit:
                    left.remove(b.text)
            rows.append((np.array([vector(b) for b in found]), np.array(y, np.float32)))
        _trained[pages, epochs, seed] = Labeller(seed).fit([x for x in rows if len(x[1])], epochs)
    return _trained[pages, epochs, seed]


def main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", least: float = 0.5, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars and blocks (text, probability) of every page."""
    tune(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    kinds = dict(pages.dtypes)
    pair = pa.list_(pa.struct([("text", pa.string()), ("p", pa.float64())]))

    def run(batches):
        for b in batches:
            found = [blocks(h) for h in b.column(2).to_pylist()]
            labels = shared.value.label(found)
            texts = ["\n".join(x.text for x, p in zip(f, y, strict=True) if p >= least) for f, y in zip(found, labels, strict=True)]
            detail = [[{"text": x.text, "p": float(p)} for x, p in zip(f, y, strict=True)] for f, y in zip(found, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(detail, pair)], ["page_id", "url", "text", "n_chars", "blocks"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long, blocks array<struct<text: string, p: double>>")
