"""Main-text extraction from web pages with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the starts and ends of block-level
elements. Each block becomes a vector of its hashed tag path (tags, classes and ids of all
ancestors), its hashed words and a few numbers (length, share of linked text, ...). A numpy
bidirectional LSTM reads the whole sequence of a page's blocks and gives each the probability
that it belongs to the article; blocks of at least one half are the main text.

The network is trained here, on the driver, from a fixed number of generated pages of many
layouts, whose blocks are known, and at most ``sample`` pages of the table (those with the
smallest hashes of their ids, among those of under ``longest`` characters; of several rows of one
id, the one with the smallest hash) labelled by their own markup; all pages are then extracted with
it. Scripts, styles and comments in the markup are no text. Character references are decoded,
white space inside a block becomes one space, and blocks are joined in page order by an empty
line. Null and empty pages, and pages without article text, have the empty text. Whole pages are
read, whatever their length. Repeated rows get equal results; other columns are ignored, and those
with the result's names are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import appended, lean, word_hashes

# Elements by their role in HTML.
BLOCK_TAGS = frozenset("html head body title address article aside blockquote canvas dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul button label legend option select textarea center".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe svg textarea".split())
CLOSES_P = BLOCK_TAGS - frozenset("html head body title button label option".split())

PATH_DIMS, WORD_DIMS = 160, 32
DIMS = PATH_DIMS + WORD_DIMS + 8
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """A leaf block: decoded text with single spaces, names of its ancestors, linked characters."""

    text: str
    path: tuple[str, ...]
    linked: int = 0


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                out.append(Block(text, path, min(linked, len(text))))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, path
        if text:
            if not held or text.isspace():
                path = tuple(n for _, names in stack for n in names) if not held else path
            held.append(text)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            held.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "body", "nav", "footer", "aside", "header", "main", "section") and tag not in BLOCK_TAGS:
                    break
            continue
        if tag in RAW_TAGS and not m[3].rstrip().endswith("/"):
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        if tag == "li":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "li":
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "menu"):
                    break
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            names = [tag]
            if m[3] and "=" in m[3]:
                for x in _NAMES.finditer(m[3]):
                    names += [f".{w}" for w in _SPLIT.split((x[1] or x[2] or x[3] or "").lower()) if w]
            stack.append((tag, tuple(names)))
    flush()
    return out


def _slot(name: str, dims: int) -> int:
    return zlib.crc32(name.encode()) % dims


def vectors(found: list[Block]) -> np.ndarray:
    """One row for each block."""
    x = np.zeros((len(found), DIMS), np.float32)
    slots: dict[tuple[str, ...], np.ndarray] = {}
    for i, b in enumerate(found):
        if b.path not in slots:
            tags = [n for n in b.path if n[0] != "."]
            names = set(b.path) | {f"last {t}" for t in tags[-1:]}
            slots[b.path] = np.array([_slot(n, PATH_DIMS) for n in names], np.int64)
        x[i, slots[b.path]] = 1
    if found:
        words, rows = word_hashes(pa.array([b.text for b in found], pa.string()))
        owner = np.repeat(np.arange(len(found)), np.diff(rows))
        np.add.at(x, (owner, PATH_DIMS + (words % np.uint64(WORD_DIMS)).astype(np.int64)), 1)
        part = x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
        size = np.array([len(b.text) for b in found], np.float32)
        x[:, -8] = np.log1p(size) / 8
        x[:, -7] = np.array([b.linked for b in found], np.float32) / size
        x[:, -6] = np.log1p(np.diff(rows)) / 6
        x[:, -5] = [sum(b.text.count(c) for c in ".!?") / len(b.text) * 20 for b in found]
        x[:, -4] = [b.text[-1] in ".!?" for b in found]
        x[:, -3] = np.arange(len(found)) == 0
        x[:, -2] = [len(set(b.path)) / 16 for b in found]
        x[:, -1] = 1
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """A bidirectional LSTM with a logistic output."""

    hidden: int = 16
    weights: dict = field(default_factory=dict)

    def start(self, seed: int) -> None:
        r, n = np.random.default_rng(seed), self.hidden
        for d in "fb":
            self.weights[f"x{d}"] = (r.standard_normal((DIMS, 4 * n)) * 0.15).astype(np.float32)
            self.weights[f"h{d}"] = (r.standard_normal((n, 4 * n)) / np.sqrt(n) * 0.7).astype(np.float32)
            self.weights[f"c{d}"] = np.concatenate([np.zeros(n), np.ones(n), np.zeros(2 * n)]).astype(np.float32)
        self.weights["o"] = (r.standard_normal(2 * n) * 0.3).astype(np.float32)
        self.weights["p"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; x: time, page, feature."""
        n, w = self.hidden, self.weights
        steps, pages = mask.shape
        gates_in = x @ w[f"x{d}"] + w[f"c{d}"]
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out = np.zeros((steps, pages, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates_in[t] + h @ w[f"h{d}"]
            i, f, o = _sigmoid(g[:, :n]), _sigmoid(g[:, n : 2 * n]), _sigmoid(g[:, 2 * n : 3 * n])
            z = np.tanh(g[:, 3 * n :])
            m = mask[t][:, None]
            c_new = f * c + i * z
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, i, f, o, z, tc, c, h, m))
            c, h = m * c_new + (1 - m) * c, m * o * tc + (1 - m) * h
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities by time and page."""
        parts = []
        for d in "fb":
            held = [] if keep is not None else None
            parts.append(self._run(x, mask, d, held))
            if keep is not None:
                keep[d] = held
        h = np.concatenate(parts, axis=2)
        if keep is not None:
            keep["h"] = h
        return _sigmoid(h @ self.weights["o"] + self.weights["p"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross-entropy over real blocks, by backpropagation through time."""
        n, keep = self.hidden, {}
        p = self.forward(x, mask, keep)
        ds = (p - y) * mask / mask.sum()
        g = {"o": (ds[:, :, None] * keep["h"]).sum(axis=(0, 1)), "p": np.array([ds.sum()])}
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            wh = self.weights[f"h{d}"]
            dh = np.zeros((mask.shape[1], n), np.float32)
            dc = np.zeros_like(dh)
            dgates = np.zeros((*mask.shape, 4 * n), np.float32)
            gh = np.zeros_like(wh)
            for t, i, f, o, z, tc, c0, h0, m in reversed(keep[d]):
                dh = dh + ds[t][:, None] * self.weights["o"][part]
                do, dcn = dh * m * tc, dh * m * o * (1 - tc * tc) + dc * m
                dg = np.concatenate([dcn * z * i * (1 - i), dcn * c0 * f * (1 - f), do * o * (1 - o), dcn * i * (1 - z * z)], axis=1)
                dgates[t] = dg
                gh += h0.T @ dg
                dh, dc = dh * (1 - m) + dg @ wh.T, dcn * f + dc * (1 - m)
            g[f"h{d}"], g[f"c{d}"] = gh, dgates.sum(axis=(0, 1))
            g[f"x{d}"] = np.tensordot(x, dgates, axes=([0, 1], [0, 1]))
        return g

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, size: int = 24, rate: float = 0.02, seed: int = 7) -> None:
        self.start(seed)
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        t = 0
        for epoch in range(epochs):
            order = np.argsort([len(y) + r.random() * 8 for _, y in data], kind="stable")
            groups = [order[i : i + size] for i in range(0, len(order), size)]
            for k in r.permutation(len(groups)):
                x, mask, y = stacked([data[i] for i in groups[k]])
                t += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.weights[name] -= (rate * (1 - epoch / epochs) * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def judge(self, pages: list[np.ndarray], size: int = 256) -> list[np.ndarray]:
        """The probabilities of each page's blocks; pages of like length are read together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and len(group) < size and len(pages[order[at + len(group)]]) * (len(group) + 1) <= 1 << 15:
                group.append(order[at + len(group)])
            x, mask, _ = stacked([(pages[i], np.zeros(len(pages[i]))) for i in group])
            p = self.forward(x, mask)
            for k, i in enumerate(group):
                out[i] = p[: len(pages[i]), k]
            at += len(group)
        return out


def stacked(data: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages padded to the longest: features, mask and labels by time and page."""
    steps = max(len(y) for _, y in data)
    x = np.zeros((steps, len(data), DIMS), np.float32)
    mask, y = np.zeros((steps, len(data)), np.float32), np.zeros((steps, len(data)), np.float32)
    for k, (a, b) in enumerate(data):
        x[: len(b), k], mask[: len(b), k], y[: len(b), k] = a, 1, b
    return x, mask, y


# Names that sites give to their parts.
SIDE_TAGS = {"nav": "menu", "aside": "side", "footer": "foot", "form": "form", "header": "top", "button": "form", "select": "form", "fieldset": "form", "menu": "menu"}
SIDE_NAMES = frozenset("nav navbar menu breadcrumb breadcrumbs header masthead topbar banner footer sidebar side rail widget related recommended ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe signup login share social comment comments reply replies respond disqus discussion form search pagination pager tags copyright".split())
MAIN_NAMES = "content article post entry story main body text".split()


def by_markup(found: list[Block]) -> list[int] | None:
    """Labels of a page's blocks from its own markup; None if it doesn't say what the article is."""
    labels = []
    for b in found:
        inside = max((i for i, n in enumerate(b.path) if n in ("article", "main")), default=-1)
        rest = b.path[inside + 1 :]
        labels.append(int(inside >= 0 and "head" not in b.path and not any(n in SIDE_TAGS or n[1:] in SIDE_NAMES for n in rest)))
    return labels if any(labels) else None


def _generated(seed: int) -> tuple[str, set[str]]:
    """A page of a random layout and the texts of its article's blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re", "st", "le", "de", "ch", "ie", "os", "ra", "é", "ü"]) for _ in range(r.randint(1, 4)))
    main: set[str] = set()
    seen = [0]

    def words(low: int, high: int) -> str:
        seen[0] += 1
        body = [word() for _ in range(r.randint(low, high))]
        body[r.randrange(len(body))] += f"{seen[0]}x"
        return (" ".join(body)).capitalize() + r.choice([".", ".", "", "!", "***", "!!"])

    def article(tag: str, low: int, high: int) -> str:
        text = words(low, high)
        main.add(text)
        return f"<{tag}>{text}</{tag}>" if r.random() < 0.8 else f"<{tag}><b>{text}</b><br>"

    def links(tag: str) -> str:
        return f"<{tag}><ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(r.randint(2, 8))) + f"</ul></{tag}>"

    def named(names: list[str], tag: str = "div") -> tuple[str, str]:
        kind = r.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{r.choice(names)}">', f"</{tag}>"

    def side(names: list[str], low: int = 2, high: int = 25, tag: str = "div") -> str:
        a, b = named(names, tag)
        inner = r.choice(["{}", "<p>{}</p>", "<p>{}</p><p>{}</p>", "<h3>{}</h3><p>{}</p>"])
        return a + inner.replace("{}", "\0").replace("\0", words(low, high), 1).replace("\0", words(low, high), 1) + b

    top = [links("nav"), "<header>" + r.choice(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>"]).format(words(1, 5)) + (links("nav") if r.random() < 0.5 else "") + "</header>", side(["ad", "ads", "advert", "sponsored", "ad-banner"]), side(["cookie-notice", "notice", "alert", "consent", "banner"]), side(["menu", "navbar", "breadcrumbs", "topbar"], 1, 6)]
    bottom = ["<footer>" + r.choice(["{}", "<p>{}</p>", "&copy; {} &middot; more"]).format(words(2, 12)) + "</footer>", side(["footer", "copyright"], 2, 12), side(["related", "recommended"], 2, 12, "section"), side(["comments", "comment", "replies", "discussion"], 5, 40, "section"), side(["ad", "promo", "newsletter"], 3, 20), "<aside>" + r.choice(["<p>{}</p>", "{}", "<h3>{}</h3>"]).format(words(2, 30)) + "</aside>", side(["sidebar", "widget", "rail"], 2, 30), f"<form><label>{words(1, 4)}</label><input><button>{words(1, 2)}</button></form>"]
    inner = [side(["ad", "advert", "share", "related"]), side(["comment-list", "comments", "reply"], 5, 40), f"<form><label>{words(1, 3)}</label><button>{words(1, 2)}</button></form>", "<aside><p>" + words(3, 20) + "</p></aside>", side(["notice", "newsletter"], 3, 20)]
    body = [article("h1", 2, 10)] * (r.random() < 0.8)
    for _ in range(r.randint(0, 12)):
        body.append(article(r.choice(["p"] * 6 + ["h2", "blockquote", "li", "pre"]), r.choice([1, 3, 20]), r.choice([25, 80])))
        if r.random() < 0.12:
            body.append(r.choice(inner))
    a, b = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), named([r.choice(MAIN_NAMES) + r.choice(["", "-body", "-content"])]), named(MAIN_NAMES, "section")])
    if r.random() < 0.15:
        a, b = f'<div id="wrapper"><div class="container">{a}', f"{b}</div></div>"
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    parts = r.sample(top, r.randint(0, 4)), r.sample(bottom, r.randint(0, 5))
    return head + "".join(parts[0]) + a + "".join(body) + b + "".join(parts[1]) + "</body></html>", main


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 256, generated: int = 900, longest: int = 40000) -> Labeller:
    """The labeller, from generated pages and at most ``sample`` pages of the table."""
    data = []
    for seed in range(generated):
        text, main = _generated(seed)
        found = blocks(text)
        if found:
            data.append((vectors(found), np.array([b.text in main for b in found], np.float32)))
    chosen = pages.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    # the sample has a fixed bound, and so has its broadcast
    every = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h")).filter(F.length("h") < longest)
    rows = every.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("h", F.xxhash64("h")).alias("h"))
    for row in sorted(rows.collect(), key=lambda x: (str(x.id), x.h)):
        found = blocks(row.h)
        labels = by_markup(found) if found else None
        if labels is not None:
            data.append((vectors(found), np.array(labels, np.float32)))
    own = Labeller()
    own.fit(data)
    return own


def extract(pages: DataFrame, labeller: Labeller, html_col: str = "html") -> DataFrame:
    """The pages with text (the article) and n_blocks (blocks judged); html itself is left out."""
    held = pages.sparkSession.sparkContext.broadcast(labeller)
    kept = appended(pages, "text", "n_blocks", html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [blocks(h or "") for h in part.column(part.schema.get_field_index(html_col)).to_pylist()]
                scores = held.value.judge([vectors(b) for b in found])
                texts = ["\n\n".join(b.text for b, p in zip(bs, ps, strict=True) if p >= 0.5) for bs, ps in zip(found, scores, strict=True)]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(b) for b in found], pa.int32())], [*kept, "text", "n_blocks"])

    return pages.mapInArrow(lean(run), "".join(f"{x}, " for x in kept.values()) + "text string, n_blocks int")


def op5_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
