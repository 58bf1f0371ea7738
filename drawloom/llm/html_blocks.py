"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: text between block-level tags, with the path of tags and of the words in their class,
id and role attributes. A bidirectional LSTM, trained in numpy, reads for each block the hashed path (its leaf counts
more), hashed words and a few measures, over the whole sequence of the page, and says of every block whether it belongs
to the article.

Pages carry no labels, so the training set is built from at most ``TRAIN_PAGES`` pages (least hashes of page_id) of up to
``TRAIN_CHARS``: blocks of semantic containers (article, main, nav, footer, ...) get the label that the markup states. In
varied copies of the sequences, containers get other usual names or none, and blocks of the usual boilerplate
(sidebars, notices, forms, comments, related links) made of the pages' own words are put in at random places, so the
labeller learns from names it will meet elsewhere and from the text itself.

Scripts, styles, text areas and comments are no blocks; without an end they run to the end of the page. The same holds
for noscript, template, iframe, svg, canvas and select from their tag to the matching end tag, but where that is missing
(or the tag ends in ``/>``) only the tag goes. A head ends at its end tag or at the first tag or text that cannot stand in
it. Formulas and the fallback of objects are text. Character references are decoded, white space inside a
block becomes one space, blocks are joined in page order by one space. Null, empty and malformed pages give what text
they have (none: empty); repeated rows give equal results; very long pages are read whole; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm import nets
from drawloom.llm.common import texts

TRAIN_PAGES, TRAIN_CHARS = 150, 100_000
HIDDEN, PATH_DIM, WORD_DIM, NUMBERS = 12, 12, 6, 8
PATH_BUCKETS, WORD_BUCKETS = 1 << 11, 1 << 12
EPOCHS, COPIES = 8, 8
BATCH_BLOCKS, BATCH_CHARS = 20_000, 2_000_000

#: Elements by HTML's rules (fixed values).
RAW = "script|style|textarea"
UNSEEN = frozenset("noscript template iframe svg canvas select".split())
HEAD = frozenset("base basefont bgsound link meta title noscript template noframes command".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("annotation annotation-xml maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<({RAW})(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|<[a-zA-Z/][^<>]*+>?|[^<]++|<", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Names that state a label in training.
ARTICLE = frozenset("article main".split())
CHROME = frozenset("nav header footer aside form menu button dialog".split())
CHROME_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo sidebar menu nav navigation breadcrumb breadcrumbs footer header comment comments reply cookie cookies consent notice notices popup modal newsletter subscribe signup share social related recommended widget login search toolbar skip copyright".split())
_GOOD = ("article", "main", "div.content", "div.post", "div.entry content", "section.article body", "div.main content", "div.story", "div.text", "div.page", "div.body", "section", "div")
_BAD = (
    "nav ul li", "header div", "footer", "footer div", "aside", "aside.sidebar", "aside div p", "div.sidebar", "div.sidebar ul li", "div.ad", "div.ads", "div.advert", "div.banner", "div.sponsored",
    "div.promo p", "div.cookie notice", "div.notice", "div.consent banner p", "div.popup", "div.modal p", "div.newsletter", "form", "form div", "form p", "form fieldset legend", "div.comments", "section.comments",
    "section.comments div.comment p", "div.comment", "ol.comments li", "div.comment list div p", "ul.menu li", "div.menu", "div.breadcrumbs", "div.share", "div.social", "div.related ul li", "section.related h3", "div.widget", "div.login", "div.search", "div.copyright", "header.site header", "div.header", "div.footer", "div.skip", "button", "div.subscribe p", "div.reply",
)

_LEAVES = ("p", "h2", "h3", "ul li", "ol li", "table tr td", "blockquote p", "dl dd", "pre", "figure figcaption", "div", "span", "h4", "section p")

Block = tuple[list[str], str, float]  # path parts from the root to the leaf, text, share of characters in links


def _attribute_parts(attributes: str) -> list[str]:
    return [w.lower() for m in _NAMES.finditer(attributes) for w in _PARTS.findall(m[1] or m[2] or m[3] or "")]


def _closed(tokens: list[re.Match[str]]) -> dict[int, int]:
    """Index of the end tag of each hidden element (and title) that has one."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for k, m in enumerate(tokens):
        if m[3] and ((name := m[3].lower()) in UNSEEN or name == "title"):
            waiting = open_at.setdefault(name, [])
            if not m[2]:
                if not m[4].endswith("/"):
                    waiting.append(k)
            elif waiting:
                ends[waiting.pop()] = k
    return ends


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            raw = "".join(parts)
            text = " ".join(entities.unescape(raw).split())
            if text:
                out.append(([w for name, words in stack for w in (name, *words)], text, min(1.0, links / max(1, len(raw)))))
            parts.clear()
        links = 0

    def close(names: tuple[str, ...]) -> None:
        """Closes the innermost of the named elements and all inside it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return

    tokens = list(_TOKEN.finditer(page))
    ends, skip_to, in_head = _closed(tokens), -1, False
    for k, m in enumerate(tokens):
        if k <= skip_to:
            continue
        text = m[0]
        if in_head:
            name = m[3].lower() if m[3] else ""
            if name in HEAD and not m[2]:
                skip_to = ends.get(k, k)
                continue
            if name == "head" and m[2]:
                in_head = False
                continue
            if m[2] and name not in ("body", "html", "br") or not name and (text[0] == "<" != text or not text.strip()):
                continue
            in_head = False
        if text[0] != "<" or text == "<":
            parts.append(text)
            links += len(text) * bool(in_link)
        elif m[3]:
            name = m[3].lower()
            if name in UNSEEN:
                skip_to = ends.get(k, k)
                continue
            if name == "head":
                in_head = not m[2]
                continue
            if name == "a":
                in_link = 0 if m[2] else 1
            if name in INLINE:
                continue
            flush()
            if m[2]:
                close((name,))
            elif name not in VOID:
                if name in CLOSES_P and any(x == "p" for x, _ in stack):
                    close(("p",))
                if name in SIBLING and (last := next((x for x, _ in reversed(stack) if x in SIBLING or x in ("ul", "ol", "dl", "table")), "")) in SIBLING[name].split():
                    close((last,))
                stack.append((name, _attribute_parts(m[4]) if m[4] else []))
    flush()
    return out


def stated_label(path: list[str]) -> int | None:
    """1 inside an article or main without chrome around or inside it, 0 in chrome, else unknown."""
    if any(p in CHROME or p in CHROME_WORDS for p in path):
        return 0
    return 1 if any(p in ARTICLE for p in path) else None


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def features(sequence: list[Block]) -> tuple[list[list[int]], list[int], list[list[int]], np.ndarray]:
    """Path buckets, leaf bucket, word buckets and measures of each block."""
    paths, leaves, words, numbers = [], [], [], []
    last = max(1, len(sequence) - 1)
    for k, (path, text, links) in enumerate(sequence):
        own = text.split()
        paths.append([_bucket(p, PATH_BUCKETS) for p in path] or [0])
        leaves.append(_bucket(path[-1] if path else "", PATH_BUCKETS))
        words.append([_bucket(w.lower().strip(".,;:!?"), WORD_BUCKETS) for w in own])
        stops = sum(text.count(c) for c in ".,;!?")
        numbers.append([np.log1p(len(text)) / 6, np.log1p(len(own)) / 4, links, min(1.0, stops / max(1, len(own)) * 4), float(text[-1] in ".!?"), k / last, min(1.0, len(path) / 8), float("©" in text)])
    return paths, leaves, words, np.array(numbers, np.float32).reshape(-1, NUMBERS)


def _means(table: np.ndarray, lists: list[list[int]], scale: bool = True) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Means (or sums) of table rows, the rows, and what each entry of a list counts for."""
    flat = np.fromiter((x for part in lists for x in part), np.int64)
    counts = np.array([len(part) for part in lists])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    each = counts if scale else np.ones_like(counts)
    return np.add.reduceat(table[flat], starts) / each[:, None], flat, (counts, each)


WIDE = 2 * PATH_DIM + WORD_DIM + NUMBERS


def starting_weights(seed: int = 3) -> nets.Weights:
    rng = np.random.default_rng(seed)
    w = {"path": (rng.standard_normal((PATH_BUCKETS, PATH_DIM)) * 0.2).astype(np.float32), "leaf": (rng.standard_normal((PATH_BUCKETS, PATH_DIM)) * 0.2).astype(np.float32), "word": (rng.standard_normal((WORD_BUCKETS, WORD_DIM)) * 0.1).astype(np.float32)}
    for side in "fb":
        w[f"{side}_w"], w[f"{side}_b"], w[f"{side}_u"] = nets.glorot(rng, WIDE, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32), nets.glorot(rng, HIDDEN, 4 * HIDDEN)
    return w | {"out_w": nets.glorot(rng, 2 * HIDDEN + WIDE, 1)[:, 0], "out_b": np.zeros(1, np.float32)}


def _inputs(w: nets.Weights, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Input vectors of all blocks, their places (time, page) with -1 for padding, and what the gradients need."""
    path, path_at, path_n = _means(w["path"], [p for page in pages for p in page[0]], scale=False)
    leaves = np.array([x for page in pages for x in page[1]])
    word, word_at, word_n = _means(w["word"], [p for page in pages for p in page[2]])
    x = np.concatenate([path, w["leaf"][leaves], word, np.concatenate([page[3] for page in pages])], 1).astype(np.float32)
    sizes = [len(page[1]) for page in pages]
    places, at = np.full((max(sizes), len(pages)), -1), 0
    for k, n in enumerate(sizes):
        places[:n, k] = np.arange(at, at + n)
        at += n
    return x, places, (path_at, path_n, leaves, word_at, word_n)


def _states(w: nets.Weights, x: np.ndarray, places: np.ndarray, traces: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (places >= 0).astype(np.float32)[..., None]
    seq = x[np.maximum(places, 0)]
    sides = [nets.lstm(seq @ w[f"{s}_w"] + w[f"{s}_b"], w[f"{s}_u"], mask, s == "b", traces[k] if traces else None) for k, s in enumerate("fb")]
    return np.concatenate([*sides, seq], 2), seq, mask


def gradients(w: nets.Weights, batch: tuple) -> nets.Weights:
    """Of the mean cross-entropy over the labelled blocks (labels of -1 are left out)."""
    pages, labels = batch
    x, places, (path_at, path_n, leaves, word_at, word_n) = _inputs(w, pages)
    traces: tuple[list, list] = ([], [])
    states, seq, mask = _states(w, x, places, traces)
    target = np.concatenate(labels)[np.maximum(places, 0)]
    counted = (target >= 0) * mask[..., 0]
    off = ((nets.sigmoid(states @ w["out_w"] + w["out_b"]) - target) * counted / max(1, counted.sum())).astype(np.float32)
    g: nets.Weights = {"out_w": np.tensordot(off, states, ((0, 1), (0, 1))), "out_b": off.sum(keepdims=True).reshape(1)}
    dstates = off[..., None] * w["out_w"]
    dx = dstates[..., 2 * HIDDEN :].copy()
    for k, s in enumerate("fb"):
        dproj, g[f"{s}_u"] = nets.lstm_back(dstates[..., k * HIDDEN : (k + 1) * HIDDEN], w[f"{s}_u"], mask, traces[k])
        g[f"{s}_w"], g[f"{s}_b"] = np.tensordot(seq, dproj, ((0, 1), (0, 1))), dproj.sum((0, 1))
        dx += dproj @ w[f"{s}_w"].T
    flat = np.zeros_like(x)
    real = places >= 0
    flat[places[real]] = dx[real]
    for name, at, n, a, b in (("path", path_at, path_n, 0, PATH_DIM), ("word", word_at, word_n, 2 * PATH_DIM, 2 * PATH_DIM + WORD_DIM)):
        g[name] = np.zeros_like(w[name])
        counts, each = n
        np.add.at(g[name], at, np.repeat(flat[:, a:b] / each[:, None], counts, 0))
    g["leaf"] = np.zeros_like(w["leaf"])
    np.add.at(g["leaf"], leaves, flat[:, PATH_DIM : 2 * PATH_DIM])
    return g


def _as_path(shape: str) -> list[str]:
    return shape.replace(".", " ").split()


def varied(sequence: list[Block], labels: list[int], rng: np.random.Generator, prose: list[str], scraps: list[str]) -> tuple[list[Block], list[int]]:
    """Another page of the same text: renamed containers and boilerplate put in."""
    good = _as_path(_GOOD[rng.integers(len(_GOOD))])
    rename, swap = rng.random() < 0.7, rng.random() < 0.5
    out, marks = [], []

    def any_text() -> str:
        if rng.random() < 0.6:
            sentence = prose[rng.integers(len(prose))].split()
            at = int(rng.integers(max(1, len(sentence) - 5)))
            return " ".join(sentence[at : at + int(rng.integers(3, 60))])
        return " ".join(scraps[rng.integers(len(scraps))] for _ in range(int(rng.integers(1, 8))))

    def boilerplate() -> None:
        path = ["html", "body", *(good if rng.random() < 0.4 else []), *_as_path(_BAD[rng.integers(len(_BAD))])]
        leaf = [_LEAVES[rng.integers(len(_LEAVES))]] if rng.random() < 0.5 else []
        for _ in range(int(rng.integers(1, 5))):
            out.append(([*path, *leaf], any_text(), float(rng.random() < 0.3)))
            marks.append(0)

    spots = set(rng.integers(0, len(sequence) + 1, int(rng.integers(1, 7))).tolist())
    for k, ((path, text, links), label) in enumerate(zip(sequence, labels, strict=True)):
        if k in spots:
            boilerplate()
        if rename and label == 1:
            path = [q for p in path for q in (good if p in ARTICLE else [p])]
        if label == 1 and rng.random() < 0.3:
            path = [*path[:-1], *_as_path(_LEAVES[rng.integers(len(_LEAVES))])]
        out.append((path, any_text() if swap else text, links))
        marks.append(label)
    if len(sequence) in spots:
        boilerplate()
    return out, marks


def train(pages: list[str], seed: int = 3) -> nets.Weights:
    """Weights from some pages. Pages without stated labels still lend their words."""
    rng = np.random.default_rng(seed)
    cut = [b for b in map(blocks, pages) if b]
    stated = [(b, [-1 if (x := stated_label(path)) is None else x for path, _, _ in b]) for b in cut]
    prose = [text for b, marks in stated for (_, text, _), y in zip(b, marks, strict=True) if y == 1 and len(text) > 80] or ["plain words of a page, and some more."]
    scraps = [w for b, _ in stated for _, text, _ in b for w in text.split()[:3]] or ["home", "about"]
    usable = [s for s in stated if any(y >= 0 for y in s[1])] or [([(["html", "body", "article", "p"], prose[0], 0.0)], [1])]
    sample = []
    for b, marks in usable:
        sample.append((b, marks))
        sample += [varied(b, marks, rng, prose, scraps) for _ in range(COPIES)]
    ready = sorted(((features(b), np.array(marks, np.float32)) for b, marks in sample), key=lambda s: len(s[1]))
    groups = [ready[k : k + 40] for k in range(0, len(ready), 40)]

    def batches(epoch: int) -> Iterator[tuple]:
        for k in np.random.default_rng([seed, epoch]).permutation(len(groups)):
            yield [f for f, _ in groups[k]], [y for _, y in groups[k]]

    return nets.adam(starting_weights(seed), batches, gradients, EPOCHS)


def label_pages(w: nets.Weights, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of each block of each page."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        longest, chars, group = 0, 0, []
        while order and (not group or (max(longest, len(pages[order[0]])) * (len(group) + 1) <= BATCH_BLOCKS and chars <= BATCH_CHARS)):
            group.append(order.pop(0))
            longest = len(pages[group[-1]])
            chars += sum(len(text) for _, text, _ in pages[group[-1]])
        x, places, _ = _inputs(w, [features(pages[k]) for k in group])
        states, _, _ = _states(w, x, places)
        p = nets.sigmoid(states @ w["out_w"] + w["out_b"])
        for column, k in enumerate(group):
            out[k] = p[: len(pages[k]), column]
    return out


def train_on(pages: DataFrame) -> nets.Weights:
    """The bounded sample goes to the driver, the whole table does not."""
    rows = pages.select("page_id", "html").filter("page_id is not null").filter(F.char_length("html").between(1, TRAIN_CHARS))
    chosen = rows.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES)
    sample = rows.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()  # at most TRAIN_PAGES rows
    return train([r.html for r in sorted(sample, key=repr)])


def extract(pages: DataFrame, weights: nets.Weights, threshold: float = 0.5) -> DataFrame:
    """page_id, url, the article's text, and counts of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch, "html")
            found, kept, sizes = [], [], []
            for k in range(0, len(whole), 200):
                cut = [blocks(h) for h in whole[k : k + 200]]
                for page, p in zip(cut, label_pages(weights, cut), strict=True):
                    own = [text for (_, text, _), x in zip(page, p, strict=True) if x >= threshold]
                    found.append(" ".join(own))
                    kept.append(len(own))
                    sizes.append(len(page))
            if whole:
                columns = [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(found, pa.string()), pa.array(kept, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_kept", "n_blocks"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_kept long, n_blocks long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_kept", "n_blocks")
