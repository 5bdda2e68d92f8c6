"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks: runs of text between block-level tags.
A block is described by its tag path (tags and class or id words on the way down, each
hashed to a place of a vector), by all its words (case and marks aside, hashed likewise,
as shares of their number, a little less in short blocks) and by a few shares. A
bidirectional LSTM in numpy reads a page's whole sequence both ways, so that every
block is judged in the context of all others, and each block is kept or dropped.

The labeller is trained on the driver from pages that ``example_page`` lays out by
rule from a seed: articles of all kinds among menus, headers, footers, sidebars,
notices, adverts, forms and comments, with random words and, among what is not main
text, the phrases of PHRASES, which also stand without a telling tag or class. Its
weights, some seventy thousand numbers, travel with the tasks. Pages are labelled side by
side, as many as BLOCKS_AT_ONCE allows at the length of the longest.

Defined results: a null or empty page, or one without main text, gives the empty text;
scripts, styles, markup and comments in the markup are never text; character
references are decoded; unclosed and stray tags are tolerated; long pages are read
whole; repeated rows give repeated rows; an empty table gives an empty table; further
columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

HIDDEN = 12
PATH_DIM = 509  # a prime, so that names which hash alike in their low bits stay apart
WORD_DIM = 251
EXTRA_DIM = 6
INPUT_DIM = PATH_DIM + WORD_DIM + EXTRA_DIM
PAGES_AT_ONCE = 256
BLOCKS_AT_ONCE = 1 << 13

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Za-z]+")
MARKS = ".,:;!?%*#$&|()[]\"'"
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _place(name: str, dim: int) -> int:
    h = 2166136261
    for c in name.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % dim


@lru_cache(maxsize=100_000)
def path_place(name: str) -> int:
    return _place(name, PATH_DIM)


@lru_cache(maxsize=200_000)
def word_place(word: str) -> int:
    return _place(word.strip(MARKS).lower(), WORD_DIM)


class Block:
    __slots__ = ("text", "path", "linked", "top")

    def __init__(self, text: str, path: tuple[str, ...], linked: int, top: str):
        self.text, self.path, self.linked, self.top = text, path, linked, top


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order: white space folded, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # each open tag with the names on the way down to it
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()  # tags of RAW without an end from here on
    parts: list[str] = []
    linked = in_link = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                top, names = stack[-1] if stack else ("", ())
                out.append(Block(text, names, min(linked, len(text)), top))
            parts.clear()
        linked = 0

    at = 0
    while (m := TOKEN.match(page, at)) is not None:
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if not m.group().startswith(("<!", "<?")):
                parts.append(m.group())
                linked += in_link * len(m.group())
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                close()
                while opened[tag]:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == tag:
                        break
        elif tag in RAW:
            if tag not in unclosed and not m.group().endswith("/>"):
                end = re.compile(f"</{tag}", re.I).search(page, at)
                if end is not None:
                    at = end.start()
                else:
                    unclosed.add(tag)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            close()
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                opened[stack.pop()[0]] -= 1
            if tag not in VOID:
                own = [tag]
                for a in ATTRIBUTE.findall(m.group(3)) if m.group(3) else ():
                    own += [f".{n.lower()}" for n in NAME.findall("".join(a))]
                names = stack[-1][1] if stack else ()
                if more := tuple(n for n in dict.fromkeys(own) if n not in names):
                    names += more
                stack.append((tag, names))
                opened[tag] += 1
    close()
    return out


def block_features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT_DIM), np.float32)
    for i, b in enumerate(blocks):
        for n in b.path:
            x[i, path_place(n)] = 1
        words = b.text.split(" ")
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(list(map(word_place, words)), minlength=WORD_DIM) * (3.0 / (len(words) + 6))
        size = len(b.text)
        x[i, -EXTRA_DIM:] = (min(size, 1000) / 500, b.linked / size, b.top in ("p", "pre", "blockquote"), b.top in ("li", "td", "th"), b.top[:1] == "h" and b.top[1:].isdigit(), 1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x, mask, w, u, keep: list | None = None):
    """Hidden states of one direction over (time, page) inputs already projected by w's bias and input part."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = x[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tanh = np.tanh(new)
        on = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, tanh, on))
        c = np.where(on, new, c)
        h = np.where(on, o * tanh, h)
        out[t] = h
    return out


def _back(grad, u, kept):
    """Gradients at the gates of every step, and of the recurrent weights."""
    steps = len(kept)
    dz_all = np.zeros((*grad.shape[:2], 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros(grad.shape[1:], np.float32), np.zeros(grad.shape[1:], np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh, on = kept[t]
        dh = dh + grad[t]
        live = dh * on
        dnew = dc * on + live * o * (1 - tanh * tanh)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - g * g)], 1)
        dz_all[t] = dz
        du += h.T @ dz
        dh = np.where(on, dz @ u.T, dh)
        dc = np.where(on, dnew * f, dc)
    return dz_all, du


class Labeller:
    """Weights: for each direction input, recurrent and bias; then the output row."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {}
        for d in "fb":
            w |= {f"{d}x": make(INPUT_DIM, 4 * HIDDEN), f"{d}h": make(HIDDEN, 4 * HIDDEN), f"{d}o": np.zeros(4 * HIDDEN, np.float32)}
            w[f"{d}o"][HIDDEN : 2 * HIDDEN] = 1
            w[f"{d}x"][PATH_DIM : PATH_DIM + WORD_DIM] = 0  # words that training never met say nothing
        return cls(w | {"out": make(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)})

    def forward(self, pages: list[np.ndarray], keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(logits, mask) by (time, page); the second direction reads each page from its end."""
        w, lens = self.w, np.array([len(p) for p in pages])
        steps = int(lens.max(initial=0))
        x = np.zeros((steps, len(pages), INPUT_DIM), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        mask = np.arange(steps)[:, None] < lens
        flip = np.where(mask, lens - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        cols = np.arange(len(pages))
        turned = x[flip, cols]
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        ahead = _run(x @ w["fx"] + w["fo"], mask, None, w["fh"], kept["f"])
        behind = _run(turned @ w["bx"] + w["bo"], mask, None, w["bh"], kept["b"])[flip, cols]
        both = np.concatenate([ahead, behind], 2)
        if keep is not None:
            keep |= {"x": x, "turned": turned, "flip": flip, "cols": cols, "both": both, **kept}
        return (both @ w["out"])[:, :, 0] + w["bias"], mask

    def gradients(self, pages, labels) -> dict[str, np.ndarray]:
        keep: dict = {}
        logits, mask = self.forward(pages, keep)
        gold = np.zeros(logits.shape, np.float32)
        for k, y in enumerate(labels):
            gold[: len(y), k] = y
        d = np.where(mask, _sigmoid(logits) - gold, 0)[:, :, None] / max(1, mask.sum())
        w, g = self.w, {}
        g["out"], g["bias"] = (keep["both"] * d).sum((0, 1))[:, None], d.sum((0, 1))
        dboth = d * w["out"][:, 0]
        for name, part, x in (("f", dboth[:, :, :HIDDEN], keep["x"]), ("b", dboth[:, :, HIDDEN:][keep["flip"], keep["cols"]], keep["turned"])):
            dz, g[f"{name}h"] = _back(part.astype(np.float32), w[f"{name}h"], keep[name])
            g[f"{name}x"] = np.tensordot(x, dz, ((0, 1), (0, 1)))
            g[f"{name}o"] = dz.sum((0, 1))
        return g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        b = 0
        while b < len(order):
            some = order[b : b + 1]
            while len(some) < PAGES_AT_ONCE and b + len(some) < len(order) and (len(some) + 1) * len(pages[order[b + len(some)]]) <= BLOCKS_AT_ONCE:
                some.append(order[b + len(some)])
            b += len(some)
            logits, _ = self.forward([pages[k] for k in some])
            for i, k in enumerate(some):
                out[k] = logits[: len(pages[k]), i] > 0
        return out


MAIN = ["article", "main", 'div class="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'div id="story"', 'section class="text"', 'div class="main-content"', 'div role="main"', 'div class="post-body"']
PLAIN = ["div", 'div class="wrapper"', 'div class="container"', 'div class="col"', 'div class="page"', 'div class="inner"', "section"]
ASIDES = {
    "menu": ["nav", 'div class="menu"', 'ul class="nav"', 'div class="breadcrumb"', 'div id="navigation"', 'div class="navbar"', 'div class="pagination"', 'div class="toc"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="topbar"', 'div class="site-header"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div class="site-footer"'],
    "side": ["aside", 'div class="sidebar"', 'div class="related"', 'div class="widget"', 'div class="recommended"', 'div id="sidebar"', 'section class="more-stories"'],
    "notice": ['div class="notice"', 'div class="cookie-notice"', 'div class="cookie-banner"', 'div class="alert"', 'div class="consent"', 'div class="newsletter"', 'div class="subscribe"', 'div role="alert"', 'div class="popup"', 'div class="disclaimer"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="banner"', 'div class="promo"', 'div class="sponsored"', 'section class="sponsor"'],
    "form": ["form", 'form class="search"', 'div class="login"', 'div class="signup"', 'fieldset class="contact"', 'div class="social"', 'div class="share"'],
    "comments": ['div class="comments"', 'section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="comment"', 'div class="responses"', 'section id="discussion"', 'div class="reply"'],
}
# What such blocks often say; a block takes some of them.
PHRASES = {
    "menu": ["Home", "About us", "Contact", "Skip to content", "Next page", "Previous page", "Back to top", "All categories", "Archive", "Sign in", "Search"],
    "header": ["Welcome to our website", "Sign in", "Register", "Menu", "Search this site", "Subscribe"],
    "footer": ["All rights reserved", "Copyright", "Privacy policy", "Terms of use", "Contact us", "Imprint", "Powered by", "Cookie settings"],
    "side": ["Related articles", "You may also like", "Most read", "Popular posts", "Recent posts", "Recommended for you", "Trending now", "Read more"],
    "notice": ["We use cookies", "Accept all cookies to go on", "This website uses cookies", "Manage your cookie preferences", "By using this site you agree", "Sign up for our newsletter", "Subscribe now", "Please enable JavaScript", "Accept all", "Reject all"],
    "ad": ["Advertisement", "Sponsored content", "Buy now", "Shop now", "Special offer", "Click here", "Limited time offer", "Free shipping", "Save now"],
    "form": ["Your email address", "Password", "Submit", "Log in", "Sign up", "Send", "Enter your name", "Share this", "Follow us", "Required field"],
    "comments": ["Leave a comment", "Reply", "Comments", "Log in to comment", "Report", "Posted by", "says"],
}
# Common words, which every kind of text holds.
COMMON = "the of and to in a that is for it by this with as on from you your our us we are be at or not more all new now read was de la le el que en un una et les des du die der und das ist ein zu von".split()
MARK = "\x02"  # stands before every main block's text in an example


def example_page(rng: random.Random) -> str:
    """A page laid out by rule; main blocks' texts begin with MARK."""
    letters = "aeiounrtslhdcmpgbfvwyzkjxqéèüñçß"
    word = lambda: (rng.choice(COMMON) if rng.random() < 0.3 else "".join(rng.choices(letters, k=rng.randint(1, 11)))) + rng.choice(["", "", "", "", ",", " |", "%%%", "!!", ";"])
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", "", "!"])

    def wrap(tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def side(kind: str, outside: bool = True) -> str:
        if outside and rng.random() < 0.15:
            said = ". ".join(rng.sample(PHRASES[kind], rng.randint(2, 4)))
            return wrap(rng.choice(["p", "div", "p", "div class=\"row\""]), said + rng.choice([".", ""]))
        tag = ASIDES[kind][0] if rng.random() < 0.35 else rng.choice(ASIDES[kind])
        links = lambda: "<ul>" + "".join(f'<li><a href="/x">{say(1, 4)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"
        plain = lambda: "".join(wrap(rng.choice(["p", "div", "span"]), say(2, 30)) for _ in range(rng.randint(1, 3)))
        title = wrap(rng.choice(["h2", "h3", "h4"]), say(1, 4)) if rng.random() < 0.4 else ""
        if kind == "form":
            inner = f"<label>{say(1, 3)}</label><input><button>{say(1, 2)}</button>" + (plain() if rng.random() < 0.3 else "")
        elif kind == "comments":
            inner = "".join(wrap(rng.choice(["p", "li", 'div class="comment"']), say(4, 60)) for _ in range(rng.randint(1, 5)))
        elif kind == "menu":
            inner = links()
        elif kind in ("footer", "ad", "notice") and rng.random() < 0.6:
            inner = say(3, 25) if rng.random() < 0.7 else ". ".join(rng.sample(PHRASES[kind], rng.randint(1, 3)))
        else:
            inner = rng.choice([links, plain])()
        return wrap(tag, title + inner)

    def body() -> str:
        out = []
        if rng.random() < 0.8:
            h1 = f"<h1>{MARK}{say(2, 10)}</h1>"
            out.append(f"<header>{h1}</header>" if rng.random() < 0.1 else h1)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 25])):
            r, m = rng.random(), MARK
            if r < 0.62:
                out.append(f"<p>{m}{say(3, 70)}</p>")
            elif r < 0.7:
                out.append(f"<p>{m}<b>{say(1, 12)}<br>")
            elif r < 0.78:
                out.append(f"<h2>{m}{say(1, 6)}</h2>")
            elif r < 0.83:
                out.append("<ul>" + "".join(f"<li>{m}{say(2, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.87:
                out.append(wrap(rng.choice(["blockquote", "pre", "div"]), m + say(3, 40)))
            elif r < 0.9:
                out.append("<table><tr>" + "".join(f"<td>{m}{say(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif r < 0.92:
                out.append(f'<p>{m}<a href="/y">{say(2, 8)}</a> {say(1, 9)}</p>')
            else:
                out.append(side(rng.choice(["side", "ad", "notice", "form", "comments"]), False))
        if rng.random() < 0.25:
            out.append(side("comments", False))
        return "".join(out)

    main = wrap(rng.choice(PLAIN if rng.random() < 0.1 else MAIN), body())
    if rng.random() < 0.3:
        main = wrap(rng.choice(["div", "main", 'div class="wrapper"', 'div class="container"', 'div id="page"']), main)
    before = "".join(side(rng.choice(["menu", "menu", "header", "ad", "notice", "side", "form"])) for _ in range(rng.randint(0, 4)))
    after = "".join(side(rng.choice(["footer", "footer", "comments", "side", "ad", "menu", "notice", "form"])) for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.05:
        main = ""
    return f"<html><head><title>{say(1, 6)}</title></head><body>{before}{main}{after}</body></html>"


@lru_cache(maxsize=2)
def train(pages: int = 1600, rounds: int = 14, rate: float = 0.01, seed: int = 5) -> Labeller:
    """A labeller fitted to example pages by Adam on their block labels."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        blocks = leaf_blocks(example_page(rng))
        y = np.array([b.text.startswith(MARK) for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(MARK, "").strip() or "x"
        if blocks:
            xs.append(block_features(blocks))
            ys.append(y)
    order = sorted(range(len(xs)), key=lambda k: len(xs[k]))
    batches = [order[b : b + 30] for b in range(0, len(order), 30)]
    model = Labeller.fresh()
    first, second, n = {k: 0.0 for k in model.w}, {k: 0.0 for k in model.w}, 0
    for turn in range(rounds):
        rng.shuffle(batches)
        for batch in batches:
            n += 1
            for k, g in model.gradients([xs[i] for i in batch], [ys[i] for i in batch]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = rate * (0.3 if turn > rounds * 2 // 3 else 1)
                fade = np.full((model.w[k].shape[0],) + (1,) * (model.w[k].ndim - 1), 0.01)
                if k in ("fx", "bx"):  # most words are noise: what does not recur fades
                    fade[PATH_DIM : PATH_DIM + WORD_DIM] = 1.0
                model.w[k] = (model.w[k] * (1 - fade * step) - step * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    kept = model.label([block_features(b) for b in blocks])
    return [" ".join(x.text for x, k in zip(b, keep, strict=True) if k) for b, keep in zip(blocks, kept, strict=True)]


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keys..., text, n_chars) of every page."""
    model = train()
    schema = T.StructType([*(T.StructField(k, pages.schema[k].dataType) for k in keys), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 4 * PAGES_AT_ONCE):
                part = batch.slice(b, 4 * PAGES_AT_ONCE)
                texts = main_texts([p or "" for p in part.column(html_col).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return pages.select(*keys, html_col).mapInArrow(task, schema)
