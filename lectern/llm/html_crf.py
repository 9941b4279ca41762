"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: runs of text between block-level tags. Features
of a block are the tags, classes and ids above it and simple properties of its
text. The field has two labels (article or not), is trained by maximum likelihood
(forward-backward, full batches, Adam, in numpy) on labelled pages, and a page's
labels are decoded by Viterbi. ``training_pages`` makes the labelled pages: layouts
of many kinds whose parts are known by construction.

A null or empty page, or one without an article, has the empty text. Markup may be
broken: an end tag closes the nearest open element of its name or nothing, and an
unclosed comment, script or style runs to the end of the page. Other columns are
never read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Element names, as HTML has them.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul button input label textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "math", "object")
#: A start tag of the key ends open elements of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: What closes a quoted value: the tag's end, or names of further attributes up to one with a value or the tag's end.
CLOSED = r"(?=\s*(?:[^\s\"'<>/=]+\s*)*(?:=|/?>|\Z))"
#: A tag's attributes; a quote that opens no closed value is a character like others, and so an unclosed value ends with the tag.
ATTRIBUTES = rf"(?:[^=<>]++|=\s*+(?:\"[^\"]*\"{CLOSED}|'[^']*'{CLOSED}|[^\s<>]*+))*+"
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # an element of raw text up to its end tag; a slash does not close it if its end tag comes before the next such element
    rf"|<({'|'.join(RAW)})\b(?:(?P<slash>{ATTRIBUTES}(?<=/)>(?:(?:(?!<(?P=raw)\b).)*?</(?P=raw)\s*>)?)|{ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z))".replace("<(", "<(?P<raw>", 1)
    + rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>{ATTRIBUTES})(?:>|\Z|(?=<))"
    r"|<[!?/][^>]*(?:>|\Z)|<|[^<]+",
    re.S | re.I,
)
NAMED = re.compile(r"(?:\s|^)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[\W_]+|(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")  # of Unicode
CUES = re.compile(r"©|\(c\)|copyright|all rights|cookie|subscri|newsletter|sign (?:in|up)|log ?in|advert|sponsor|privacy|share|repl(?:y|ies)|comment|posted by|related|read more|next|previous|home\b", re.I)


@dataclass
class Block:
    above: tuple[str, ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks with any text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked, in_link = 0, 0

    def end() -> None:
        nonlocal linked
        if held:
            text = SPACES.sub(" ", html.unescape("".join(held))).strip(" ")
            if text:
                out.append(Block(tuple(key for _, key in stack), text, linked))
            held.clear()
            linked = 0

    for m in PIECE.finditer(page):
        name = m["name"]
        if name is None:
            if m["raw"] is None and not (whole := m[0]).startswith(("<!", "<?", "</")):
                held.append(whole)
                linked += len(whole) if in_link else 0
            continue
        name = name.lower()
        if name in BLOCKS:
            end()
        if m["end"]:
            if any(x == name for x, _ in stack):
                while True:
                    x, _ = stack.pop()
                    in_link -= x == "a"
                    if x == name:
                        break
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            while stack and stack[-1][0] in ("b", "i", "em", "strong", "span", "u", "font") and name != "br":
                stack.pop()
            if stack and stack[-1][0] == "p":
                stack.pop()
            closes = CLOSES.get(name)
            if closes and stack and stack[-1][0] in closes:
                stack.pop()
        keys = [f"<{name}>"]
        if m["attributes"]:
            for a in NAMED.finditer(m["attributes"]):
                keys += [x.lower() for x in SPLIT.split(a[2] or a[3] or a[4] or "") if x and not x.isdigit()]
        if not m["attributes"].endswith("/"):
            stack.append((name, " ".join(keys)))
            in_link += name == "a"
    end()
    return out


def text_features(b: Block) -> tuple[str, ...]:
    words = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    last = b.text[-1]
    return (
        f"words:{0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 30 else 4}",
        f"links:{0 if share == 0 else 1 if share < 0.5 else 2}",
        f"stop:{last in '.!?…:;”\"'}",
        f"cue:{bool(CUES.search(b.text)) and words < 30}",
        f"commas:{min(b.text.count(','), 2)}",
    )


def above_features(above: tuple[str, ...]) -> set[str]:
    names = {x for key in above for x in key.split(" ")}
    return names | {f"own:{above[-1].split(' ')[0]}"} if above else {"own:none"}


# --- training ---------------------------------------------------------------------------------


def training_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Pages with the labels of their leaf blocks."""
    rng = random.Random(seed)
    syllables = [a + v for a in "bdfgklmnprstvz" for v in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: say(3, 18).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    para = lambda: " ".join((say(3, 8) + ", " + sentence()) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(1, 6)))

    class Out:
        def __init__(self):
            self.html, self.labels = [], []

        def block(self, tag: str, text: str, good: bool, link: float = 0.0, attrs: str = "") -> None:
            if rng.random() < link:
                text = f'<a href="/{word()}">{text}</a>'
            elif len(text) > 40 and rng.random() < 0.2:
                text = f"{text} <b>{word()}</b> {word()} <a href='{word()}'>{word()}</a> {sentence()}"
            self.html.append(f"<{tag}{attrs}>{text}</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else f"<{tag}{attrs}>{text}")
            self.labels.append(good)

        def wrap(self, tag: str, names: list[str], fill) -> None:
            attr = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if names and (tag == "div" or rng.random() < 0.6) else ""
            self.html.append(f"<{tag}{attr}>")
            fill()
            self.html.append(f"</{tag}>")

    def menu(o: Out) -> None:
        def fill():
            o.html.append("<ul>")
            for _ in range(rng.randint(2, 7)):
                o.block("li", say(1, 3), False, 0.95)
            o.html.append("</ul>")

        o.wrap(rng.choice(["nav", "div", "nav"]), ["nav", "menu", "navbar", "main-nav", "top-menu", "breadcrumb", "breadcrumbs", "pagination", "pager"], fill)

    def header(o: Out) -> None:
        def fill():
            o.block(rng.choice(["div", "p", "h2"]), say(1, 4), False, 0.5, rng.choice(["", ' class="logo"', ' class="site-title"', ' class="tagline"']))
            if rng.random() < 0.5:
                o.block("p", say(3, 8), False)

        o.wrap(rng.choice(["header", "header", "div"]), ["header", "site-header", "masthead", "page-header", "top"], fill)

    def footer(o: Out) -> None:
        def fill():
            for _ in range(rng.randint(1, 3)):
                o.block("p", rng.choice(["&copy; ", "Copyright ", "", "All rights reserved. "]) + rng.choice([say(2, 8), sentence(), para()]), False, 0.3)

        o.wrap(rng.choice(["footer", "footer", "div"]), ["footer", "site-footer", "page-footer", "bottom", "copyright"], fill)

    def side(o: Out) -> None:
        def fill():
            o.block("h3", rng.choice(["Related", "Popular", say(1, 3)]), False)
            for _ in range(rng.randint(1, 4)):
                o.block(rng.choice(["li", "p"]), rng.choice([say(2, 8), sentence(), para()]), False, 0.5)

        o.wrap(rng.choice(["aside", "aside", "div"]), ["sidebar", "side", "widget", "related", "related-posts", "popular", "recommended", "share", "social", "tags", "author-bio"], fill)

    def notice(o: Out) -> None:
        o.wrap("div", ["cookie", "cookie-notice", "cookie-banner", "notice", "banner", "alert", "consent", "gdpr", "popup", "modal", "warning"], lambda: o.block("p", rng.choice([sentence(), para(), "We use cookies. " + sentence()]), False))

    def advert(o: Out) -> None:
        o.wrap("div", ["ad", "ads", "advert", "advertisement", "promo", "sponsored", "sponsor", "banner-ad", "ad-slot", "adsbox"], lambda: o.block("p", rng.choice([sentence(), say(2, 8), para()]), False, 0.3))

    def form(o: Out) -> None:
        def fill():
            o.block("label", rng.choice(["Email", "Search", "Name", say(1, 2)]), False)
            o.html.append('<input type="text">')
            if rng.random() < 0.5:
                o.block("p", sentence(), False)
            o.block("button", rng.choice(["Send", "Subscribe", "Sign up", say(1, 1)]), False)

        o.wrap("form", ["search", "subscribe", "newsletter", "login", "signup"], fill)

    def comments(o: Out) -> None:
        def fill():
            o.block(rng.choice(["h2", "h3"]), rng.choice(["Comments", "3 replies", say(1, 2)]), False)
            for _ in range(rng.randint(1, 5)):
                o.wrap(rng.choice(["div", "li", "article"]), ["comment", "reply", "response", "comment-body"], lambda: [o.block("p", rng.choice([para(), sentence()]), False) for _ in range(rng.randint(1, 2))])

        o.wrap("div", ["comments", "comment-list", "responses", "discussion", "disqus", "replies", "reader-comments", "user-comments"], fill)

    def article(o: Out) -> None:
        def fill():
            title = rng.random() < 0.85
            if title and rng.random() < 0.25:
                o.html.append("<header>")
                o.block("h1", say(2, 10).capitalize(), True)
                o.html.append("</header>")
            elif title:
                o.block(rng.choice(["h1", "h1", "h2"]), say(2, 10).capitalize(), True)
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.7:
                    o.block("p", rng.choice([para(), para(), para(), sentence(), sentence(), say(1, 4), rng.choice(["All rights reserved.", f"Copyright {word()}.", f"{sentence()} Share this.", "Read more in the next part.", f"The privacy of {word()}."])]), True)
                elif kind < 0.76:
                    o.block(rng.choice(["h2", "h3"]), say(1, 6).capitalize(), True)
                elif kind < 0.82:
                    o.html.append("<ul>")
                    for _ in range(rng.randint(2, 5)):
                        o.block("li", rng.choice([sentence(), say(2, 8)]), True)
                    o.html.append("</ul>")
                elif kind < 0.86:
                    o.html.append("<blockquote>")
                    o.block("p", para(), True)
                    o.html.append("</blockquote>")
                elif kind < 0.89:
                    o.block("pre", say(3, 12), True)
                elif kind < 0.92:
                    o.html.append("<table><tr>")
                    for _ in range(rng.randint(2, 4)):
                        o.block("td", say(1, 3), True)
                    o.html.append("</tr></table>")
                elif kind < 0.95:
                    advert(o)
                elif kind < 0.97:
                    form(o)
                elif kind < 0.985:
                    notice(o)
                else:
                    side(o)
            if rng.random() < 0.1:
                comments(o)

        kind = rng.random()
        if kind < 0.45:
            o.wrap("article", ["post", "article", "entry", "story"], fill)
        elif kind < 0.6:
            o.wrap("main", ["content", "main"], fill)
        elif kind < 0.85:
            o.wrap("div", ["content", "article-body", "post", "entry-content", "story", "main", "text", "body-copy", "post-content"], fill)
        elif kind < 0.93:
            tag = rng.choice(["div", "section"])
            o.html.append(f"<{tag}>")
            fill()
            o.html.append(f"</{tag}>")
        else:
            fill()

    out = []
    for i in range(n):
        o = Out()
        o.html.append("<!DOCTYPE html><html><head>")
        o.block("title", say(1, 8), False)
        o.html.append('<style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
        for part, share in ((header, 0.6), (menu, 0.8), (notice, 0.3), (advert, 0.4), (form, 0.2)):
            if rng.random() < share:
                part(o)
        article(o)
        for part, share in ((comments, 0.4), (advert, 0.3), (side, 0.5), (form, 0.3), (menu, 0.2), (notice, 0.2), (footer, 0.85)):
            if rng.random() < share:
                part(o)
        o.html.append("</body></html>" if rng.random() < 0.8 else "")
        page = "".join(o.html)
        if len(blocks(page)) == len(o.labels):
            out.append((page, o.labels))
    return out


@dataclass
class Field_:
    """Weights of the features (for the label ``article``), of a first label and of moves between labels."""

    names: dict[str, int]
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    cache: dict = field(default_factory=dict)

    def scores(self, found: list[Block]) -> list[float]:
        out, names, w = [], self.names, self.weights
        for b in found:
            if (s := self.cache.get(b.above)) is None:
                if len(self.cache) > 50_000:
                    self.cache.clear()
                s = self.cache[b.above] = float(sum(w[names[x]] for x in above_features(b.above) if x in names))
            f = text_features(b)
            if (t := self.cache.get(f)) is None:
                t = self.cache[f] = float(sum(w[names[x]] for x in f if x in names))
            out.append(s + t)
        return out

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi; a tie goes to ``article``."""
        if not found:
            return []
        (aa, ab), (ba, bb) = self.moves.tolist()
        unary = self.scores(found)
        low, high = float(self.start[0]), float(self.start[1]) + unary[0]
        back: list[tuple[bool, bool]] = []
        for u in unary[1:]:
            from0, from1 = high + ba > low + aa, high + bb >= low + ab
            back.append((from0, from1))
            low, high = (high + ba if from0 else low + aa), (high + bb if from1 else low + ab) + u
        now = high >= low
        out = [now]
        for from0, from1 in reversed(back):
            now = from1 if now else from0
            out.append(now)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page or "")
        return " ".join(b.text for b, good in zip(found, self.decode(found), strict=True) if good)


def train(pages: list[tuple[str, list[bool]]], rounds: int = 150, decay: float = 0.02, rate: float = 0.1) -> Field_:
    seqs = [(blocks(page), labels) for page, labels in pages]
    seqs = [(f, y) for f, y in seqs if f]
    feats = [[above_features(b.above) | set(text_features(b)) for b in f] for f, _ in seqs]
    seen: dict[str, int] = {}
    for f in feats:
        for x in set().union(*f):
            seen[x] = seen.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 2))}
    length, n = max(len(f) for f in feats), len(feats)
    x = np.zeros((n, length, len(names)), np.float32)
    y, real = np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (f, (_, labels)) in enumerate(zip(feats, seqs, strict=True)):
        real[i, : len(f)], y[i, : len(f)] = True, labels
        for t, b in enumerate(f):
            x[i, t, [names[k] for k in b if k in names]] = 1
    flat = x.reshape(-1, len(names))
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros_like(theta)
    gold[: len(names)] = flat.T @ (y * real).ravel()
    for a in (0, 1):
        gold[len(names) + a] = (y[:, 0] == a).sum()
        for b in (0, 1):
            gold[len(names) + 2 + 2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & real[:, 1:]).sum()
    for step in range(1, rounds + 1):
        w, start, moves = theta[: len(names)], theta[len(names) : -4], theta[-4:].reshape(2, 2)
        unary = np.zeros((n, length, 2))
        unary[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, length)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = start + unary[:, 0]
        for t in range(1, length):
            new = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + unary[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            ahead = unary[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        expect = np.zeros_like(theta)
        expect[: len(names)] = flat.T @ p[:, :, 1].ravel()
        expect[len(names) : -4] = p[:, 0].sum(0)
        pair = alpha[:, :-1, :, None] + moves + (unary + beta)[:, 1:, None, :] - total[:, None, None, None]
        expect[-4:] = (np.exp(np.minimum(pair, 0)) * real[:, 1:, None, None]).sum((0, 1)).ravel()
        grad = (expect - gold) / n + decay * theta / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field_(names, theta[: len(names)], theta[len(names) : -4], theta[-4:].reshape(2, 2))


def main_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", model: Field_ | None = None) -> DataFrame:
    """The id columns, the article's text and its number of code points, for every page."""
    common.bounded_batches(pages.sparkSession)
    spread = pages.sparkSession.sparkContext.broadcast(model or train(training_pages()))  # of the size of the training pages' features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, html_col):
            texts = [spread.value.extract(x) for x in part.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in id_cols), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*id_cols, "text", "n_chars"])

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in id_cols)
    return pages.select(*id_cols, html_col).mapInArrow(run, f"{kinds}text string, n_chars long")
