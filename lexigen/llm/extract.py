"""Operator 10, main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with
the path of tags above it. A block is read as the sum of hashed embeddings of its path (tag
names, class and id words, roles) and the mean of those of its words and its shape. A
bidirectional LSTM runs over the page's blocks, so each is classified with the whole page in
view; forward, backward pass and training are numpy.

The labeller is trained on a bounded sample: ``max_pages`` pages of the smallest hashes
of up to ``max_chars`` code points. Their blocks are labelled by the tags that say what
they are (article and main against navigation, asides, footers and the like), and are laid out
anew in many other page shapes, where a container's class or id is the only sign, with
menus, notices, adverts, forms, comments and sidebars before, inside and after the text.
Decisions are made page by page on the whole html.

Null and empty html have an empty text; so have pages without a block of main text.
Unclosed tags and comments, tags cut off by the end and stray end tags are read as browsers do, roughly. Nested tags
share their paths and are found by their places, so time and memory follow a page's length however deep its tags nest.
Repeated rows are extracted each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.llm.common import held, texts_of, with_columns
from lexigen.session import spread

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Tags an opening tag closes when one is open, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table tbody thead tfoot select".split())

PATHS, WORDS = 4096, 8192
PATH_DIMS, WORD_DIMS, HIDDEN = 16, 8, 16
SHAPE = 4  # marks of a block's shape, after its words


class Path:
    """Marks of the tags above a block, outermost first: a tag's own and the path it stands under, so that nested tags
    share theirs. ``bits`` is the set of the marks' hash buckets."""

    __slots__ = ("above", "marks", "bits")

    def __init__(self, above: Path | None = None, marks: tuple[str, ...] = ()):
        self.above, self.marks, self.bits = above, marks, above.bits if above else 0
        for m in marks:
            self.bits |= _bit(m)

    def __iter__(self) -> Iterator[str]:
        chain, at = [], self
        while at is not None:
            chain.append(at.marks)
            at = at.above
        return (m for marks in reversed(chain) for m in marks)


@dataclass
class Block:
    path: Path
    text: str
    linked: int  # code points inside links


def _marks(name: str, attrs: str) -> tuple[str, ...]:
    """What a tag says about its content."""
    out = [name]
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if key.lower() in ("class", "id", "role"):
            out += [f".{w.lower()}" for w in _PARTS.findall(a or b or c)]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; scripts, styles and comments hold none."""
    out: list[Block] = []
    root = Path()
    stack: list[tuple[str, Path]] = []
    solid: list[int] = []  # places of the block-level tags in the stack
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(stack[-1][1] if stack else root, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    def pop_to(i: int) -> None:
        nonlocal links
        for name, _ in stack[i:]:
            places[name].pop()
            links -= name == "a"
        while solid and solid[-1] >= i:
            solid.pop()
        del stack[i:]

    def nearest(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name not in INLINE:
            flush()
        if m["close"]:
            own = places[name]
            if own and (name not in INLINE or not solid or own[-1] > solid[-1]):
                pop_to(own[-1])
            continue
        if name == "br":
            parts.append(" ")
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            ended = nearest({"p", *CLOSES[name]}) if name in CLOSES else nearest({"p"})
            if ended >= 0 and (ended > nearest(_HOLDS) if name in CLOSES else ended == solid[-1]):
                pop_to(ended)
        links += name == "a"
        if not m["attrs"].endswith("/"):
            above = stack[-1][1] if stack else root
            if name not in INLINE:
                solid.append(len(stack))
                above = Path(above, _marks(name, m["attrs"]))
            places[name].append(len(stack))
            stack.append((name, above))
        elif name == "a":
            links -= 1
    flush()
    return out


def _bucket(key: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) % (size - 1) + 1


@lru_cache(100_000)
def _bit(mark: str) -> int:
    return 1 << _bucket(mark, PATHS)


class Reader:
    """Blocks to hash buckets, remembered."""

    def __init__(self, limit: int = 200_000):
        self.limit, self._words, self._paths = limit, {}, {}

    def words(self, block: Block) -> list[int]:
        known, out = self._words, []
        found = _WORD.findall(block.text.lower())
        for w in found:
            b = known.get(w)
            if b is None:
                if len(known) >= self.limit:
                    known.clear()
                b = known[w] = _bucket(f"w:{w}", WORDS)
            out.append(b)
        size, share = len(found).bit_length(), 4 * block.linked // max(1, len(block.text))
        ends = block.text[-1] in ".!?…:;\"”»"
        return [*out, *(known.setdefault(k, _bucket(k, WORDS)) for k in (f"#size {size}", f"#links {share}", f"#ends {ends}", f"#copy {'©' in block.text}"))]

    def path(self, path: Path) -> list[int]:
        bits = path.bits | (_bit(f"leaf {path.marks[-1]}") if path.marks else 0)
        out = self._paths.get(bits)
        if out is None:
            if len(self._paths) >= self.limit // 10:
                self._paths.clear()
            out = self._paths[bits] = [i for i, b in enumerate(reversed(bin(bits))) if b == "1"]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, an LSTM in each direction and a logistic output on both and the block itself."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        dims = PATH_DIMS + WORD_DIMS
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {"path": small(PATHS, PATH_DIMS), "word": small(WORDS, WORD_DIMS)}
        for d in ("f", "b"):
            self.p |= {f"wx{d}": small(dims, 4 * HIDDEN) * 2, f"wh{d}": small(HIDDEN, 4 * HIDDEN) * 2, f"bias{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"bias{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p |= {"out": small(2 * HIDDEN + dims), "offset": np.zeros(1, np.float32)}

    def inputs(self, paths: list[list[int]], words: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(paths), PATH_DIMS + WORD_DIMS), np.float32)
        for i, (a, b) in enumerate(zip(paths, words, strict=True)):
            x[i, :PATH_DIMS] = self.p["path"][a].sum(axis=0)
            x[i, PATH_DIMS:] = self.p["word"][b].mean(axis=0)
        return x

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, pages, HIDDEN) over inputs (time, pages, dims); padding holds the state still."""
        gates_x = x @ self.p[f"wx{d}"] + self.p[f"bias{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, kept = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            g = gates_x[t] + h @ self.p[f"wh{d}"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            live = mask[t][:, None]
            if keep:
                kept.append((h, c, i, f, o, u, tc))
            h = np.where(live, o * tc, h)
            c = np.where(live, c_new, c)
            states[t] = h
        return states, kept

    def _pass_back(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list, d_states: np.ndarray, grads: dict) -> np.ndarray:
        d_x = np.zeros_like(x)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, u, tc = kept[t]
            live = mask[t][:, None]
            dh = dh + d_states[t]
            dc_new = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate([dc_new * u * i * (1 - i), dc_new * c * f * (1 - f), dh * tc * o * (1 - o), dc_new * i * (1 - u * u)], axis=1) * live
            grads[f"wx{d}"] += x[t].T @ dg
            grads[f"wh{d}"] += h.T @ dg
            grads[f"bias{d}"] += dg.sum(axis=0)
            d_x[t] = dg @ self.p[f"wx{d}"].T
            dh = np.where(live, dg @ self.p[f"wh{d}"].T, dh)
            dc = np.where(live, dc_new * f, dc)
        return d_x

    @staticmethod
    def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, mask, index that turns every page round) of pages side by side."""
        longest = max(map(len, pages))
        x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
        mask, turn = np.zeros((longest, len(pages)), bool), np.tile(np.arange(longest)[:, None], (1, len(pages)))
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k], turn[: len(p), k] = p, True, np.arange(len(p))[::-1]
        return x, mask, turn

    def _forward(self, pages: list[np.ndarray], keep: bool = False):
        x, mask, turn = self._batch(pages)
        col = np.arange(x.shape[1])
        back = x[turn, col]
        hf, kf = self._pass(x, mask, "f", keep)
        hb, kb = self._pass(back, mask, "b", keep)
        joint = np.concatenate([hf, hb[turn, col], x], axis=2)
        return joint @ self.p["out"] + self.p["offset"][0], (x, mask, turn, col, back, kf, kb, joint)

    def scores(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Probability of main text for every block of every page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and (end - at + 1) * len(pages[order[end]]) <= cells:
                end += 1
            z, _ = self._forward([pages[i] for i in order[at:end]])
            for k, i in enumerate(order[at:end]):
                out[i] = _sigmoid(z[: len(pages[i]), k])
            at = end
        return out

    def train(self, paths: list[list[list[int]]], words: list[list[list[int]]], labels: list[list[int]], epochs: int = 12, size: int = 24, rate: float = 0.015, seed: int = 5) -> None:
        """Adam on the mean log-loss of blocks."""
        rng = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, step = list(range(len(paths))), 0
        for epoch in range(epochs):
            rng.shuffle(order)
            speed = rate * (1 - epoch / epochs)
            for at in range(0, len(order), size):
                own, step = order[at : at + size], step + 1
                # words are left out at random, so the tags above a block count first
                keep = [rng.choice((0.0, 0.3, 0.7)) for _ in own]
                dropped = [[[w for w in b[:-SHAPE] if rng.random() < k] + b[-SHAPE:] for b in words[i]] for i, k in zip(own, keep, strict=True)]
                pages = [self.inputs(paths[i], d) for i, d in zip(own, dropped, strict=True)]
                z, (x, mask, turn, col, back, kf, kb, joint) = self._forward(pages, keep=True)
                y = np.zeros_like(z)
                for k, i in enumerate(own):
                    y[: len(labels[i]), k] = labels[i]
                dz = (_sigmoid(z) - y) * mask / mask.sum()
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                g["out"], g["offset"] = np.einsum("tp,tpd->d", dz, joint), np.array([dz.sum()], np.float32)
                d_joint = dz[:, :, None] * self.p["out"]
                d_x = d_joint[:, :, 2 * HIDDEN :] + self._pass_back(x, mask, "f", kf, d_joint[:, :, :HIDDEN], g)
                d_x = d_x + self._pass_back(back, mask, "b", kb, d_joint[:, :, HIDDEN : 2 * HIDDEN][turn, col], g)[turn, col]
                for k, i in enumerate(own):
                    for t, (a, b) in enumerate(zip(paths[i], dropped[k], strict=True)):
                        np.add.at(g["path"], a, d_x[t, k, :PATH_DIMS])
                        np.add.at(g["word"], b, d_x[t, k, PATH_DIMS:] / len(b))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


#: Words by which containers are named (fixed lists, used to lay out training pages).
MAIN_NAMES = "content post entry article story main text body".split()
MENU_NAMES = "nav menu navbar navigation breadcrumb breadcrumbs toolbar links tabs pagination skip".split()
SIDE_NAMES = "sidebar aside widget related recommended popular trending tags categories archive more".split()
HEAD_NAMES = "header masthead banner topbar logo branding".split()
FOOT_NAMES = "footer copyright bottom legal imprint colophon".split()
NOTE_NAMES = "notice cookie cookies consent gdpr alert warning popup modal overlay disclaimer message".split()
AD_NAMES = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense teaser".split()
FORM_NAMES = "form search login newsletter subscribe signup contact".split()
TALK_NAMES = "comment comments reply replies discussion responses disqus thread".split()
OUTER_NAMES = "page wrapper container site root app outer layout wrap inner main".split()
SHARE_NAMES = "share social sharing follow byline".split()


def _box(rng: random.Random, names: list[str], tag: str) -> str:
    """Opening tag of a container named after its content."""
    name = rng.choice(names)
    if rng.random() < 0.3:
        name = rng.choice("site page main top global post entry left right the".split()) + rng.choice(["-", "_", "-"]) + name
    if rng.random() < 0.3:
        name += rng.choice(["-", "_", " "]) + rng.choice("box list area wrapper container left right top inner block item section 1 2".split())
    return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">'


def layout(rng: random.Random, main: list[str], other: list[str]) -> tuple[str, list[int]]:
    """A page of another shape, and the label of each of its blocks."""
    out: list[str] = []
    labels: list[int] = []

    def put(markup: str, text: str, label: int, tail: str) -> None:
        if text:
            out.append(f"{markup}{entities.escape(text)}{tail}")
            labels.append(label)

    def box(names: list[str], tags: list[str], n: int, item: str, texts: list[str]) -> None:
        tag = rng.choice(tags)
        plain = tag not in ("div", "section", "ul", "td") and rng.random() < 0.6
        out.append(f"<{tag}>" if plain else _box(rng, names, tag))
        for _ in range(n):
            t = rng.choice(texts) if texts else "Home"
            if item == "li":
                put('<li><a href="/x">', " ".join(t.split()[:3]), 0, "</a></li>")
            else:
                put(f"<{item}>", t, 0, f"</{item}>")
        out.append(f"</{tag}>")

    some = other or main or ["Home"]
    prose = [*main, *some]

    def clutter(inside: bool) -> None:
        kind = rng.randrange(7)
        if kind == 0:
            box(AD_NAMES, ["div", "aside"], 1, rng.choice(["p", "span"]), prose)
        elif kind == 1:
            box(NOTE_NAMES, ["div", "section"], 1, "p", prose)
        elif kind == 2:
            box(SHARE_NAMES, ["div", "ul"], 2, "li", some)
        elif kind == 3:
            box(SIDE_NAMES, ["aside", "div"], rng.randint(1, 4), rng.choice(["li", "p"]), prose)
        elif kind == 4:
            box(FORM_NAMES, ["form", "form", "div"], rng.randint(1, 2), rng.choice(["label", "button", "p"]), prose)
        elif kind == 5 and not inside:
            box(MENU_NAMES, ["nav", "div", "ul"], rng.randint(2, 6), "li", some)
        else:
            box(TALK_NAMES, ["div", "section", "ul"], rng.randint(1, 4), "p", prose)

    put("<html><head><title>", main[0] if main else "", 0, "</title></head><body>")
    outer = [_box(rng, OUTER_NAMES, "div") for _ in range(rng.choice([0, 0, 1, 1, 2]))]
    out += outer
    if rng.random() < 0.8:
        box(HEAD_NAMES, ["header", "div", "div"], rng.randint(1, 2), rng.choice(["p", "div", "h1", "h2"]), some)
    if rng.random() < 0.8:
        box(MENU_NAMES, ["nav", "div", "ul"], rng.randint(2, 6), "li", some)
    for _ in range(rng.randint(0, 2)):
        clutter(False)
    wrap = rng.random() < 0.3
    out.append(_box(rng, OUTER_NAMES, "div") if wrap else "")
    tag = rng.choice(["article", "main", "div", "div", "section"])
    out.append(f"<{tag}>" if tag in ("article", "main") and rng.random() < 0.6 else _box(rng, MAIN_NAMES, tag))
    item = rng.choice(["p", "p", "p", "div"])
    for k, text in enumerate(main):
        if not k and rng.random() < 0.7:
            inner = tag == "article" and rng.random() < 0.3
            put("<header><h1>" if inner else "<h1>", text, 1, "</h1></header>" if inner else "</h1>")
        elif k and rng.random() < 0.1:  # a list inside the text
            out.append(f"<{(kind := rng.choice(['ul', 'ol']))}>")
            for line in [text, *rng.sample(main, rng.randint(0, min(4, len(main))))]:
                put("<li>", " ".join(line.split()[: rng.choice([2, 6, 40])]), 1, rng.choice(["", "</li>"]))
            out.append(f"</{kind}>")
        else:
            kind = rng.choice([item] * 10 + ["h2", "h3", "blockquote", "pre"])
            put(f"<{kind}>", text, 1, "" if kind == "p" and rng.random() < 0.3 else f"</{kind}>")
        if k and rng.random() < 0.12:
            clutter(True)
    if rng.random() < 0.3:
        clutter(True)
    out.append(f"</{tag}>" + ("</div>" if wrap else ""))
    for _ in range(rng.randint(0, 3)):
        clutter(False)
    if rng.random() < 0.9:
        box(FOOT_NAMES, ["footer", "footer", "div"], rng.randint(1, 3), rng.choice(["p", "div", "li"]), some)
        if rng.random() < 0.5:
            put('<div class="footer">© ', rng.choice(some), 0, "</div>")
    out += ["</div>"] * len(outer)
    return "".join(out), labels


_SAYS_MAIN = frozenset(("article", "main"))
_SAYS_OTHER = frozenset("nav header footer aside form head button select".split()) | {f".{w}" for names in (MENU_NAMES, SIDE_NAMES, FOOT_NAMES, NOTE_NAMES, AD_NAMES, FORM_NAMES, TALK_NAMES) for w in names}


def told(block: Block) -> int:
    """The label that the tags above a block state; a page's own header may stand in the article."""
    path = set(block.path)
    return int(bool(path & _SAYS_MAIN) and not (path - ({"header"} if "article" in path else set())) & _SAYS_OTHER)


def fit_labeller(pages: list[str], shapes: int = 5, seed: int = 5) -> Labeller:
    """Train on sample pages as they are and in ``shapes`` other layouts each."""
    rng = random.Random(seed)
    reader, model = Reader(), Labeller(seed)
    paths, words, labels = [], [], []

    def add(found: list[Block], marks: list[int]) -> None:
        if found and len(found) == len(marks):
            paths.append([reader.path(b.path) for b in found])
            words.append([reader.words(b) for b in found])
            labels.append(marks)

    for page in pages:
        found = blocks(page)
        marks = [told(b) for b in found]
        if not any(marks):  # it says nothing: its paragraphs serve as text for other layouts
            main, other = [b.text for b in found if "p" in b.path], [b.text for b in found if "p" not in b.path]
        else:
            add(found, marks)
            add(found, marks)
            main, other = [b.text for b, y in zip(found, marks, strict=True) if y], [b.text for b, y in zip(found, marks, strict=True) if not y]
        for _ in range(shapes):
            made, own = layout(rng, main[: rng.randint(1, 12)], other)
            add(blocks(made), own)
    if paths:
        model.train(paths, words, labels, seed=seed)
    return model


def main_text(page: str, model: Labeller, reader: Reader) -> str:
    """The main text of one page."""
    return texts([page], model, reader)[0]


def texts(pages: list[str], model: Labeller, reader: Reader) -> list[str]:
    found = [blocks(p) for p in pages]
    scores = model.scores([model.inputs([reader.path(b.path) for b in page], [reader.words(b) for b in page]) for page in found])
    return ["\n".join(b.text for b, s in zip(page, own, strict=True) if s >= 0.5) for page, own in zip(found, scores, strict=True)]


def sample_pages(df: DataFrame, id_col: str, html_col: str, max_pages: int, max_chars: int) -> list[str]:
    """Different pages of the smallest hashes of id and html. Hashes alone are compared, so
    no more pages than asked for leave their tasks."""
    hashed = df.filter(F.length(html_col).between(1, max_chars)).select(F.xxhash64(id_col, html_col).alias("page_hash"), F.col(html_col).alias("html"))
    chosen = hashed.select("page_hash").distinct().orderBy("page_hash").limit(max_pages)
    rows = hashed.join(F.broadcast(chosen), "page_hash").groupBy("page_hash").agg(F.first("html").alias("html"))
    return [r["html"] for r in sorted(rows.collect(), key=lambda r: r["page_hash"])]


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_pages: int = 150, max_chars: int = 50_000) -> DataFrame:
    """Per row: id, url, ``text`` and ``n_chars`` (its code points)."""
    sent = df.sparkSession.sparkContext.broadcast(fit_labeller(sample_pages(df, id_col, html_col, max_pages, max_chars)))  # under 1 MB
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("nothing",))
        model, reader = sent.value, Reader()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = texts(texts_of(batch, html_col), model, reader)
                yield with_columns(batch, [id_col, url_col], text=pa.array(out, pa.string()), n_chars=pa.array(list(map(len, out)), pa.int64()))

    return spread(df.select(id_col, url_col, html_col)).mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long")
