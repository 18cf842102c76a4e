"""Main text of pages by a recurrent block labeller.

A page is a sequence of leaf blocks. A bidirectional LSTM reads for each a
vector of its tag path and a vector of its hashed words and says, with the
whole page before and after it in view, whether the block is main text. The
network is plain numpy; it is trained for each run on a bounded number of
pages: some of the given ones, labelled where their markup is unambiguous, and
invented layouts filled with the words of the given ones.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .html_blocks import Block, blocks

TAGS = ("article aside blockquote button dd div dl figcaption figure footer form h1 h2 h3 h4 header li main nav ol option "
        "p pre section table td ul").split()
PATH, WORDS, SHAPE, HIDDEN = 64, 48, 8, 24
WIDTH = len(TAGS) + PATH + WORDS + SHAPE
#: Bounds of training: given pages and characters of each, invented pages, blocks of a page, passes.
GIVEN_PAGES = 400
GIVEN_CHARS = 200_000
INVENTED_PAGES = 640
FIT_BLOCKS = 80
EPOCHS = 14
BATCH = 32
#: Blocks that run through the network at a time, which bounds a worker's memory.
BLOCKS_PER_CALL = 8_192
MEMORY = 200_000

_tag_at = {t: i for i, t in enumerate(TAGS)}


def _slot(token: str, size: int) -> int:
    return xxhash.xxh32_intdigest(token) % (2 * size)


def path_vector(path: Sequence[str]) -> np.ndarray:
    """Which tags lie on the path, and their class words with the signed hash trick."""
    out = np.zeros(len(TAGS) + PATH, np.float32)
    for label in path:
        tag, *names = label.split(".")
        if tag in _tag_at:
            out[_tag_at[tag]] = 1.0
        for name in names:
            k = _slot(name, PATH)
            out[len(TAGS) + k % PATH] += 1.0 if k < PATH else -1.0
    if path:
        k = _slot(f"<{path[-1].partition('.')[0]}", PATH)
        out[len(TAGS) + k % PATH] += 0.5 if k < PATH else -0.5
    return np.clip(out, -2, 2)


class Reader:
    """Blocks to vectors, with bounded memories of paths and words."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            found = path_vector(path)
            if len(self.paths) < MEMORY:
                self.paths[path] = found
        return found

    def _word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = _slot(word, WORDS)
            if len(self.words) < MEMORY:
                self.words[word] = found
        return found

    def vectors(self, page: Sequence[Block]) -> np.ndarray:
        n = len(page)
        out = np.zeros((n, WIDTH), np.float32)
        slots: list[int] = []
        counts: list[int] = []
        shape = np.empty((n, SHAPE), np.float32)
        for i, block in enumerate(page):
            words = block.text.lower().split()
            slots.extend(map(self._word, words))
            counts.append(len(words))
            out[i, :len(TAGS) + PATH] = self._path(block.path)
            text = block.text
            shape[i] = (min(len(text), 2_000) / 400, len(words) < 4, len(words) > 12, block.link_share,
                        text[-1] in ".!?…\"'”»", "©" in text, i / n, len(block.path) / 10)
        index = np.repeat(np.arange(n), counts) * (2 * WORDS) + np.asarray(slots, np.int64)
        seen = np.bincount(index, minlength=n * 2 * WORDS).reshape(n, 2, WORDS)
        scale = np.sqrt(np.maximum(counts, 1))[:, None]
        out[:, len(TAGS) + PATH:-SHAPE] = np.clip((seen[:, 0] - seen[:, 1]) / scale, -2, 2)
        out[:, -SHAPE:] = shape
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _backwards(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row reversed within its own length; its own inverse."""
    steps = np.arange(x.shape[1])[None, :]
    at = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
    return np.take_along_axis(x, at[:, :, None], 1)


@dataclass
class Network:
    """Parameters: for each direction the input, recurrent and bias weights, then the output."""

    values: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng, values = np.random.default_rng(seed), {}
        for way in "fb":
            values[f"{way}x"] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            values[f"{way}h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            values[f"{way}b"] = np.zeros(4 * HIDDEN, np.float32)
            values[f"{way}b"][HIDDEN:2 * HIDDEN] = 1.0  # remember at first
        values["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        values["c"] = np.zeros(1, np.float32)
        return Network(values)

    def _run(self, way: str, x: np.ndarray, tape: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        wide, recurrent = x @ self.values[f"{way}x"] + self.values[f"{way}b"], self.values[f"{way}h"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, steps, HIDDEN), np.float32)
        for t in range(steps):
            z = wide[:, t] + h @ recurrent
            gates, g = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if tape is not None:
                tape.append((i, f, o, g, before, tc, last))
        return out

    def logits(self, x: np.ndarray, lengths: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        there = self._run("f", x, None if tapes is None else tapes.setdefault("f", []))
        back = self._run("b", _backwards(x, lengths), None if tapes is None else tapes.setdefault("b", []))
        both = np.concatenate([there, _backwards(back, lengths)], 2)
        if tapes is not None:
            tapes["both"] = both
        return both @ self.values["o"] + self.values["c"][0]

    def _learn(self, way: str, x: np.ndarray, tape: list, dout: np.ndarray, grads: dict) -> None:
        n, steps, _ = x.shape
        recurrent = self.values[f"{way}h"]
        dz = np.empty((n, steps, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        gh = np.zeros_like(recurrent)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tc, last = tape[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
            gh += last.T @ dz[:, t]
            dh, dc = dz[:, t] @ recurrent.T, dc * f
        grads[f"{way}h"] = gh
        grads[f"{way}x"] = np.tensordot(x, dz, ((0, 1), (0, 1)))
        grads[f"{way}b"] = dz.sum((0, 1))

    def gradients(self, x: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the blocks of a batch."""
        tapes: dict = {}
        mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
        off = (_sigmoid(self.logits(x, lengths, tapes)) - wanted) * mask / mask.sum()
        both = tapes["both"]
        grads = {"o": np.tensordot(off, both, ((0, 1), (0, 1))), "c": np.array([off.sum()])}
        dboth = off[:, :, None] * self.values["o"]
        self._learn("f", x, tapes["f"], dboth[:, :, :HIDDEN], grads)
        self._learn("b", _backwards(x, lengths), tapes["b"], _backwards(dboth[:, :, HIDDEN:], lengths), grads)
        return grads


def padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), max(lengths), WIDTH), np.float32)
    for row, page in zip(x, pages, strict=True):
        row[:len(page)] = page
    return x, lengths


def fit(pages: Sequence[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train on (vectors, 0/1 per block) by Adam over batches of pages of like length."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.values.items()}
    s = {k: np.zeros_like(v) for k, v in net.values.items()}
    ordered = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    batches = [ordered[i:i + BATCH] for i in range(0, len(ordered), BATCH)]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (0.15 if epoch >= 0.7 * epochs else 1)
        for k in rng.permutation(len(batches)):
            x, lengths = padded([p for p, _ in batches[k]])
            wanted = np.zeros(x.shape[:2], np.float32)
            for row, (_, y) in zip(wanted, batches[k], strict=True):
                row[:len(y)] = y
            step += 1
            grads = net.gradients(x, lengths, wanted)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                s[name] = 0.999 * s[name] + 0.001 * g**2
                net.values[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


JUNK = frozenset("nav aside footer form header button select option menu dialog".split())
JUNK_NAMES = re.compile(
    r"^(ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|widget|footer|masthead|cookies?|consent|"
    r"notice|alert|popup|modal|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|reply|"
    r"replies|respond|pagination|pager|tags?|toolbar|search|copyright|legal)$")
MAIN_NAMES = re.compile(r"^(article|content|post|entry|story|main|body|text|prose)$")


@functools.lru_cache(MEMORY)
def _junk(path: tuple[str, ...]) -> bool:
    """The tag or a name of an element around a block says that it is no main text."""
    return any(tag in JUNK or any(JUNK_NAMES.match(n) for n in names) for tag, *names in (p.split(".") for p in path))


def certain(page: Sequence[Block]) -> np.ndarray | None:
    """Labels where the markup leaves no doubt: a page with an article or main element, junk by tag or name."""
    inside = [any(p.partition(".")[0] in ("article", "main") for p in b.path) for b in page]
    if not any(inside):
        return None
    return np.array([main and not _junk(b.path) for main, b in zip(inside, page, strict=True)], np.float32)


def only_article(page: Sequence[Block]) -> np.ndarray | None:
    """The blocks of the one ``article`` of a page that has just one; None where there is none or a choice.

    Articles that are junk by tag or name, such as comments, do not count.
    """
    fine = np.array([b.article if b.article and not _junk(b.path) else 0 for b in page], np.int64)
    found = set(fine.tolist()) - {0}
    return fine > 0 if len(found) == 1 else None


#: Phrases of page furniture for invented pages.
PHRASES = {
    "menu": "home|news|about us|contact|products|blog|archive|help|accueil|startseite|inicio|contacto|über uns|à propos",
    "notice": "we use cookies to improve your experience accept|this site uses cookies privacy policy|please enable javascript|"
              "nous utilisons des cookies|diese website verwendet cookies|utilizamos cookies para mejorar",
    "ad": "advertisement|sponsored|buy now and save|limited offer shop today|anzeige|publicité|publicidad",
    "share": "share|tweet|share on facebook|email this|print|teilen|partager|compartir",
    "form": "subscribe to our newsletter|your email address|sign up|search|log in|password|submit|abonnieren|s'inscrire|suscribirse",
    "related": "read more|related articles|you may also like|most popular|previous post|next post|weiterlesen|lire la suite",
    "comment": "reply|posted by|says|comments|leave a comment|log in to reply|antworten|répondre|responder",
    "footer": "© all rights reserved|terms of use|privacy policy|copyright|impressum|mentions légales|aviso legal",
}
PLACES = {
    "menu": "nav/ul/li nav/ol/li header/nav/ul/li div.menu/ul/li div.navbar/ul/li div.breadcrumb ul.nav/li div.site.navigation/a",
    "header": "header header/div.logo div.header div.masthead header/p div.site.header/h1 div.top.bar",
    "notice": "div.cookie.notice div.notice/p div.alert dialog/p div.consent.banner/p div.popup/p section.notice",
    "ad": "div.ad div.ads/p div.advert aside.ad div.sponsored/p div.promo div.banner",
    "side": "aside/p aside/ul/li aside.sidebar/div/p div.sidebar/div.widget/p div.sidebar/ul/li div.widget/h3 aside/h2",
    "share": "div.share/ul/li div.social/a div.sharing ul.share.buttons/li",
    "form": "form/label form/button form.search/div form.subscribe/p div.newsletter/form/p form/fieldset/legend form/select/option",
    "related": "div.related/ul/li aside.related/h3 section.recommended/ul/li div.pagination div.tags/ul/li nav.pager",
    "comment": "section.comments/div.comment/p div.comments/ol/li/p ul.comment.list/li/div.comment/p div.respond/h3 section.comments/h2 article.comment/p",
    "footer": "footer footer/p footer/ul/li footer/div div.footer/p div.site.footer/div div.copyright",
}
#: Pages laid out by tables: everything is a cell, and nothing is named.
CELLS = ("table/tbody/tr/td table/tr/td center/table/tr/td table/tr/td/table/tr/td table/tbody/tr/td/div table/tr/td/center "
         "table/tr/td/div table/tr/th").split()
BODIES = ("article article main main/article main/div div.content div.post.content div.entry.content div.article.body "
          "section.article div.story div.main section main/section div.text div div/div").split()
INSIDE = ("p p p p p p p p p p p p h2 h3 ul/li ul/li ol/li blockquote/p blockquote pre pre div div/p figure/figcaption table/tr/td dl/dt dl/dd section/p").split()


def invented(rng: np.random.Generator, vocabulary: Sequence[str]) -> tuple[list[Block], np.ndarray]:
    """A page of random layout with its labels."""
    page: list[tuple[str, str, float, int]] = []
    celled = rng.random() < 0.14

    def words(low: int, high: int) -> str:
        n = int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))
        if rng.random() < 0.03:  # texts of one word do occur
            return " ".join([vocabulary[rng.integers(len(vocabulary))]] * n)
        return " ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), n))

    def pick(options: Sequence[str]) -> str:
        return options[rng.integers(len(options))]

    def furniture(kind: str, count: int, inside: str = "") -> None:
        place = pick(CELLS) + pick(["", "", "/p", "/ul/li"]) if celled else inside + pick(PLACES[kind].split())
        linked = kind in ("menu", "related", "share") or (kind in ("side", "footer") and rng.random() < 0.4)
        for _ in range(count):
            text = pick(PHRASES[kind].split("|")) if kind in PHRASES and rng.random() < 0.5 else (
                words(5, 80) if kind == "comment" else words(1, 30) if kind in ("ad", "side", "notice", "header") else words(1, 12))
            if kind == "footer" and rng.random() < 0.5:
                text = "© " + text
            page.append((place, text if rng.random() < 0.6 else text.capitalize() + ".", float(linked), 0))

    def some(kind: str, chance: float, most: int, inside: str = "") -> None:
        if rng.random() < chance:
            furniture(kind, int(rng.integers(1, most + 1)), inside)

    some("notice", 0.3, 2), some("header", 0.4, 2), some("menu", 0.9, 8), some("ad", 0.5, 2), some("side", 0.2, 4)
    body = pick(CELLS) if celled else pick(BODIES)
    some("menu", 0.1, 3, body + "/")
    if rng.random() < 0.85:
        page.append((f"{body}/h1" if rng.random() < 0.8 else f"{body}/header.entry/h1" if rng.random() < 0.3 else f"{body}/h2", words(1, 14), 0.0, 1))
    for _ in range(int(np.exp(rng.uniform(0, np.log(22))))):
        place = pick(INSIDE) if not celled or rng.random() < 0.7 else ""
        short = place[:1] == "h" or place in ("ul/li", "ol/li", "table/tr/td", "figure/figcaption")
        text = words(1, 14) if short else words(1, 160)
        page.append((f"{body}/{place}".rstrip("/"), text if short and rng.random() < 0.5 else text.capitalize() + ".", float(rng.random() < 0.1) * rng.random(), 1))
        for kind in ("ad", "share", "related", "form"):
            some(kind, 0.02, 2, body + "/")
    some("share", 0.2, 3, body + "/"), some("related", 0.2, 4, body + "/" if rng.random() < 0.5 else "")
    some("comment", 0.35, 6, body + "/" if rng.random() < 0.2 else ""), some("form", 0.3, 4), some("side", 0.3, 6), some("ad", 0.3, 2)
    some("footer", 0.9, 5)
    wrap = "html/body/" + ("div.wrapper/" if rng.random() < 0.3 else "") + ("div.page/" if rng.random() < 0.2 else "")
    nameless = rng.random() < 0.15  # a page whose classes say nothing
    made = []
    for place, text, linked, _ in page:
        path = tuple((wrap + place).split("/"))
        made.append(Block(tuple(p.partition(".")[0] for p in path) if nameless else path, text, linked))
    return made, np.array([y for *_, y in page], np.float32)


def train(pages: DataFrame, html: str = "html", seed: int = 7) -> Network:
    """A network for ``pages``; at most ``GIVEN_PAGES`` of at most ``GIVEN_CHARS`` characters are looked at here."""
    return trained([r[0] for r in pages.select(html).where(F.length(html) <= GIVEN_CHARS).take(GIVEN_PAGES)], seed)


def trained(given_html: Sequence[str], seed: int = 7) -> Network:
    """A network fitted on those of the given pages whose markup leaves no doubt, and on invented ones in their words."""
    rng, reader = np.random.default_rng(seed), Reader()
    given = [blocks(h) for h in given_html]
    given = [page[:FIT_BLOCKS] for page in given if page]
    vocabulary = sorted({w for page in given for b in page for w in b.text.split()[:200]})[:50_000] or ["word"]
    examples = [(page, y) for page in given if (y := certain(page)) is not None]
    examples += [invented(rng, vocabulary) for _ in range(INVENTED_PAGES)]
    return fit([(reader.vectors(page), y) for page, y in examples], seed=seed)


def label(pages: Sequence[Sequence[Block]], net: Network, reader: Reader) -> list[np.ndarray]:
    """For each page, which of its blocks are main text.

    Where a page has one article and no other, its markup decides; the network does not overrule it.
    """
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, page in enumerate(pages) if page), key=lambda k: len(pages[k]))
    while order:
        longest, count = len(pages[order[-1]]), 1
        while count < len(order) and (count + 1) * longest <= BLOCKS_PER_CALL:
            count += 1
        now, order = order[-count:], order[:-count]
        x, lengths = padded([reader.vectors(pages[k]) for k in now])
        logits = net.logits(x, lengths)
        for k, row, n in zip(now, logits, lengths, strict=True):
            sure = only_article(pages[k])
            out[k] = row[:n] > 0 if sure is None else sure
    return out


def extract(pages: DataFrame, html: str = "html", net: Network | None = None) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_blocks`` (blocks on the page), replacing such columns.

    Blocks of main text in page order, joined by line feeds. Null and empty
    pages, and pages without main text, give an empty text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(net or train(pages, html))
    kept = [f.name for f in pages.schema.fields if f.name not in (html, "text", "n_blocks")]
    schema = pages.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("text"), F.lit(0).alias("n_blocks")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                parsed = [blocks(p) for p in part.column(html).to_pylist()]
                chosen = label(parsed, shared.value, reader)
                texts = ["\n".join(b.text for b, y in zip(page, keep, strict=True) if y) for page, keep in zip(parsed, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(p) for p in parsed], pa.int32())],
                    [*kept, "text", "n_blocks"])

    return pages.mapInArrow(run, schema)
