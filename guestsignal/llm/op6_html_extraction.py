"""HTML main text by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of blocks (pages.blocks); each is part of the main text or not. Features are
the block's ancestor tags, the words of their class and id, and its text (length, links, marks,
place). The field is trained on labelled pages and decoded by Viterbi.

Labelled pages: a bounded sample of the given pages in which an <article> or <main> marks the
text. So that the field learns more than that one tag, each also appears in variants: with
other elements around the text, and with labelled sidebars, notices, forms, comments and adverts
between its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm.pages import Block, blocks
from guestsignal.llm.shared import table

#: Pages to learn from, and the longest of them.
SAMPLE, LONGEST = 300, 100_000

#: Words of class, id and role that name a kind of block.
KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs links",
    "advert": "ad ads advert advertisement advertising banner sponsor sponsored promo promotion",
    "comment": "comment comments reply replies discussion respond disqus feedback review reviews",
    "side": "sidebar side aside widget widgets related recommended popular trending teaser",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead top topbar branding logo site",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe paywall",
    "form": "form search login signup signin register contact field input",
    "share": "share social sharing follow tags meta byline author",
    "content": "content article post entry main story body text page",
}
_KIND = {word: kind for kind, words in KINDS.items() for word in words.split()}
_AWAY = ("nav", "header", "footer", "aside", "form", "menu", "button", "dialog")


def features(sequence: list[Block]) -> list[list[str]]:
    n = len(sequence)
    out = []
    for k, block in enumerate(sequence):
        words = block.text.count(" ") + 1
        own = ["all", f"words{min(words, 64).bit_length()}"]
        own.append(f"links{min(3, 4 * block.linked // (len(block.text) + 1))}")
        own.append("stop" if block.text[-1] in ".!?\"'”…" else "open")
        if "©" in block.text or "·" in block.text:
            own.append("marks")
        if k == 0 or k == n - 1:
            own.append("first" if k == 0 else "last")
        if block.path:
            own.append("tag=" + block.path[-1][0])
        for tag in {tag for tag, _ in block.path} - {"html", "body"}:
            own.append("in=" + tag)
        names = {word for _, names in block.path for word in names}
        for kind in {_KIND[word] for word in names if word in _KIND}:
            own.append("kind=" + kind)
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of the features for the main text against the rest, and of label pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def decode(self, sequence: list[Block]) -> list[bool]:
        """Most likely labels by Viterbi."""
        get, (stay0, go1, go0, stay1) = self.weights.get, self.pairs
        best0 = best1 = 0.0
        back: list[tuple[bool, bool]] = []
        for k, own in enumerate(features(sequence)):
            score = sum([get(name, 0.0) for name in own])
            if k:
                from0 = best1 + go0 > best0 + stay0, best1 + stay1 > best0 + go1
                back.append(from0)
                best0, best1 = max(best0 + stay0, best1 + go0), max(best0 + go1, best1 + stay1)
            best1 += score
        if not sequence:
            return []
        label = best1 > best0
        out = [label]
        for pointers in reversed(back):
            label = pointers[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = 120, penalty: float = 0.02) -> Field:
    """Maximum likelihood with an L2 penalty, all pages at once, by Adam."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Field({"in=article": 1.0, "in=main": 1.0, "all": -0.5})
    index: dict[str, int] = {}
    rows, columns, longest = [], [], max(len(b) for b, _ in pages)
    labels = np.full((len(pages), longest), -1)
    for p, (sequence, truth) in enumerate(pages):
        labels[p, : len(truth)] = truth
        for k, own in enumerate(features(sequence)):
            for name in own:
                rows.append(p * longest + k)
                columns.append(index.setdefault(name, len(index)))
    rows, columns = np.array(rows), np.array(columns)
    there, is1 = labels >= 0, labels == 1
    follow = there[:, 1:] & there[:, :-1]
    weights, pairs = np.zeros(len(index)), np.zeros((2, 2))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, pairs)]
    size = len(pages)
    for turn in range(1, rounds + 1):
        score = np.bincount(rows, weights[columns], minlength=size * longest).reshape(size, longest)
        emit = np.stack([np.zeros_like(score), score], axis=2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(ahead[:, k - 1, 0, None] + pairs[0], ahead[:, k - 1, 1, None] + pairs[1])
            ahead[:, k] = np.where(there[:, k, None], step + emit[:, k], ahead[:, k - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for k in range(longest - 2, -1, -1):
            on = behind[:, k + 1] + emit[:, k + 1]
            step = np.logaddexp(on[:, 0, None] + pairs[:, 0], on[:, 1, None] + pairs[:, 1])
            behind[:, k] = np.where(there[:, k + 1, None], step, 0.0)
        chance = np.exp(np.minimum(ahead[..., 1] + behind[..., 1] - total[:, None], 0))
        wrong = np.where(there, is1 - chance, 0.0)
        slope = np.bincount(columns, wrong.ravel()[rows], minlength=len(index)) / size
        pair_slope = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = ahead[:, :-1, a] + pairs[a, b] + emit[:, 1:, b] + behind[:, 1:, b]
                expected = np.exp(np.minimum(joint - total[:, None], 0))
                seen = (is1[:, :-1] == bool(a)) & (is1[:, 1:] == bool(b))
                pair_slope[a, b] = (np.where(follow, seen - expected, 0)).sum() / size
        for x, gradient, (mean, square) in zip(
            (weights, pairs), (slope - penalty * weights, pair_slope - penalty * pairs), moments
        ):
            mean *= 0.9
            mean += 0.1 * gradient
            square *= 0.99
            square += 0.01 * gradient**2
            x += 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return Field({k: float(weights[v]) for k, v in index.items()}, tuple(pairs.ravel().tolist()))


def labelled(page: str) -> list[tuple[list[Block], list[bool]]]:
    """A page with its labels, and its variants; nothing if no element marks its main text."""
    sequence = blocks(page)
    inside = [{tag for tag, _ in b.path} for b in sequence]
    truth = [bool(tags & {"article", "main"}) and not tags & set(_AWAY) for tags in inside]
    if not any(truth):
        return []
    out = [(sequence, truth)]
    shells = (
        ("div", ("content",)), ("main", ()), ("section", ("post", "body")), ("div", ("story", "text")),
    )
    extra = (
        (("aside", ()), ("p", ())), (("div", ("sidebar",)), ("p", ())), (("form", ()), ("div", ())),
        (("section", ("comments",)), ("p", ())), (("div", ("cookie", "notice")), ("div", ())),
        (("div", ("ad",)), ()), (("header", ()), ("div", ("branding",))), (("div", ("related", "widget")), ("li", ())),
        (("div", ("comment",)), ("p", ())), (("footer", ()), ()), (("div", ("newsletter", "promo")), ("p", ())),
    )
    texts = [b.text for b in sequence]
    for v, shell in enumerate(shells):
        turned, answer = [], []
        for k, (block, main) in enumerate(zip(sequence, truth)):
            path = tuple(shell if tag in ("article", "main") else (tag, names) for tag, names in block.path)
            turned.append(Block(block.text, path, block.linked))
            answer.append(main)
            if (k + v) % 3 == 0:
                over = [x for x in extra[(k + 2 * v) % len(extra)] if x]
                base = block.path[:2] if (k + v) % 2 or not main else path[:-1]
                turned.append(Block(texts[(7 * k + v) % len(texts)], (*base, *over), 0))
                answer.append(False)
        out.append((turned, answer))
    return out


def train(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn from the `sample` pages of least hash among those of at most LONGEST characters."""
    hashed = pages.filter(F.length("html") <= LONGEST).select(
        F.xxhash64("page_id", "html").alias("h"), "html"
    )
    # hashes alone come first, so that only the chosen pages are sent
    last = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = hashed.filter(F.col("h") <= last).orderBy("h", "html").limit(sample).collect() if last is not None else []
    return fit([case for row in rows for case in labelled(row.html)])


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html).

    A null or empty html, and one without main text, gives an empty text. Blocks are joined
    by one space; n_chars counts code points.
    """
    weights, pairs = model.weights, model.pairs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Field(weights, pairs)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                for page in part.column("html").to_pylist():
                    sequence = blocks(page or "")
                    labels = known.decode(sequence)
                    texts.append(" ".join(b.text for b, main in zip(sequence, labels) if main))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return own.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
