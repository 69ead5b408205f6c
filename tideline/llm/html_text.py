"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks, the runs of text between tags that break a line. Each block has features of
its ancestors (tags, words of class, id and role) and of its text (length, share of links, punctuation, telling words).
Two labels, article and rest, are weighted by these features and by a transition matrix; weights are fitted to labelled
pages by gradient ascent on the conditional likelihood (forward-backward), and pages are labelled by Viterbi. The
labelled pages are built by ``html_pages``, so that no page of the input is needed for learning.

Defined results: null or empty html, and pages without an article block, give an empty text with 0 characters; broken
and cut-off markup is read as far as it goes, in time linear in the page's length; comments, scripts, styles and heads
never are text; white space (of any kind) inside a block is one space; nothing else is dropped or capped; repeated rows
and null ids keep rows of their own; an empty table gives an empty result; columns other than page_id, url and html
are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.chunks import bounded_batches, texts_of
from tideline.llm.html_blocks import leaf_blocks
from tideline.llm.html_pages import MARK, made_pages

#: Words that tell notices, adverts, forms and the like.
TELLING = frozenset(
    "cookie cookies consent subscribe newsletter copyright rights reserved privacy terms login sign register advertisement "
    "sponsored share tweet comment comments reply replies related menu search email password submit posted follow".split()
)
#: Telling words count where there is one in so many words.
SHARE = 40


def text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    found = [f"n={n.bit_length()}", f"l={min(3, 4 * linked // n)}", f"e={text[-1] if text[-1] in '.!?:;' else 'x'}", f"w={min(6, text.count(' ')).bit_length()}"]
    low = text.lower()
    if "©" in low or "(c)" in low:
        found.append("k=©")
    words = re.findall(r"[a-z]+", low)
    telling = [w for w in words if w in TELLING]
    if len(telling) * SHARE >= len(words):  # their share counts, whatever the block's size
        found += [f"k={w}" for w in set(telling)]
    if text.count(",") * 60 > n:
        found.append("commas")
    return found


class Field:
    """Weights of a linear-chain conditional random field with two labels; 1 is the article."""

    def __init__(self, weights: dict[str, float], start: float, moves: list[list[float]]):
        self.weights, self.start, self.moves = weights, start, moves
        self.memo: dict = {}

    def emission(self, place: float, text: str, linked: int) -> float:
        get = self.weights.get
        return place + sum(get(f, 0.0) for f in text_features(text, linked))

    def labels(self, blocks) -> list[int]:
        """The best sequence of labels, by Viterbi."""
        (m00, m01), (m10, m11) = self.moves
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for k, block in enumerate(blocks):
            e = self.emission(*block)
            if not k:
                s0, s1 = 0.0, self.start + e
                continue
            a, b = (s0 + m00, 0) if s0 + m00 >= s1 + m10 else (s1 + m10, 1)
            c, d = (s0 + m01, 0) if s0 + m01 > s1 + m11 else (s1 + m11, 1)
            back.append((b, d))
            s0, s1 = a, c + e
        out = [int(s1 > s0)] if blocks else []
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


class Likelihood:
    """Labelled pages as arrays, and their penalised conditional log likelihood for each page with its gradient. The
    parameters are the weights of ``names``, that of a first block in the article, and the four moves."""

    def __init__(self, pages: list[str], penalty: float, least: int):
        found = [[((*place, *text_features(text.replace(MARK, "").strip() or "x", linked)), MARK in text) for place, text, linked in leaf_blocks(p)] for p in pages]
        found = sorted((x for x in found if x), key=len, reverse=True)
        often: dict[str, int] = {}
        for blocks in found:
            for features, _ in blocks:
                for f in features:
                    often[f] = often.get(f, 0) + 1
        self.names = {f: i for i, f in enumerate(f for f, n in often.items() if n >= least)}
        rows = [[self.names[f] for f in features if f in self.names] for blocks in found for features, _ in blocks]
        self.flat, self.row_of = np.array([i for r in rows for i in r], int), np.repeat(np.arange(len(rows)), list(map(len, rows)))
        self.rows, self.penalty = len(rows), penalty
        self.sizes = sizes = np.array(list(map(len, found)))
        n, longest = len(sizes), int(sizes[0])
        self.page_of = np.repeat(np.arange(n), sizes)
        self.place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.y = np.zeros((longest, n), int)
        self.y[self.place, self.page_of] = [mark for blocks in found for _, mark in blocks]
        self.alive = [int((sizes > t).sum()) for t in range(longest)]
        self.after = np.arange(longest - 1)[:, None] < sizes - 1

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        y, place, page_of, (longest, n) = self.y, self.place, self.page_of, self.y.shape
        moves = np.exp(theta[-4:].reshape(2, 2))
        emitted = np.clip(np.bincount(self.row_of, theta[self.flat], self.rows), -30, 30)
        factor = np.ones((longest, n, 2))
        factor[place, page_of, 1] = np.exp(emitted)
        ahead, behind, norm = np.zeros((longest, n, 2)), np.ones((longest, n, 2)), np.ones((longest, n, 1))
        for t, k in enumerate(self.alive):
            here = factor[t, :k] * (ahead[t - 1, :k] @ moves if t else np.array([1.0, np.exp(theta[-5])]))
            norm[t, :k] = here.sum(axis=1, keepdims=True)
            ahead[t, :k] = here / norm[t, :k]
        for t in range(longest - 2, -1, -1):
            k = self.alive[t + 1]
            behind[t, :k] = (factor[t + 1, :k] * behind[t + 1, :k]) @ moves.T / norm[t + 1, :k]
        p1 = (ahead * behind)[:, :, 1]
        grad = np.zeros_like(theta)
        grad[:-5] = np.bincount(self.flat, (y - p1)[place, page_of][self.row_of], len(self.names))
        grad[-5] = (y[0] - p1[0]).sum()
        onward = factor[1:] * behind[1:] / norm[1:]
        value = (emitted * y[place, page_of]).sum() + theta[-5] * y[0].sum() - np.log(norm).sum()
        for a in range(2):
            for b in range(2):
                pair = ahead[:-1, :, a] * moves[a, b] * onward[:, :, b]
                taken = (y[:-1] == a) & (y[1:] == b)
                grad[-4 + 2 * a + b] = (taken - pair)[self.after].sum()
                value += theta[-4 + 2 * a + b] * taken[self.after].sum()
        return float(value / n - self.penalty * (theta**2).sum() / 2), grad / n - self.penalty * theta


def fit(pages: list[str], rounds: int = 200, penalty: float = 2e-4, rate: float = 0.1, least: int = 3) -> Field:
    """Maximise the penalised conditional likelihood of labelled pages by Adam steps over all of them, with the
    features that so many blocks have at least."""
    likelihood = Likelihood(pages, penalty, least)
    theta = np.zeros(len(likelihood.names) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, grad = likelihood(theta)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({f: round(float(theta[i]), 6) for f, i in likelihood.names.items()}, float(theta[-5]), theta[-4:].reshape(2, 2).tolist())


@lru_cache(maxsize=1)
def default_field(pages: int = 1500) -> Field:
    """The field fitted to so many built pages."""
    return fit(made_pages(pages))


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page, field.weights, field.memo)
    return "\n".join(b[1] for b, y in zip(blocks, field.labels(blocks), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; one narrow pass."""
    spark = pages.sparkSession
    bounded_batches(spark)
    field = field or default_field()
    shared = spark.sparkContext.broadcast((field.weights, field.start, field.moves))  # a few thousand weights

    def run(batches):
        own = Field(*shared.value)
        for batch in batches:
            texts = [main_text(h, own) for h in texts_of(batch.column("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
