"""Language identification by segmentation-marginalised unigrams.

A language gives every piece of a fixed public vocabulary a probability, and a word (a run of letters, lower-cased) the
sum, over all segmentations into pieces, of the products of their probabilities: a forward pass over the word's
lattice, rescaled as it goes, so that words may have any length. A text's likelihood is the product over its words.
Piece probabilities come from expectation-maximisation over the word counts of a bounded sample of rows, ``per_lang``
of each language, with a forward and a backward pass, a language in a task; long words are learned from by segments.
Every whole text is scored in one narrow pass.

Defined results: a null text or one without a letter is ``und`` with score 0; languages are the non-null, non-empty
values of lang among the rows that may be learned from, and without any every text is ``und``; a row without a doc_id
isn't held out and isn't learned from; ties go to the language that sorts first; repeated rows keep rows of their own,
and are learned from once; columns other than doc_id, text and lang are ignored; of more languages than a table of
``MOST_BYTES`` holds (about 800) those with the most rows are learned, ties going to the one that sorts first.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.chunks import Pool, bounded_batches, split_at_spaces, texts_of
from tideline.session import Scratch

PER_LANG = 1000
ROUNDS = 4
SMOOTH = 0.5
#: Chance of a character that no piece has.
UNSEEN = 1e-9
#: A forward value below the first is multiplied by the second, and so are those that are still to be used.
TINY, HUGE = 1e-100, 1e100
#: Letters of a piece of a long word that are taken at once, and cells of a forward table.
SEGMENT, CELLS = 4096, 1 << 21
#: Size of the broadcast table of probabilities.
MOST_BYTES = 1 << 27
SPACE = "▁"
_run = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _alphabetic() -> re.Pattern:
    """Runs of letters as str.isalpha has them; \\w knows numbers of other kinds than digits, too."""
    other = "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha())
    return re.compile(f"[^\\W\\d_{re.escape(other)}]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, each behind a space symbol."""
    found = _run.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = [w for run in found for w in _alphabetic().findall(run)]
    return [SPACE + w for w in found]


class Lattices:
    """All pieces within words, found by a trie whose edges lie in one sorted array."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.chars = np.full(0x110000, len(letters), np.int32)
        self.chars[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width = len(letters) + 1
        nodes: dict[tuple[int, str], int] = {}
        ends = {}
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ends[at] = i
        keys = np.array([at * self.width + int(self.chars[ord(c)]) for at, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def edges(self, words: list[str]):
        """Word, first and last position and piece (n for an unseen character) of each edge, sorted by the last
        position and then the word; and the words' lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.chars[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - start[word]
        last = (start + lengths)[word]
        begin, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        step = 0
        while len(begin):
            key = state * self.width + codes[begin + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            if step == 0:  # a character that starts no piece
                lone = begin[(~ok) | (self.piece[self.to[at]] < 0)]
                found.append((word[lone], place[lone], place[lone] + 1, np.full(len(lone), self.n)))
            begin, state = begin[ok], self.to[at[ok]]
            piece = self.piece[state]
            hit = piece >= 0
            b = begin[hit]
            found.append((word[b], place[b], place[b] + step + 1, piece[hit]))
            step += 1
            more = begin + step < last[begin]
            begin, state = begin[more], state[more]
        w, i, j, p = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((w, j))
        return w[order], i[order], j[order], p[order], lengths

    def forward(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word, by language. chance: by piece and language."""
        out = np.zeros((len(words), chance.shape[1]))
        for at in _batches(words, CELLS // chance.shape[1] if chance.shape[1] else 0):
            if len(words[at[0]]) > SEGMENT:
                for i in at:
                    out[i] = self._long(words[i], chance)
            else:
                w, i, j, p, lengths = self.edges([words[k] for k in at])
                alpha, scale = self._alpha(w, i, j, p, len(lengths), int(lengths.max()), chance)
                out[at] = np.log(alpha[np.arange(len(lengths)), lengths]) + scale
        return out

    def _alpha(self, w, i, j, p, n, longest, chance, before=None):
        """Forward values of words by position and language, and the logs of what each word's last ones are to be
        multiplied with; before: the values of the first positions of a single word."""
        alpha, scale = np.zeros((n, longest + 1, chance.shape[1])), np.zeros((n, chance.shape[1]))
        if before is None:
            alpha[:, 0] = 1
        else:
            alpha[0, : len(before)] = before
        for a, b in _runs(j):
            add = alpha[w[a:b], i[a:b]] * chance[p[a:b]]
            first = np.flatnonzero(np.concatenate(([True], w[a + 1 : b] != w[a : b - 1])))
            own, here = w[a:b][first], np.add.reduceat(add, first)
            alpha[own, j[a]] = here
            if here.min() < TINY:
                k, c = np.nonzero(here < TINY)
                k = own[k]
                back = np.arange(max(0, j[a] - self.longest), j[a] + 1)
                alpha[k[:, None], back, c[:, None]] *= HUGE
                scale[k, c] -= np.log(HUGE)
        return alpha, scale

    def _long(self, word: str, chance: np.ndarray) -> np.ndarray:
        """forward of one long word, a segment after the other with the values that reach into it."""
        known, scale = np.ones((1, chance.shape[1])), np.zeros(chance.shape[1])
        for at in range(0, len(word), SEGMENT):
            begin = at - len(known) + 1
            w, i, j, p, lengths = self.edges([word[begin : at + SEGMENT]])
            new = j >= len(known)
            alpha, more = self._alpha(w[new], i[new], j[new], p[new], 1, int(lengths[0]), chance, known)
            known, scale = alpha[0, -self.longest :], scale + more[0]
        return np.log(known[-1]) + scale

    def expected(self, words: list[str], counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words with such counts under the probabilities of one language; in logs."""
        out, log = np.zeros(self.n + 1), np.log(chance)
        for at in _batches(words, CELLS):
            if len(words[at[0]]) > SEGMENT:
                for k in at:
                    out += counts[k] * self._expected_long(words[k], log)
                continue
            w, i, j, p, lengths = self.edges([words[k] for k in at])
            all_ = np.arange(len(lengths))
            alpha = np.full((len(lengths), int(lengths.max()) + 1), -np.inf)
            beta = alpha.copy()
            alpha[:, 0], beta[all_, lengths] = 0, 0
            for a, b in _runs(j):
                first = np.flatnonzero(np.concatenate(([True], w[a + 1 : b] != w[a : b - 1])))
                alpha[w[a:b][first], j[a]] = np.logaddexp.reduceat(alpha[w[a:b], i[a:b]] + log[p[a:b]], first)
            order = np.lexsort((w, -i))
            w2, i2, j2, p2 = w[order], i[order], j[order], p[order]
            for a, b in _runs(i2):
                first = np.flatnonzero(np.concatenate(([True], w2[a + 1 : b] != w2[a : b - 1])))
                own = w2[a:b][first]
                beta[own, i2[a]] = np.logaddexp(beta[own, i2[a]], np.logaddexp.reduceat(beta[w2[a:b], j2[a:b]] + log[p2[a:b]], first))
            use = np.exp(alpha[w, i] + log[p] + beta[w, j] - alpha[all_, lengths][w]) * counts[at][w]
            out += np.bincount(p, use, self.n + 1)
        return out


    def _expected_long(self, word: str, log: np.ndarray) -> np.ndarray:
        """expected of one long word: its edges are found for a segment at a time, forward, backward and to be used; only
        the two rows of values are as long as the word."""
        n = len(word)
        alpha, beta, out = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.zeros(self.n + 1)
        alpha[0] = beta[n] = 0

        def edges(at: int):
            # those that end in the positions after at, up to the segment's end
            begin = max(0, at + 1 - self.longest)
            _, i, j, p, _ = self.edges([word[begin : at + SEGMENT]])
            new = j + begin > at
            return i[new] + begin, j[new] + begin, p[new]

        for at in range(0, n, SEGMENT):
            i, j, p = edges(at)
            for a, b in _runs(j):
                alpha[j[a]] = np.logaddexp.reduce(alpha[i[a:b]] + log[p[a:b]])
        for at in reversed(range(0, n, SEGMENT)):
            i, j, p = edges(at)
            for a, b in reversed(_runs(j)):  # beta of an end is complete once all later ends are done
                np.logaddexp.at(beta, i[a:b], beta[j[a]] + log[p[a:b]])
            out += np.bincount(p, np.exp(alpha[i] + log[p] + beta[j] - alpha[n]), self.n + 1)
        return out


def _batches(words: list[str], cells: int):
    """Numbers of words of like length, at most 20,000 and so many cells of a padded table at once; longer words than a
    segment come by themselves."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    batch: list[int] = []
    for k in order:
        n = len(words[k]) + 1
        if batch and (len(batch) == 20_000 or (len(batch) + 1) * n > cells or n > SEGMENT):
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True)) if len(x) else []


def vocabulary(path: str) -> list[str]:
    """Pieces of a public SentencePiece model that consist of lower-case letters, with or without a space symbol."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kept = [p.piece for p in proto.pieces if p.type == 1 and p.piece == p.piece.lower()]
    return [p for p in kept if p == SPACE or (rest := p.removeprefix(SPACE)) and rest.isalpha()]


_lattices: dict[str, Lattices] = {}


def lattices_at(path: str) -> Lattices:
    if path not in _lattices:
        _lattices[path] = Lattices(vocabulary(path))
    return _lattices[path]


def held_out(doc_id):
    """Whether nothing may be learned from a document."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample_counts(docs: DataFrame, per_lang: int, most_langs: int) -> DataFrame:
    """lang, word and n of at most per_lang distinct rows of each language."""
    scratch = Scratch(docs.sparkSession, "langs")
    usable = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND lang != ''").where(~held_out(F.col("doc_id")))
    often = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    sizes = scratch.save(often)
    share = sizes.select("lang", (F.lit(1.2 * per_lang) / F.col("n")).alias("share"))
    mixed = usable.withColumn("draw", F.xxhash64("doc_id", "text", F.lit(5)))
    drawn = mixed.join(F.broadcast(share), "lang").where(F.pmod("draw", F.lit(1_000_003)) / 1_000_003 < F.col("share"))
    distinct = drawn.groupBy("lang", "draw").agg(F.first("text").alias("text"))  # equal draws are repeated rows
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    some = distinct.withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "text")

    def run(batches):
        for batch in batches:
            pairs = [(a, w) for a, t in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")).to_pylist(), strict=True) for w in words_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.string())], ["lang", "word"])

    return some.mapInArrow(run, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def fit(counts: dict[str, int], lattices: Lattices, rounds: int = ROUNDS) -> np.ndarray:
    """The probabilities of pieces, the last one of an unseen character, of a language with such word counts."""
    n = lattices.n
    names, of = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
    chance = np.append(np.full(n, 1 / n), UNSEEN)
    for _ in range(rounds if names else 0):
        use = lattices.expected(names, of, chance)[:n] + SMOOTH / 10
        chance = np.append(use / use.sum(), UNSEEN)
    return chance


def learn(docs: DataFrame, vocabulary_path: str, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the probabilities of pieces by language."""

    def run(key, words):
        words = words.sort_values("word")
        chance = fit(dict(zip(words["word"], words["n"], strict=True)), lattices_at(vocabulary_path))
        import pandas as pd

        return pd.DataFrame({"lang": [key[0]], "chance": [chance.tolist()]})

    most = MOST_BYTES // (8 * (lattices_at(vocabulary_path).n + 1))
    # a group is the word counts of at most per_lang rows
    found = sample_counts(docs, per_lang, most).groupBy("lang").applyInPandas(run, "lang string, chance array<double>")
    rows = sorted(found.collect(), key=lambda r: r.lang)
    return [r.lang for r in rows], np.array([r.chance for r in rows]).T if rows else np.zeros((0, 0))


class _Scorer:
    """Log likelihoods of chunks by language, held for chunks met again."""

    def __init__(self, path: str, chance: np.ndarray):
        self.lattices, self.chance = lattices_at(path), chance
        self.values = np.zeros((1 << 12, chance.shape[1] + 1))
        self.pool = Pool(self._make, 0)

    def _make(self, chunks: list[str]):
        own = [words_of(c) for c in chunks]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        distinct = list(dict.fromkeys(w for ws in own for w in ws))
        first = len(self.pool.index)
        while first + len(chunks) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        self.values[first : first + len(chunks)] = 0
        if distinct and self.chance.shape[1]:
            number = dict(zip(distinct, range(len(distinct)), strict=True))
            logs = self.lattices.forward(distinct, self.chance)[[number[w] for ws in own for w in ws]]
            some = np.flatnonzero(lengths)
            begin = (np.cumsum(lengths) - lengths)[some]
            self.values[first + some, :-1] = np.add.reduceat(logs, begin)
        self.values[first : first + len(chunks), -1] = lengths
        return ()

    def score(self, texts: pa.Array) -> np.ndarray:
        """By text: log likelihoods of the languages, and the number of words."""
        self.pool.renew()
        codes, parts, offsets = split_at_spaces(texts)
        numbers = self.pool.numbers(parts)[codes]
        out = np.zeros((len(texts), self.values.shape[1]))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            out[some] = np.add.reduceat(self.values[numbers], offsets[some])
        return out


def predict(docs: DataFrame, vocabulary_path: str, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(learn(docs, vocabulary_path, per_lang))  # of checked size

    def run(batches):
        names, table = shared.value
        scorer = _Scorer(vocabulary_path, table if names else np.zeros((lattices_at(vocabulary_path).n + 1, 0)))
        for batch in batches:
            logs = scorer.score(texts_of(batch.column("text")))
            found, score = ["und"] * len(logs), np.zeros(len(logs))
            if names:
                best = np.argmax(logs[:, :-1], axis=1)
                rest = np.exp(logs[:, :-1] - logs[np.arange(len(logs)), best][:, None]).sum(axis=1)
                lettered = logs[:, -1] > 0
                found = [names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                score = np.where(lettered, 1 / rest, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
