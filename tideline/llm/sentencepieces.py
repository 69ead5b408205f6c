"""SentencePiece encoding and decoding by vectorised merge rounds.

A BPE model merges the adjacent pair of the best score, leftmost first, until no pair is left. Pieces never have the
space symbol after another character, so a text falls into words (a run of space symbols and what follows it) that
merge apart from each other. All words that a worker hasn't met are encoded together: their symbols lie in one flat
numpy array; each round finds the best pair of every word by a segmented minimum of pair ranks, merges its
occurrences from the left without overlap, compacts the array and retires the words without a pair. A word with a run of
space symbols before it is a word of its own in the same array, apart from the run.

Merging all occurrences at once equals one at a time unless the new symbol can take part in a better pair than the
one just merged; for such pieces, found when the model is loaded, only the leftmost occurrence merges in a round. Words of
more than ``LONG`` symbols, where that would take as many rounds as there are occurrences, keep their pairs in a queue by
rank and place instead and merge one at a time, so their cost stays near linear in their length. Runs of space symbols have pieces of one score and are merged by a plain loop from the left.

Defined results: null is an empty text (only the end id, decoded to an empty text); ids of a text don't depend on its
neighbours; long texts are encoded whole; null and repeated doc_ids and rows keep rows of their own; an empty table gives
an empty result; input columns other than doc_id and text are ignored, so names can't clash.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tideline.llm.chunks import Pool, bounded_batches, split_at_spaces, texts_of

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Symbols up to which a word merges by rounds.
LONG = 256


class PieceModel:
    """A BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with an identity normaliser and a dummy prefix are supported")
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.eos = proto.trainer_spec.eos_id
        self.byte_ids = [0] * 256
        for i, kind in enumerate(kinds):
            if kind == 6:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        normal = {p: i for i, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)) if kind in (1, 4)}
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in normal):
            raise ValueError("a piece has a space symbol behind another character")
        self.runs = {len(p): i for p, i in normal.items() if not p.strip(SPACE)}
        self.known_runs: dict[int, list[int]] = {}
        self.space = normal[SPACE]
        self.as_bytes = [
            bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else p.replace(SPACE, " ").encode()
            for p, kind in zip(self.pieces, kinds, strict=True)
        ]
        self._tables(normal, [p.score for p in proto.pieces])
        self.merges: dict[int, int] | None = None  # pairs of long words, made when the first one comes

    def _tables(self, normal: dict[str, int], scores: list[float]) -> None:
        v = len(self.pieces)
        symbols = dict(normal)  # single characters that occur in pieces only get numbers from v on
        for p in normal:
            for c in p:
                symbols.setdefault(c, v + len(symbols) - len(normal))
        self.known = len(symbols) - len(normal) + v
        self.chars = np.arange(0x110000, dtype=np.int32) + np.int32(self.known)  # unknown ones: known + code point
        self.code_point = {}
        for s, i in symbols.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
                self.code_point[i] = ord(s)
        order = sorted({scores[i] for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = np.full(v, NONE, np.int32)
        tied = np.bincount([rank_of[scores[i]] for p, i in normal.items() if p.strip(SPACE)], minlength=len(order))
        self.single = np.zeros(v, bool)
        pairs: dict[int, list[tuple[int, int]]] = {}
        for p, i in normal.items():
            self.rank[i] = rank_of[scores[i]]
            if len(p) < 2 or not p.strip(SPACE):
                continue
            if tied[self.rank[i]] > 1:
                self.single[i] = True
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs.setdefault(a, []).append((b, i))
        for found in pairs.values():
            for b, i in found:
                if b < v and self.rank[b] >= self.rank[i]:
                    self.single[b] = True
        for a, found in pairs.items():
            if a < v and any(self.rank[i] <= self.rank[a] for _, i in found):
                self.single[a] = True
        # the pairs of a left symbol lie at base[left] + right; owner tells whose an entry is
        count = sum(map(len, pairs.values()))
        room = 8 * count + self.known
        self.base = np.zeros(self.known + 1, np.int32)
        self.owner = np.full(room + self.known + 1, -1, np.int32)
        self.into = np.zeros(room + self.known + 1, np.int32)
        rng = np.random.default_rng(7)
        for a, found in sorted(pairs.items(), key=lambda x: -len(x[1])):
            right = np.array([b for b, _ in found])
            while True:
                tries = rng.integers(0, room, 16)
                free = (self.owner[tries[:, None] + right] < 0).all(axis=1)
                if free.any():
                    at = int(tries[np.argmax(free)])
                    break
            self.base[a] = at
            self.owner[at + right] = a
            self.into[at + right] = [i for _, i in found]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each of them at most one space symbol followed by other characters."""
        if any(len(w) > LONG for w in words):
            short = iter(self.encode_words([w for w in words if len(w) <= LONG]))
            return [next(short) if len(w) <= LONG else self._encode_long(w) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.chars[points], np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            left = np.minimum(sym[:-1], self.known)
            at = self.base[left] + np.minimum(sym[1:], self.known)
            hit = (self.owner[at] == left) & (word[1:] == word[:-1])
            into = self.into[at]
            rank = np.full(len(sym), NONE, np.int32)
            rank[:-1][hit] = self.rank[into[hit]]
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            here = np.repeat(least, sizes)
            live = here < NONE
            best = np.flatnonzero((rank == here) & live)
            if len(best):
                # of overlapping occurrences every second one merges, from the left
                new_run = np.concatenate(([True], np.diff(best) != 1))
                run_start = best[np.maximum.accumulate(np.where(new_run, np.arange(len(best)), 0))]
                pick = (best - run_start) % 2 == 0
                alone = self.single[into[best]]
                if alone.any():
                    w = word[best]
                    pick &= ~alone | np.concatenate(([True], w[1:] != w[:-1]))
                best = best[pick]
                sym[best] = into[best]
                live[best + 1] = False
                gone = np.zeros(len(sym), bool)
                gone[best + 1] = True
            else:
                gone = np.zeros(len(sym), bool)
            over = ~live & ~gone
            done_sym.append(sym[over])
            done_word.append(word[over])
            sym, word = sym[live], word[live]
        if not done_sym:
            return [[] for _ in words]
        flat, of = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(of, kind="stable")
        flat, ends = flat[order], np.cumsum(np.bincount(of, minlength=len(words)))
        odd = set(of[order][flat >= len(self.pieces)].tolist())
        ids, begin, out = flat.tolist(), 0, []
        for w, end in enumerate(ends.tolist()):
            one = ids[begin:end]
            out.append(one if w not in odd else [x for i in one for x in self._bytes(i)])
            begin = end
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols, whether they merge and into which piece."""
        left, right = np.minimum(left, self.known), np.minimum(right, self.known)
        at = self.base[left] + right
        return self.owner[at] == left, self.into[at]

    def _encode_long(self, word: str) -> list[int]:
        """Ids of one word by a queue of its pairs: best rank first, then leftmost."""
        if self.merges is None:
            at = np.flatnonzero(self.owner >= 0)
            keys = self.owner[at].astype(np.int64) << 32 | at - self.base[self.owner[at]]
            self.merges = dict(zip(keys.tolist(), self.into[at].tolist(), strict=True))
            self.ranks = self.rank.tolist()
        sym = self.chars[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)]
        hit, into = self._pairs(sym[:-1], sym[1:])
        first = np.flatnonzero(hit)
        queue = (self.rank[into[first]].astype(np.int64) << 32 | first).tolist()
        heapify(queue)
        sym, n, merges, ranks = sym.tolist(), len(sym), self.merges, self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            key = heappop(queue)
            i = key & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            new = merges.get(sym[i] << 32 | sym[j])
            if new is None or ranks[new] != key >> 32:
                continue
            k, h = after[j], before[i]
            sym[i], sym[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                if (piece := merges.get(new << 32 | sym[k])) is not None:
                    heappush(queue, ranks[piece] << 32 | i)
            if h >= 0 and (piece := merges.get(sym[h] << 32 | new)) is not None:
                heappush(queue, ranks[piece] << 32 | h)
        return [x for s in sym if s >= 0 for x in self._bytes(s)]

    def _bytes(self, symbol: int) -> list[int]:
        if symbol < len(self.pieces):
            return [symbol]
        point = self.code_point.get(symbol, symbol - self.known)
        return [self.byte_ids[b] for b in chr(point).encode("utf-8", "surrogatepass")]

    def encode_run(self, n: int) -> list[int]:
        """Ids of a run of n space symbols: equal scores, so always the leftmost pair that has a piece."""
        if n not in self.known_runs:
            parts, i = [1] * n, 0
            out: list[int] = []
            while i < len(parts):
                size = parts[i]
                while True:
                    if out and out[-1] + size in self.runs:
                        size += out.pop()
                    elif i + 1 < len(parts) and size + 1 in self.runs:
                        size, i = size + 1, i + 1
                    else:
                        break
                out.append(size)
                i += 1
            if len(self.known_runs) > 1000:
                self.known_runs.clear()
            self.known_runs[n] = [self.runs[s] for s in out]
        return self.known_runs[n]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts of texts, as parts_of gives them: m spaces and a word stand for m + 1 space symbols and the
        word, and m spaces alone for m symbols."""
        words = [p.lstrip(" ") for p in parts]
        ids = iter(self.encode_words([SPACE + w for w in words if w]))
        out = []
        for part, word in zip(parts, words, strict=True):
            run = len(part) - len(word)
            if not word:
                out.append(self.encode_run(run))
                continue
            found = next(ids)
            if run and found[0] == self.space:
                found = self.encode_run(run + 1) + found[1:]
            elif run:
                found = self.encode_run(run) + found
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without an end id."""
        codes, parts, _ = parts_of(pa.array([text], pa.large_string()))
        ids = self.encode_parts(parts)
        return [x for c in codes.tolist() for x in ids[c]]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are put together, control pieces vanish, the dummy prefix goes."""
        joined = b"".join(self.as_bytes[i] for i in ids)
        return joined[joined.startswith(b" ") :].decode("utf-8", "replace")


def parts_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The texts as codes of parts, the parts, and the offsets by text. A part is a word that follows one space symbol
    (the model's own before the first), with the spaces before that, or the spaces that a text ends with."""
    codes, parts, offsets = split_at_spaces(pc.replace_substring(texts, SPACE, " "))
    if "" not in parts:
        return codes, parts, offsets
    empty = codes == parts.index("")
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    last = np.zeros(len(codes), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    # an empty text is one empty part, of which nothing stays
    kept = np.flatnonzero(~empty | last & (np.diff(offsets) > 1)[row])
    own = row[kept]
    before = np.where(np.concatenate(([True], own[1:] != own[:-1])), offsets[own] - 1, np.concatenate(([-1], kept[:-1])))[: len(kept)]
    runs = kept - before - 1 + empty[kept]
    codes = codes[kept]
    several = np.flatnonzero(runs)
    spaced = [" " * n + parts[c] for n, c in zip(runs[several].tolist(), codes[several].tolist(), strict=True)]
    number = {p: len(parts) + i for i, p in enumerate(dict.fromkeys(spaced))}
    codes[several] = [number[p] for p in spaced]
    used, codes = np.unique(codes, return_inverse=True)
    parts = [*parts, *number]
    return codes, [parts[i] for i in used.tolist()], np.searchsorted(own, np.arange(len(texts) + 1))


_models: dict[str, tuple[PieceModel, Pool]] = {}


def model_at(path: str) -> tuple[PieceModel, Pool]:
    """The model and this worker's cache of parts (number of ids, ids as text, decoded bytes), both made once in a
    worker."""
    if path not in _models:
        model = PieceModel(path)

        def make(parts: list[str]):
            ids = model.encode_parts(parts)
            return (
                [len(x) for x in ids],
                [(" ".join(map(str, x)) + " ").encode() for x in ids],
                [b"".join([model.as_bytes[i] for i in x]) for x in ids],
            )

        _models[path] = model, Pool(make, 3)
    return _models[path]


def _numbers(texts: pa.Array, pool: Pool) -> list[list[int]]:
    """The pool's numbers of the parts of each text."""
    pool.renew()
    codes, parts, offsets = parts_of(texts)
    numbers, bounds = pool.numbers(parts)[codes].tolist(), offsets.tolist()
    return [numbers[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _digests(batches, path: str):
    model, pool = model_at(path)
    end = b"%d" % model.eos
    for batch in batches:
        mine = _numbers(texts_of(batch.column("text")), pool)
        lengths, ids_text, decoded = (c.__getitem__ for c in pool.columns)
        n, ids_sha, text_sha = [], [], []
        for own in mine:
            text = b"".join(map(decoded, own))
            n.append(sum(map(lengths, own)) + 1)
            ids_sha.append(hashlib.sha256(b"".join(map(ids_text, own)) + end).hexdigest())
            text_sha.append(hashlib.sha256(text[text.startswith(b" ") :]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_decode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; one narrow pass without a shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _digests(it, model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_texts(docs: DataFrame, model_path: str, end: bool = True) -> DataFrame:
    """doc_id and the ids of every document as an array."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        model, pool = model_at(model_path)
        for batch in batches:
            mine = _numbers(texts_of(batch.column("text")), pool)
            found = pool.columns[1].__getitem__
            ids = [[*map(int, b"".join(map(found, own)).split()), *[model.eos] * end] for own in mine]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of an array column ids; a null array gives an empty text."""

    def run(batches):
        model, _ = model_at(model_path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
