"""Edit-aware token counts with segment trees.

A document's pre-tokens, cut as the vocabulary's pattern cuts them, lie in the leaves of a height-balanced binary tree, up
to ``LEAF`` pre-tokens in one; every node has the sums of code points and of tokens below it. An edit descends by code
points to the pre-tokens it touches and cuts the changed text anew, from a cut that lies before all that the pattern
could have looked at until a new cut falls on an old one: scanning has no memory, so from there on all cuts are the old
ones. The pre-tokens between are encoded and put into leaves of their own, the tree is joined again and its sums are
updated on the way up; all others keep their counts, whether or not the text has white space and however long an
insert was.

Defined results: null is an empty text; edits are applied in order, each at code points of the text as it then is, and
positions beyond the end are moved to the end; a null array of edits is an empty one, null members of an edit are 0 or
empty; null doc_ids and repeated rows keep rows of their own; an empty table gives an empty result; columns other than
the named ones are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import byte_bpe
from tideline.llm.chunks import Pool, bounded_batches, texts_of

#: Pre-tokens of a leaf at most.
LEAF = 32
#: Code points beyond a cut that the pattern may look at, and those of the special token where one may be near.
LOOK, LOOK_SPECIAL = 3, 16
EDITS = "array<struct<pos:long,del:long,ins:string>>"


class Leaf:
    """Pre-tokens that follow one another, with their numbers of tokens. Those of a new tree are numbers of chunks, whose
    pre-tokens are looked up when an edit comes near."""

    __slots__ = ("_counts", "_pieces", "chars", "height", "leaves", "lookup", "tokens")

    def __init__(self, chars: int, tokens: int, pieces: list[str] | None = None, counts: list[int] | None = None, lookup=None):
        self.chars, self.tokens, self._pieces, self._counts, self.lookup = chars, tokens, pieces, counts, lookup
        self.height, self.leaves = 0, 1

    def _looked_up(self) -> None:
        found, numbers = self.lookup
        pairs = [found[k] for k in numbers]
        self._pieces, self._counts = ([x for pair in pairs for x in pair[side]] for side in (0, 1))

    @property
    def chunks(self) -> list[str]:
        if self._pieces is None:
            self._looked_up()
        return self._pieces

    @property
    def counts(self) -> list[int]:
        if self._counts is None:
            self._looked_up()
        return self._counts


class Node:
    """Two trees after one another, and their sums."""

    __slots__ = ("chars", "height", "leaves", "left", "right", "tokens")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.chars, self.tokens, self.leaves = left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves
        self.height = 1 + max(left.height, right.height)


def _node(left, right):
    """left and right, whose heights differ by two at most, as one balanced tree."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def join(left, right):
    """Two trees, either of which may be missing, after one another."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return _node(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _node(join(left, right.left), right.right)
    return Node(left, right)


def split(tree, leaves: int):
    """The trees of the first so many leaves and of the others; None for none."""
    if tree is None or leaves <= 0:
        return None, tree
    if leaves >= tree.leaves:
        return tree, None
    if leaves <= tree.left.leaves:
        first, rest = split(tree.left, leaves)
        return first, join(rest, tree.right)
    first, rest = split(tree.right, leaves - tree.left.leaves)
    return join(tree.left, first), rest


def balanced(row: list):
    """A balanced tree of leaves; None without any."""

    def over(a: int, b: int):
        return Node(over(a, (a + b) // 2), over((a + b) // 2, b)) if b - a > 1 else row[a]

    return over(0, len(row)) if row else None


def build(pieces: list[str], counts: list[int]):
    """A balanced tree of pre-tokens; None without any."""
    cut = ((pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF))
    return balanced([Leaf(sum(map(len, p)), sum(c), p, c) for p, c in cut])


def leaves_of(tree):
    """The leaves of a tree in order."""
    open_ = [tree] if tree is not None else []
    while open_:
        at = open_.pop()
        if at.height:
            open_ += (at.right, at.left)
        else:
            yield at


class TokenTree:
    """Counts of one text that follow its edits. count gives the pre-tokens of a text and their numbers of tokens."""

    def __init__(self, text: str, count: Counter):
        self.count = count
        leaves, pieces = count.leaves(text)
        self.root = balanced(leaves)
        #: Pre-tokens at first, and pre-tokens that edits encoded.
        self.segments, self.reencoded = pieces, 0

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def text(self) -> str:
        return "".join(c for leaf in leaves_of(self.root) for c in leaf.chunks)

    def _leaf_at(self, pos: int) -> tuple[int, int, Leaf]:
        """Number of the leaf that holds a position, the position within it, and the leaf; the end is in the last one."""
        at, number = self.root, 0
        while at.height:
            if pos >= at.left.chars:
                pos, number, at = pos - at.left.chars, number + at.left.leaves, at.right
            else:
                at = at.left
        return number, pos, at

    def edit(self, pos: int, delete: int, insert: str) -> None:
        pos = min(max(pos, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - pos)
        if not delete and not insert:
            return
        if not self.root:
            leaves, pieces = self.count.leaves(insert)
            self.root = balanced(leaves)
            self.reencoded += pieces
            return
        low, inside, _ = self._leaf_at(pos)
        high, _, _ = self._leaf_at(pos + delete)
        while not self._edited(low, high, inside, delete, insert):
            # what was gathered is too little to tell the cuts; inside counts from the first leaf
            wider = max(0, low - 1), min(self.root.leaves - 1, 2 * high - low + 1)
            inside += sum(leaf.chars for leaf in leaves_of(split(split(self.root, low)[0], wider[0])[1])) if low else 0
            low, high = wider

    def _edited(self, low: int, high: int, inside: int, delete: int, insert: str) -> bool:
        """Edit at a place within the leaves from low to high; False if they are too few."""
        before, rest = split(self.root, low)
        middle, after = split(rest, high - low + 1)
        chunks = [c for leaf in leaves_of(middle) for c in leaf.chunks]
        counts = [n for leaf in leaves_of(middle) for n in leaf.counts]
        ends = list(accumulate(map(len, chunks)))
        old = "".join(chunks)
        stop = inside + delete
        near = old[max(0, inside - LOOK_SPECIAL) : stop + LOOK_SPECIAL] + insert
        look = LOOK_SPECIAL if "<" in near else LOOK
        if (inside < LOOK_SPECIAL and before is not None) or (len(old) - stop < LOOK_SPECIAL and after is not None):
            return False
        a = bisect_right(ends, inside - look)  # pre-tokens that stay: their ends lie so far before
        if not a and before is not None:
            return False
        begin = ends[a - 1] if a else 0
        shift = len(insert) - delete
        b = bisect_right(ends, stop - 1)  # the first end at or beyond the edit's
        reach = 8
        while True:
            last = ends[min(b + reach, len(ends) - 1)]
            new = self.count.pieces(old[begin:inside] + insert + old[stop:last])
            whole = after is None and last == len(old)
            place, wanted = begin, {e + shift: k for k, e in enumerate(ends[b : b + reach + 1], b)}
            for n, piece in enumerate(new, 1):
                place += len(piece)
                met = wanted.get(place)
                if met is not None and (whole or place <= last + shift - look):
                    return self._put(before, after, chunks, counts, a, met + 1, new[:n])
            if whole:  # nothing is left behind the edit, or the new text is empty
                return self._put(before, after, chunks, counts, a, len(chunks), new)
            if last == len(old):
                return False
            reach *= 4

    def _put(self, before, after, chunks: list[str], counts: list[int], a: int, b: int, new: list[str]) -> bool:
        self.reencoded += len(new)
        tree = build([*chunks[:a], *new, *chunks[b:]], [*counts[:a], *self.count.tokens(new), *counts[b:]])
        self.root = join(join(before, tree), after)
        return True


#: Letters and numbers below U+0250, where the pattern can be had without tables of Unicode.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾"
_low = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{byte_bpe.WHITE}{LETTERS}{NUMBERS}]+|[{byte_bpe.WHITE}]+(?![^{byte_bpe.WHITE}])|[{byte_bpe.WHITE}]+").findall


class Counter:
    """Pre-tokens of texts and their numbers of tokens, with bounded caches: of chunks (white space and what follows it),
    which end where pre-tokens end, and of single pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        codec = byte_bpe.codec_at(path)
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.single = Pool(lambda pieces: ([len(codec.ids(p)) for p in pieces],), 1)
        self.chunks = Pool(self._cut_and_counted, 1)
        #: Code points, tokens and pre-tokens of the chunks by number.
        self.sums = np.zeros((1 << 12, 3), np.int64)

    def _cut_and_counted(self, chunks: list[str]) -> tuple[list]:
        pieces = [self.pieces(c) for c in chunks]
        counts = iter(self.tokens(list(chain.from_iterable(pieces))))
        pairs = [(p, [next(counts) for _ in p]) for p in pieces]
        first = len(self.chunks.index)
        while first + len(chunks) > len(self.sums):
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
        self.sums[first : first + len(chunks)] = [(len(c), sum(n), len(p)) for c, (p, n) in zip(chunks, pairs, strict=True)]
        return (pairs,)

    def renew(self) -> None:
        self.single.renew()
        self.chunks.renew()

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; the special token is one of its own."""
        if byte_bpe.END_OF_TEXT not in text:
            if text.isascii() or max(text) < "\u0250":
                return _low(text)
            return [text[a:b] for _, (a, b) in self.cut(text)]
        parts = text.split(byte_bpe.END_OF_TEXT)
        return [x for k, part in enumerate(parts) for x in ([byte_bpe.END_OF_TEXT] if k else []) + (self.pieces(part) if part else [])]

    def tokens(self, pieces: list[str]) -> list[int]:
        return list(map(self.single.columns[0].__getitem__, self.single.numbers(pieces).tolist()))

    def leaves(self, text: str) -> tuple[list[Leaf], int]:
        """Leaves of a whole text in order, and its number of pre-tokens; chunks stay whole, so a leaf holds as many as
        begin within ``LEAF`` pre-tokens."""
        numbers = self.chunks.numbers(byte_bpe.CHUNK.findall(text))
        if not len(numbers):
            return [], 0
        ends = np.cumsum(self.sums[numbers], axis=0)
        before = ends[:, 2] - self.sums[numbers, 2]
        starts = np.flatnonzero(np.diff(before // LEAF, prepend=-1))
        stops = [*starts[1:].tolist(), len(numbers)]
        totals = np.diff(ends[np.array(stops) - 1], axis=0, prepend=np.zeros((1, 3), np.int64)).tolist()
        found, listed, out = self.chunks.columns[0], numbers.tolist(), []
        for a, b, (chars, tokens, pieces) in zip(starts.tolist(), stops, totals, strict=True):
            if pieces > 2 * LEAF:  # of a chunk without white space
                own = Leaf(0, 0, lookup=(found, listed[a:b]))
                out += leaves_of(build(own.chunks, own.counts))
            else:
                out.append(Leaf(chars, tokens, lookup=(found, listed[a:b])))
        return out, int(ends[-1, 2])


_counters: dict[str, Counter] = {}


def counter_at(path: str) -> Counter:
    """This worker's counter for the ranks at path."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_edited(docs: DataFrame, edits: Column, ranks_path: str) -> DataFrame:
    """doc_id, n_chars, n_segments and n_tokens of every document, and n_edits, edited_chars, edited_tokens and
    reencoded_segments after its edits, a column of docs of the type EDITS."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        count = counter_at(ranks_path)
        for batch in batches:
            count.renew()
            columns = [[] for _ in range(7)]
            for text, changes in zip(texts_of(batch.column("text")).to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = TokenTree(text, count)
                row = [tree.n_chars, tree.segments, tree.n_tokens]
                changes = [c for c in changes or [] if c]
                for c in changes:
                    tree.edit(c["pos"] or 0, c["del"] or 0, c["ins"] or "")
                for c, v in zip(columns, [*row, len(changes), tree.n_chars, tree.n_tokens, tree.reencoded], strict=True):
                    c.append(v)
            names = ["n_chars", "n_segments", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "reencoded_segments"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    schema = "doc_id long, n_chars long, n_segments long, n_tokens long, n_edits long, edited_chars long, edited_tokens long, reencoded_segments long"
    return docs.select("doc_id", "text", edits.cast(EDITS).alias("edits")).mapInArrow(run, schema)


def standard_edits(text: Column) -> Column:
    """Three edits of any text: words put in at a quarter, seven code points deleted at the half, and five replaced at
    three quarters (of the text's own length)."""
    n = F.char_length(F.coalesce(text, F.lit(""))).cast("long")

    def one(quarter: int, delete: int, insert: str) -> Column:
        return F.struct(F.floor(n * quarter / 4).cast("long").alias("pos"), F.lit(delete).cast("long").alias("del"), F.lit(insert).alias("ins"))

    return F.array(one(1, 0, " an inserted phrase"), one(2, 7, ""), one(3, 5, "replaced it's\n"))


def count_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Counts of every document before and after the standard edits."""
    return count_edited(docs, standard_edits(F.col("text")), ranks_path)


def leaf_counts(text: str, ranks_path: str) -> list[tuple[int, int, int]]:
    """Start, code points and tokens of each pre-token of a text."""
    leaves, _ = counter_at(ranks_path).leaves(text)
    pieces, counts = ([x for leaf in leaves for x in getattr(leaf, side)] for side in ("chunks", "counts"))
    starts = accumulate(map(len, pieces), initial=0)
    return [(s, len(c), k) for s, c, k in zip(starts, pieces, counts, strict=False)]
