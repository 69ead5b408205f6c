"""Ids of the public byte-level BPE, by chunks that never share a pre-token.

A pre-token doesn't cross from a non-space character to white space, so a text can be cut there and each chunk
(white space and what follows it) encoded once for a worker, whatever text it stands in.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from tideline.llm.chunks import Pool, any_in_row, split_at_spaces

#: The special token that the vocabulary's JSON form recognises within texts.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256
#: Unicode's White_Space, as the vocabulary's pattern has it; Python's \s has more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_edge = re.compile(f"[{WHITE}]\\Z")


def load(path: str):
    """A tiktoken encoding with the ranks at path and the special token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})


class ByteCodec:
    """Encodes chunks through a bounded cache. Columns of the pool: ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.encoding = load(path)
        self.pool = Pool(lambda chunks: ([np.array(self.ids(c), "<u4").tobytes() for c in chunks],), 1)

    def ids(self, text: str) -> list[int]:
        if END_OF_TEXT in text:
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow array as little-endian unsigned 32-bit bytes."""
        self.pool.renew()
        codes, parts, offsets = split_at_spaces(texts)
        # a part that is empty or ends in other white space may share a pre-token with its neighbour
        plain = np.array([bool(p) and not _edge.search(p) for p in parts], bool)
        odd = any_in_row(~plain[codes], offsets)
        numbers = self.pool.numbers([f" {p}" for p in parts])[codes]
        first = np.flatnonzero(np.diff(offsets))
        numbers[offsets[first]] = self.pool.numbers([parts[c] for c in codes[offsets[first]].tolist()])
        numbers, get = numbers.tolist(), self.pool.columns[0].__getitem__
        bounds = offsets.tolist()
        return [
            np.array(self.ids(texts[i].as_py()), "<u4").tobytes() if slow else b"".join(map(get, numbers[bounds[i] : bounds[i + 1]]))
            for i, slow in enumerate(odd.tolist())
        ]


_codecs: dict[str, ByteCodec] = {}


def codec_at(path: str) -> ByteCodec:
    """This worker's codec for the ranks at path."""
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]
