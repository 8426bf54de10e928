"""Token ids of whole texts with the tokenizers library, cached by word.

The byte-level pattern of the vocabulary never lets a token cross from a
non-space character into white space.  A single space between two non-space
characters goes with the word after it, and a single line break between two
such characters is a token of its own.  A text may therefore be cut before
every such space or line break, and the ids of the pieces, concatenated, are
the ids of the text.  Words repeat, so a piece is encoded once per worker
while it is in the cache.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between two characters that no definition counts as white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line break, by the widest definition.
_RARE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_FIRST = "\0"   # marks the first piece of a text, which has no space before it
_ENCODERS: dict[tuple, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def marked(text: str) -> str | None:
    """The text with its first piece marked and a space before every line
    break, so that its pieces are what lies between spaces; null if it has
    other or doubled white space and must be cut with more care."""
    if (not text or _FIRST in text or text[0].isspace() or text[-1].isspace() or "  " in text
            or "\n\n" in text or " \n" in text or "\n " in text
            or any(c in text for c in _RARE)):
        return None
    return _FIRST + text.replace("\n", " \n")


def cut(text: str) -> list[str]:
    """Keys of the pieces of any text: the first after a mark, the others
    without the space they begin with."""
    if _FIRST in text:
        return [_FIRST + text]
    pieces = _CUT.split(text)
    return [_FIRST + pieces[0], *pieces[1:]]


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes.

    ``cache_entries`` bounds the worker's memory (about 200 bytes an entry).
    A full cache keeps its older half, where the common words are; what is
    dropped is encoded again when met.  Pieces longer than ``cache_chars``
    are not kept.
    """

    def __init__(self, path: str, cache_entries: int = 1_000_000, cache_chars: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        # a byte-level token is written with one character for each byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.cache: dict[str, bytes] = {}
        self.cache_entries, self.cache_chars = cache_entries, cache_chars

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in
                self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that may stand one after the other: encoded as one
        text and cut by the bytes that each id stands for."""
        ids = np.array(self.tok.encode_batch_fast(["".join(pieces)],
                                                  add_special_tokens=False)[0].ids, dtype="<u4")
        sizes = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces),
                            np.int64, len(pieces))
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, keys: list[str]) -> None:
        safe, other = [], []
        for k in keys:
            (other if k[:1] == _FIRST or k[-1:].isspace() or not k else safe).append(k)
        for i in range(0, len(safe), 4096):
            part = safe[i:i + 4096]
            self.cache.update(zip(part, self._joined(
                [k if k[0] == "\n" else " " + k for k in part])))
        self.cache.update(zip(other, self._alone(
            [k[1:] if k[:1] == _FIRST else " " + k for k in other])))

    def _known(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys, learning those that are new."""
        if len(self.cache) > self.cache_entries:
            self.cache = dict(islice(self.cache.items(), self.cache_entries // 2))
        new = [k for k in keys if k not in self.cache]
        self._learn(new)
        out = list(map(self.cache.__getitem__, keys))
        for k in new:
            if len(k) > self.cache_chars:
                del self.cache[k]
        return out

    def _regular(self, texts: list[str]) -> list[bytes]:
        """Ids of texts made by ``marked``: all pieces are numbered by their
        distinct value, and the ids gathered in one go."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        numbered = pieces.values.dictionary_encode()
        ids = self._known(numbered.dictionary.to_pylist())
        # a slice has far fewer than 2**31 ids
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        at = numbered.indices.to_numpy()
        cuts = pieces.offsets.to_numpy()
        del pieces, numbered
        begins, sizes = begins[at], sizes[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        cuts = np.concatenate([[0], ends])[cuts].tolist()
        gather = np.repeat(begins - ends + sizes, sizes)
        gather += np.arange(len(gather), dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")[gather]
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        regular = [marked(t or "") for t in texts]
        fast = iter(self._regular([m for m in regular if m is not None])
                    if any(m is not None for m in regular) else ())
        out = []
        for t, m in zip(texts, regular):
            if m is not None:
                out.append(next(fast))
            else:
                keys = cut(t or "")
                out.append(b"".join(map(dict(zip(d := list(dict.fromkeys(keys)),
                                                 self._known(d))).__getitem__, keys)))
        pa.default_memory_pool().release_unused()
        return out


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file (kept between tasks)."""
    path = path or default_tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def largest_id(path: str | None = None) -> int:
    """The largest id that a vocabulary file can give."""
    from tokenizers import Tokenizer
    return max(Tokenizer.from_file(path or default_tokenizer()).get_vocab(with_added_tokens=True)
               .values())


def slices(texts: pa.Array, rows: int = 8192, size: int = 4_000_000):
    """Index ranges of at most ``rows`` texts and about ``size`` bytes of an
    Arrow array (more only where one text has more), from its offsets alone:
    a batch of long texts is worked on, and turned into Python strings, in
    small parts."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    begin, n = 0, len(lengths)
    while begin < n:
        before = ends[begin - 1] if begin else 0
        end = int(np.searchsorted(ends, before + size)) + 1
        end = min(n, begin + rows, end)
        yield begin, end
        begin = end
