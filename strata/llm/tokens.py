"""Token ids of whole texts, with a bounded memo of space-delimited chunks.

Byte-level BPE splits a text before any single space that stands between two
non-space characters, whatever surrounds it. Texts are cut there, equal chunks
are encoded once, and the ids are concatenated: the same ids as for the whole
text, many times faster on prose.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import filterfalse, pairwise

import numpy as np

from strata.llm import caches

# Chunks kept in a worker's memo; the older half of the traffic is forgotten beyond it.
# A dict of 699,051 or more takes twice the room.
MEMO_CHUNKS = 680_000
# Longer chunks are encoded each time, so that the memo stays small.
MEMO_CHUNK_CHARS = 40
# How byte-level vocabularies write a space.
SPACE = "\u0120"

# Python's \s holds all that the tokenizer takes for white space, and more.
_ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary = self.tokenizer.get_vocab_size()
        # Ids of the pieces that begin with a space.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for piece, i in vocabulary.items() if piece.startswith(SPACE)]] = True
        # Letters and a closing mark after them are always different pieces.
        self.marks = {c: self._plain([c])[0] for c in ",."}
        # Ids of " " + chunk by chunk.
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in encoded]

    def _spaced(self, joined: str, chunks: list[str]) -> list[bytes]:
        """Ids of " " + chunk for each, from one call on ``joined``, the chunks each after a space.

        If no chunk holds a space of its own, only its first piece begins with
        one, so the ids fall apart there.
        """
        if joined.count(" ") == len(chunks):
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(chunks) and at[0] == 0:
                raw, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                return [raw[a:b] for a, b in pairwise(cuts)]
        return self._plain([" " + c for c in chunks])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0].isspace() or text[-1].isspace():
            return self._joined(_SAFE_CUT.split(text))
        # Every space stands alone here; what is flanked by other white space shows up as a new chunk.
        out = self._joined(text.split(" "), flanked=True)
        return self._joined(_SAFE_CUT.split(text)) if out is None else out

    def _joined(self, chunks: list[str], flanked: bool = False) -> bytes | None:
        """Ids of the chunks joined by spaces; None if ``flanked`` and a chunk begins or ends with white space."""
        if flanked and chunks[0][-1].isspace():
            return None
        head = self._plain([chunks[0]])[0]
        if len(chunks) == 1:
            return head
        del chunks[0]
        new, old, long = self.new, self.old, {}
        absent = set(filterfalse(new.__contains__, chunks))
        if absent:
            missing, marked, marks = {}, [], self.marks
            for c in absent:
                if c in old:
                    new[c] = old.pop(c)
                elif c[-1] in marks and len(c) <= MEMO_CHUNK_CHARS and c[-2:-1].isalpha():
                    marked.append(c)
                    word = c[:-1]
                    if word in old:
                        new[word] = old.pop(word)
                    elif word not in new:
                        missing[word] = None
                else:
                    missing[c] = None
            if missing:
                joined = " " + " ".join(missing)
                if not _ODD_SPACE.search(joined, 1):
                    encoded = self._spaced(joined, list(missing))
                elif flanked and any(c[0].isspace() or c[-1].isspace() for c in missing):
                    return None
                else:
                    encoded = self._plain([" " + c for c in missing])
                for c, ids in zip(missing, encoded, strict=True):
                    # Only a text's last chunk can end with white space, and it isn't kept.
                    (new if len(c) <= MEMO_CHUNK_CHARS and not c[-1].isspace() else long)[c] = ids
            for c in marked:
                new[c] = new[c[:-1]] + self.marks[c[-1]]
        if long:
            out = b"".join([long[c] if c in long else new[c] for c in chunks])
        else:
            out = b"".join(map(new.__getitem__, chunks))
        if len(new) > MEMO_CHUNKS:
            self.new, self.old = {}, new
        return head + out


_encoders: dict[str, Encoder] = {}


def _forget() -> None:
    for e in _encoders.values():
        e.new, e.old = {}, {}


caches.remembers("tokens", _forget)


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary file, kept between tasks."""
    caches.enter("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
