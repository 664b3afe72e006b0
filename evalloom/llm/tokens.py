"""Tokenising whole texts with the ``tokenizers`` library, each distinct chunk once.

A text is cut where no token can cross: at white space for vocabularies that drop it, and before
each run of white space for byte-level vocabularies.  Chunks are encoded by the library and kept in
a bounded memo, so the ids are those of encoding the whole text.  Texts with the separators
U+001C to U+001F, on which Python and the library disagree, are encoded whole, and so are texts that
spell one of the vocabulary's added tokens, which the library finds before anything else.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_CHUNKS = re.compile(r"\s*\S+|\s+").findall
_ODD = "\x1c\x1d\x1e\x1f"
_PLAIN = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@[-`{-~]*)").fullmatch
# How byte-level vocabularies write the bytes 128 to 255; printable Latin-1 stays itself.
_HIDDEN = [*range(0x7F, 0xA1), 0xAD]
_BYTES = {b: 0x100 + 33 + i for i, b in enumerate(_HIDDEN)}
_ENCODERS: dict[tuple, ChunkEncoder] = {}


class ChunkEncoder:
    """``lead``: white space is kept and belongs to the chunk it precedes; else it is dropped.

    Chunks that were not met for a while leave the memo: it has two generations of ``most`` entries,
    and what is still used moves to the younger one.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = list(self.tok.get_added_tokens_decoder().values())
        self.marks_whole = [*_ODD, *(t.content for t in added)]
        # An added token may be looked for in the normalised text, that is, without case.
        folded = [re.escape(t.content) for t in added if t.normalized]
        self.folded = re.compile("|".join(folded), re.IGNORECASE).search if folded else None
        self.lead = bool(self.tok.encode(" ", add_special_tokens=False).ids)
        self.fold = self.tok.encode("A", add_special_tokens=False).ids == self.tok.encode("a", add_special_tokens=False).ids
        self.model = self.tok.model
        self.most = most
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, space: str, letters: str, marks: str) -> bytes:
        """One word of Latin letters, with at most one space before and ASCII marks after: the pre-tokenizer
        makes these two tokens at most, so the library's model is asked directly."""
        word = letters.lower() if self.fold else letters
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        got = self._ids("\u0120" + word if space and self.lead else word)
        if marks:
            if marks not in self.marks:
                self.marks[marks] = self._ids(marks)
            got += self.marks[marks]
        return got

    def _ids(self, token: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(token)]).tobytes()

    def _miss(self, chunks: set[str]) -> None:
        if len(self.marks) > self.most:
            self.marks = {}
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}
        memo, old, hard = self.memo, self.old, []
        for c in chunks:
            if c in memo:
                continue
            if (got := old.get(c)) is not None:
                memo[c] = got
            elif m := _PLAIN(c):
                memo[c] = self._plain(*m.groups())
            else:
                hard.append(c)
        if hard:
            memo.update(zip(hard, self._raw(hard), strict=True))

    def whole(self, text: str) -> bool:
        """Whether a text must not be cut."""
        return any(m in text for m in self.marks_whole) or bool(self.folded and self.folded(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for text in texts:
            if self.whole(text):
                out.append(self._raw([text])[0])
                continue
            chunks = _CHUNKS(text) if self.lead else text.split()
            try:
                out.append(b"".join(map(self.memo.__getitem__, chunks)))
            except KeyError:
                self._miss(set(chunks))
                out.append(b"".join(map(self.memo.__getitem__, chunks)))
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    key = (path,)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path)
    return _ENCODERS[key]
