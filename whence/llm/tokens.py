"""Token ids of many texts, by a public tokenizer file."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import groupby

#: Fixed value: how byte-level BPE cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Above U+052F versions of Unicode differ, and `tokenizers` decides.
_UNSETTLED = re.compile("[^\x00-ԯ]")
_BREAK = re.compile(r"(?<!\s) (?!\s)")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Gives the ids that `tokenizers` gives for a byte-level BPE file.

    tiktoken merges by the ranks of the same file, in a fifth of the time.  The
    pattern never joins what stands left of a single space with what stands
    right of it; so a text is cut there, and only words with characters that
    the two may class differently go to `tokenizers`.  Strings of special
    tokens in a text become their ids, as there.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Printable bytes stand for themselves, the others for characters from 256 on.
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        moved = [b for b in range(256) if b not in kept]
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("special tokens that take or ask for what stands beside them")
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in self.special}
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit numbers in this machine's (little-endian) order."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text).tobytes()
        out = array("I")
        for part in self.cut.split(text):
            out.extend([self.special[part]] if part in self.special else self._plain(part))
        return out.tobytes()

    def _plain(self, text: str) -> array:
        if not _UNSETTLED.search(text):
            return array("I", self.merge(text))
        first, *words = _BREAK.split(text)
        out = array("I")
        for unsettled, run in groupby([first, *[" " + w for w in words]], key=lambda w: bool(_UNSETTLED.search(w))):
            part = "".join(run)
            out.extend(self.tokenizer.encode(part, add_special_tokens=False).ids if unsettled else self.merge(part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
