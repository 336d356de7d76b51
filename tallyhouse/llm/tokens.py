"""Token ids of whole texts, by the ``tokenizers`` library, with the pieces of known words kept.

The vocabulary drops white space and never joins across it, and cuts texts by one pattern into runs that are encoded one
by one. Texts of Latin script are cut here by the same pattern, and each run of a new word is encoded by the tokenizer's
model; any other text (other scripts, combining marks, controls) goes through the tokenizer itself.
"""

from __future__ import annotations

import functools
import re
import struct

#: Distinct words whose ids a worker keeps (about 250 bytes each); further ones are encoded each time.
KEPT_WORDS = 300_000

_PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u024f]*")
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_RUN = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class _Words(dict):
    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        runs = _RUN.findall(word)
        if len(runs) > 1:
            found = b"".join([self[run] for run in runs])
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
            ids = [token.id for token in self.model.tokenize(spelled)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = _Words(self.tokenizer.model)

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
