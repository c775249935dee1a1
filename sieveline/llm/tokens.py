"""Token ids of a public byte-level BPE vocabulary, inside Arrow tasks."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Texts whose bytes are all below this (U+0340) take the faster library; both give the same
#: ids there. Character classes of later code points may differ between library versions.
_PLAIN = 0xCD
#: Longest run without a space that the faster library gets; its merge of one run is quadratic.
_RUN = 500


class ByteBpe:
    """Encodes texts to the ids of a ``tokenizers`` file, without special tokens added.

    ``ranks`` names the same vocabulary in ``tiktoken`` form. It serves texts in which both
    libraries agree by construction; all others go through ``tokenizers`` itself. A special
    token's string in a text is that token, or ordinary text with ``specials_as_text``.
    Bytes that are not UTF-8 count as U+FFFD.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None, specials_as_text: bool = False):
        self.specials_as_text = specials_as_text
        self.path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        self.slow = None
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: bytes) -> np.ndarray:
        try:
            words = text.decode()
        except UnicodeDecodeError:
            words = text.decode("utf-8", "replace")
            text = words.encode()
        found = np.frombuffer(text, np.uint8)
        if not len(found):
            return np.zeros(0, np.uint32)
        if found.max() < _PLAIN and (self.specials_as_text or b"<|" not in text):
            gaps = np.flatnonzero(found <= 0x20)
            if max(np.diff(gaps, prepend=-1, append=len(found))) <= _RUN:
                return self.fast.encode_to_numpy(words, disallowed_special=())
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = self.specials_as_text
        return np.array(self.slow.encode(words, add_special_tokens=False).ids, np.uint32)
