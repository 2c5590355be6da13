"""Token ids of public tokenizers inside tasks, remembered by word.

A byte-level BPE never merges across its pre-tokens, and a single space
between two visible characters always starts one, as does a single line break.
A text can so be cut there and each part encoded alone; parts recur, so most
come from a bounded memory.  Texts with other white space around spaces are encoded whole.
The ids are those of the tokenizer's own ``encode``: parts go to the rank file
of the same vocabulary, whose library is faster on single words, and texts that
hold what may be a special token go to the tokenizer itself.
"""

from __future__ import annotations

import array
import base64
import os
import re
from functools import cached_property

#: Bytes of parts and ids remembered by one Python worker; beyond it the memory starts anew.
MEMORY_BYTES = 40_000_000
#: What a part takes besides its characters and ids.
PART_BYTES = 220
#: Longer parts are encoded each time.
LONGEST_PART = 64
#: White space other than spaces and line breaks.
ODD_SPACE = re.compile(r"[^\S \n]")
#: What every special token starts with.
SPECIAL = "<|"

_loaded: dict[tuple[str, str], "BytePairIds"] = {}


class Memory(dict):
    """Ids by part, found when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.size = encode, 0

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(part) <= LONGEST_PART:
            self[part] = ids
            self.size += len(part) + len(ids) + PART_BYTES
        return ids

    def clear(self) -> None:
        super().clear()
        self.size = 0


class BytePairIds:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(ranks, "rb") as lines:
            by_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self.known = Memory(self.encode_part)

    @cached_property
    def tokenizer(self):
        """The tokenizer itself; most workers never meet a special token and don't load it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode_part(self, part: str) -> bytes:
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids if SPECIAL in part else self.plain.encode_ordinary(part)
        return array.array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n " in text or " \n" in text or text[0] == " " or SPECIAL in text or "\0" in text or ODD_SPACE.search(text):
            return self.encode_part(text)
        if self.known.size > MEMORY_BYTES:
            self.known.clear()
        marked = text.replace(" ", "\0 ")
        if "\n\n" not in text:
            marked = marked.replace("\n", "\0\n")
        return b"".join(map(self.known.__getitem__, marked.split("\0")))


def byte_pair(path: str | None = None, ranks: str | None = None) -> BytePairIds:
    """The encoder of these files, loaded once in each Python worker."""
    import public_tokenizers

    key = (path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _loaded:
        _loaded[key] = BytePairIds(*key)
    return _loaded[key]
