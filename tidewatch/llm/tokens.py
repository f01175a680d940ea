"""Public tokenizers inside tasks: byte-level ids of whole texts, fast where the fast library can do it."""

from __future__ import annotations

import json
import zlib

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTES = "byte_bpe_50k.json"


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """Ids of a byte-level `tokenizers` file, without special tokens around the text."""

    def __init__(self, file: bytes):
        self._file = file.decode()
        self._slow: dict[bool, Tokenizer] = {}
        content = json.loads(self._file)
        byte_of = _byte_of_character()
        added = {t["content"]: t["id"] for t in content["added_tokens"]}
        # The ids of such a vocabulary are in the order of its merges.
        ranks = {
            bytes(byte_of[c] for c in entry): i for entry, i in content["model"]["vocab"].items() if entry not in added
        }
        self.token_bytes = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.token_bytes[i] = token
        self._fast = tiktoken.Encoding(
            "corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
        )

    def encode(self, text: str, added: bool = True) -> list[int]:
        """Ids of a text; strings of added tokens in it become their ids, or with `added` off plain text."""
        try:
            return self._fast.encode(text, allowed_special="all") if added else self._fast.encode_ordinary(text)
        except BaseException as error:
            # The fast library's pattern runs out of stack on very long runs of white space, and panics.
            if type(error).__name__ not in ("PanicException", "ValueError"):
                raise
        if added not in self._slow:
            self._slow[added] = Tokenizer.from_str(self._file)
            self._slow[added].encode_special_tokens = not added
        return self._slow[added].encode(text, add_special_tokens=False).ids


_tokenizers: dict[int, ByteTokenizer] = {}


def byte_tokenizer(file: bytes) -> ByteTokenizer:
    """The tokenizer of a file's content, built once per worker."""
    key = zlib.crc32(file)
    if key not in _tokenizers:
        _tokenizers[key] = ByteTokenizer(file)
    return _tokenizers[key]


def read(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()
