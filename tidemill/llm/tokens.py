"""Token ids of a byte-level BPE vocabulary, in Arrow batches on the executors.

The ids are those of the ``tokenizers`` library for the file given. Its own
encoder takes several times the CPU time of ``tiktoken`` on the same
vocabulary, so texts go through the latter where both provably agree: the
vocabulary's merges are its ranks, and a text without special-token strings is
cut by one pattern in both. The look-ahead in that pattern matters only
for runs of white space, so texts without such a run take a pattern without it.
Texts that hold a special token's string go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import public_tokenizers

TOKENIZER = "byte_bpe_50k"
_RUN = re.compile(r"\s\s")
_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(name: str = TOKENIZER) -> Callable[[str], list[int]]:
    """A function from a text to its ids, made once in each worker process."""
    if name not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cut = public_tokenizers.PATTERN
        whole = tiktoken.Encoding("whole", pat_str=cut, mergeable_ranks=ranks, special_tokens={})
        simple = tiktoken.Encoding("simple", pat_str=cut.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        special = [t.content for t in exact.get_added_tokens_decoder().values()]

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return exact.encode(text, add_special_tokens=False).ids
            return (whole if _RUN.search(text) else simple).encode_ordinary(text)

        _encoders[name] = encode
    return _encoders[name]
