"""Public tokenizers in Python workers: opened when first needed, once per worker."""

from __future__ import annotations

import base64
import functools
import re

SPACE = "▁"


def path(name: str) -> str:
    """Place of a vocabulary file; a path stays as it is."""
    import os

    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


@functools.cache
def library(name: str):
    """The tokenizers object of a ``.json`` file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


@functools.cache
def sentences(name: str):
    """The sentencepiece object of a ``.model`` file."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path(name))


@functools.cache
def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def byte_ranks(name: str) -> dict[bytes, int]:
    with open(path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _fast(name: str, divides: bool):
    import tiktoken

    split = pattern() if divides else pattern().replace(r"\s+(?!\S)|", "")
    return tiktoken.Encoding(f"{name}-{divides}", pat_str=split, mergeable_ranks=byte_ranks(name), special_tokens={})


_RUNS = re.compile(r"\s\s")


def plain_ids(name: str, text: str) -> list[int]:
    """Ids of a byte-level ``.tiktoken`` vocabulary, special strings read as plain text.

    The pattern looks ahead only to divide runs of white space; texts without such runs take the quicker
    pattern without that part.
    """
    return _fast(name, bool(_RUNS.search(text))).encode_ordinary(text)


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def piece_bytes(name: str) -> list[bytes]:
    """Bytes of every id of a ``.model`` file: U+2581 is a space, <0xHH> a byte, control pieces their names."""
    sp = sentences(name)
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(sp.id_to_piece(list(range(sp.get_piece_size()))))]
