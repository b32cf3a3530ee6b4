"""Token ids of a public byte-level BPE vocabulary.

The driver reads the vocabulary file (its path is a parameter) and broadcasts its bytes, so executors need no local copy;
the file's size is checked against ``MAX_VOCABULARY``.  The ``.json`` form is what the contract names; its rank table gives
the same ids through a faster encoder, and the tests hold the two against each other.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

MAX_VOCABULARY = 64 << 20
#: Shorter texts have no runs that the fast encoder gives up on.
LONG = 1 << 18
_ENCODERS: dict[tuple[int, bool], object] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def share(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary as a broadcast of its bytes."""
    with open(path or default_path(), "rb") as f:
        body = f.read(MAX_VOCABULARY + 1)
    if len(body) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary is larger than {MAX_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(body)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes: printable Latin-1 stands for itself, the others for 256, 257, ..."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(vocabulary: Broadcast, added: bool = False):
    """A function from a text to its list of ids; no token is put around it.  With ``added`` the file's added tokens are found in
    texts, as the named library does by default; without it their strings are ordinary text. One per process and kind.

    The fast encoder gives up on some texts, such as a million spaces in a row; these go to the named library itself."""
    key = zlib.crc32(vocabulary.value), added
    if key not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        spec = json.loads(vocabulary.value)
        byte_of, special = _byte_of(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if len(text) < LONG and not (added and any(t in text for t in special)):
                return fast.encode_ordinary(text)
            try:
                return fast.encode(text, allowed_special="all" if added else set(), disallowed_special=())
            except ValueError:
                return _library(vocabulary.value, added).encode(text, add_special_tokens=False).ids

        for other in [k for k in _ENCODERS if k[0] != key[0]]:
            del _ENCODERS[other]
        _ENCODERS[key] = encode
    return _ENCODERS[key]


@lru_cache(2)
def _library(body: bytes, added: bool):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(body.decode())
    made.encode_special_tokens = not added
    return made


def ids(encode, text: str | None) -> np.ndarray:
    return np.asarray(encode(text) if text else [], np.uint32)
