"""Byte-level BPE ids from the public vocabulary files."""

from __future__ import annotations

import base64
import json

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
_LOADED: dict = {}


def _paths(vocabulary: str | None) -> tuple[str, str, str]:
    import public_tokenizers as P

    path = vocabulary or P.path(VOCABULARY)
    return path, path.removesuffix(".json") + ".tiktoken", P.PATTERN


def _added(path: str) -> tuple[str, ...]:
    """The strings of the vocabulary's added tokens."""
    key = path, "added"
    if key not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[key] = tuple(t["content"] for t in json.load(f).get("added_tokens", []))
    return _LOADED[key]


class Encoder:
    """Ids as the ``tokenizers`` file gives them with ``add_special_tokens=False``:
    nothing is put around a text, and the string of an added token inside a text
    is that token, as the library has it by default. ``plain=True`` reads these
    strings as ordinary text instead.

    The same vocabulary is also published as merge ranks, and the ``tiktoken``
    encoder over these gives the same ids several times faster; it is used
    where the rank file lies beside the ``tokenizers`` file. Texts that hold an
    added token's string, and those the fast encoder refuses (a run too long for
    its pattern matcher), go through ``tokenizers``.
    """

    def __init__(self, vocabulary: str | None = None, plain: bool = False):
        self.path, ranks, pattern = _paths(vocabulary)
        self.plain, self.added = plain, () if plain else _added(self.path)
        self.fast = _LOADED.get(ranks)
        if self.fast is None:
            try:
                import tiktoken

                with open(ranks, "rb") as f:
                    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                self.fast = _LOADED[ranks] = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            except (ImportError, FileNotFoundError):
                self.fast = None

    def slow(self):
        key = self.path, self.plain
        if key not in _LOADED:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            t.encode_special_tokens = self.plain
            _LOADED[key] = t
        return _LOADED[key]

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(a in text for a in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the encoder's own panic type derives from BaseException
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.slow().encode(text, add_special_tokens=False).ids, np.uint32)
