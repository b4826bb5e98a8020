"""Token ids of whole texts by a public vocabulary file of the tokenizers library.

A file whose normalizer and split pattern are the fixed ones below never joins text across white space or between the
pieces that the pattern finds. Tasks then find the pieces of many texts at once, have the library's model encode each
distinct piece once, and look the rest up. Words with other characters than the plain ones, and words that may hold a
special token, are encoded by the whole library, each distinct one once. Any other file is left to the library, text
by text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from docketry.llm.common import RaggedTable

#: The id that ends each document.
END_ID = 1
#: The normalizer and the split of the files whose pieces are encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: Plain characters: printable ASCII and accented Latin letters, which normalization only lower-cases.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
_PLAIN, _SPACE = "!-~" + _LETTERS[6:], "\\x20\\x09-\\x0D\\x00"
_OTHER = re.compile(f"[^{_PLAIN}{_SPACE}]|<\\|")
#: The split for plain characters; the end of a text is a piece of its own.
_PIECE = f"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{_LETTERS}]+|[0-9]|[^{_SPACE}0-9{_LETTERS}]+|\\x00"
_PIECES = re.compile(_PIECE)
#: The same where there are other words: each of them is one piece. Words are looked through at their start alone.
_MIXED = re.compile(f"(?<![^{_SPACE}])[^{_SPACE}]*(?:[^{_PLAIN}{_SPACE}]|<\\|)[^{_SPACE}]*|{_PIECE}")
#: Distinct pieces that a task remembers before it starts afresh.
PIECES_KEPT = 500_000
#: Texts that the library encodes at once where it gets them whole.
BATCH = 32


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_alike(config: dict) -> bool:
    """Whether a vocabulary file has the fixed normalizer and split, and special tokens that the code can tell."""
    steps = config.get("pre_tokenizer") or {}
    marked = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in config.get("added_tokens", []))
    return config.get("normalizer") == NORMALIZER and steps.get("pretokenizers") == [SPLIT, BYTES] and config["model"]["type"] == "BPE" and not config["model"].get("dropout") and marked


class DocTokenizer(RaggedTable):
    """ids(texts) gives the ids of texts one after another, and each text's count. It numbers distinct pieces."""

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.alike = self.tokenizer.model, splits_alike(json.loads(self.tokenizer.to_str()))

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        others, tokenize = [], self.model.tokenize
        for i, piece in enumerate(words):
            if piece.isascii() and piece.isprintable() and "<|" not in piece:
                out[i] = [t.id for t in tokenize(piece.lower())]
            elif piece == "\0":
                out[i] = []
            elif _OTHER.search(piece):
                others.append(i)
            else:
                out[i] = [t.id for t in tokenize("".join(map(_BYTE_LETTERS.__getitem__, piece.lower().encode())))]
        for at in range(0, len(others), 1024):
            some = others[at : at + 1024]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = x.ids
        return out

    def _pieced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without NUL characters; the end of each is marked by one."""
        if len(self) > PIECES_KEPT:
            self.forget()
        joined = "\0".join(texts) + "\0"
        found = (_MIXED if _OTHER.search(joined) else _PIECES).findall(joined)
        numbers = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        counts = np.diff(np.concatenate([[-1], np.flatnonzero(numbers == self["\0"])]))
        return self.spread(numbers, counts)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library alone."""
        made = [x.ids for at in range(0, len(texts), BATCH) for x in self.tokenizer.encode_batch_fast(texts[at : at + BATCH], add_special_tokens=False)]
        return np.fromiter((i for x in made for i in x), np.uint32, sum(map(len, made))), np.fromiter(map(len, made), np.int64, len(made))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        strings = texts.to_pylist()
        if not self.alike:
            return self._whole(strings)
        if not any("\0" in x for x in strings):
            return self._pieced(strings)
        parts = [self._whole([x]) if "\0" in x else self._pieced([x]) for x in strings]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> DocTokenizer:
    """One tokenizer for each Python worker, which later tasks use again."""
    return DocTokenizer(vocabulary)


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each document, and the new counts."""
    return np.insert(flat, np.cumsum(counts), np.uint32(end_id)), counts + 1
