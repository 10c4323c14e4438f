"""Token ids of whole texts with a public tokenizer file, many texts at a time."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable, Iterable

import numpy as np

#: Pre-tokens in each of the two generations that one worker process remembers, about 200 bytes each: when the younger one is
#: full it becomes the older, whose pre-tokens stay if they are met again.
CACHE_PIECES = 400_000
#: Unknown pre-tokens encoded by one call.
JOINED = 2_000

# The character classes of byte-level BPE (letters, numbers, white space) within ``KNOWN``, the characters
# on whose class all Unicode versions agree; texts with others go to the library as they are.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACES = "\\t-\\r \u0085\u00a0"
KNOWN = "\\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac\u2122"


def pre_tokens(letters: str = LETTERS, numbers: str = NUMBERS, spaces: str = SPACES) -> str:
    """The pattern of one pre-token."""
    return f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


class Pieces:
    """One tokenizer file: texts to pre-tokens, pre-tokens to ids, and whole texts to ids.

    Byte-level BPE never joins over a pre-token's ends, so a text's ids are those of its pre-tokens one after another.
    ``split`` gives None for texts whose pre-tokens it can't tell with certainty: other kinds of tokenizers, rare
    characters, and strings of added tokens, which the library takes out first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._newline = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            processor = SentencePieceProcessor(model_file=path)
            self._encode, self.n_ids = (lambda texts: processor.encode(texts, num_threads=1)), processor.vocab_size()
            self.split, self.splits = (lambda text: None), False
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.n_ids = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        added = [t["content"] for t in config["added_tokens"]]
        step = config["pre_tokenizer"] or {}
        plain = config["normalizer"] is None and config["model"]["type"] == "BPE" and not config["model"].get("dropout")
        plain = plain and config["truncation"] is None and config["padding"] is None
        if not (plain and step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")):
            self.split, self.splits = (lambda text: None), False
            return
        self._newline = self._encode(["\n"])[0][0]
        odd, find, find_ascii = re.compile(f"[^{KNOWN}]").search, re.compile(pre_tokens()).findall, re.compile(pre_tokens("A-Za-z", "0-9", "\\t-\\r ")).findall

        def split(text: str) -> list[str] | None:
            if any(a in text for a in added):
                return None
            if text.isascii():
                return find_ascii(text)
            return None if odd(text) else find(text)

        self.split, self.splits = split, True

    def whole(self, texts: list[str], dtype: str = "<u4") -> list[bytes]:
        return [np.array(ids, dtype=dtype).tobytes() for ids in self._encode(texts)]

    def of(self, pieces: Iterable[str], dtype: str = "<u4") -> dict[str, bytes]:
        """The ids of pre-tokens: line ends part them in one text, as none but white space holds any."""
        blank, words = [], []
        for piece in pieces:
            (blank if piece.isspace() else words).append(piece)
        out, width = dict(zip(blank, self.whole(blank, dtype), strict=True)), np.dtype(dtype).itemsize
        for group in (words[i : i + JOINED] for i in range(0, len(words), JOINED)):
            ids = np.array(self._encode(["\n".join(group)])[0], dtype=dtype)
            ends = width * np.append(np.flatnonzero(ids == self._newline), len(ids))
            starts, held = np.concatenate([[0], ends[:-1] + width]), ids.tobytes()
            out.update((piece, held[a:b]) for piece, a, b in zip(group, starts.tolist(), ends.tolist(), strict=True))
        return out


def pieces_of(path: str) -> Pieces:
    """The ``Pieces`` of a file, loaded once per worker process."""
    kept = sys.__dict__.setdefault("_siftmill_pieces", {})  # outlives the functions, which each task gets anew
    if path not in kept:
        kept[path] = Pieces(path)
    return kept[path]


def byte_bpe(path: str, remember: int | None = None) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts (null: empty) to their ids as little-endian 16-bit integers, equal to ``encode`` of the library.

    A pre-token is encoded once and remembered by the worker process over its tasks; unknown ones are encoded many at a time.
    """
    pieces = pieces_of(path)
    if pieces.n_ids > 65_536:
        raise ValueError("ids beyond 16 bits")
    generations: list[dict[str, bytes]] = sys.__dict__.setdefault("_siftmill_tokens", {}).setdefault(path, [{}, {}])

    def encode(texts: list[str | None]) -> list[bytes]:
        if len(generations[0]) > (remember or CACHE_PIECES):
            generations[:] = {}, generations[0]
        cache, older = generations
        out: list[bytes] = [b""] * len(texts)
        direct: list[int] = []
        open_texts: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        missing: dict[str, None] = {}
        get = cache.get
        for i, text in enumerate(texts):
            found = pieces.split(text) if text else ()
            if found is None:
                direct.append(i)
                continue
            parts = [*map(get, found)]
            if None in parts:
                places = [k for k, p in enumerate(parts) if p is None]
                for piece in {found[k] for k in places}:
                    if (ids := older.get(piece)) is None:
                        missing[piece] = None
                    else:
                        cache[piece] = ids
                open_texts.append((i, found, parts, places))
            else:
                out[i] = b"".join(parts)
        cache.update(pieces.of(missing, "<u2"))
        for i, found, parts, places in open_texts:
            for k in places:
                parts[k] = cache[found[k]]
            out[i] = b"".join(parts)
        for i, ids in zip(direct, pieces.whole([texts[i] for i in direct], "<u2"), strict=True):
            out[i] = ids
        return out

    return encode


def in_slices(texts: list[str | None], chars: int = 1_000_000):
    """Index ranges of consecutive texts of about so many characters together."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
