"""Byte-level BPE ids by the tokenizers library, the distinct words of a batch merged once.

A pre-token of a byte-level vocabulary never spans the start of a space that follows and precedes
characters that are no white space, so a text may be encoded word by word. The words of many texts
are numbered by Arrow; each distinct one is cut into pre-tokens and merged by the library's BPE
model, many in one call, and the texts are put together from their words' ids by number. Nothing is
kept from batch to batch. Texts with white space beside a space, with a special token's string or
with a NUL are encoded whole by the library, and so are all texts if the vocabulary file asks for other
pre-tokens than `PRE_TOKEN` gives.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import common

END_ID = 2
#: The pre-tokens of this byte-level vocabulary.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: What the file of such a vocabulary says of its steps; with other values texts are encoded whole.
STEPS = {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
SPLIT = "\x00"  # between pre-tokens
NEVER = 0xFF  # a byte that UTF-8 never holds: its letter stands for SPLIT and merges with nothing
#: A word that begins with white space, or is empty: a space stands before white space.
ODD = r"^(?:[\s\pZ\x0b\x1c-\x1f\x{85}]|$)"
RUN = 2000  # bytes merged in one call, about
AT_ONCE = 1 << 20  # words put in place at once


def vocabulary(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> np.ndarray:
    """The letter that stands for each byte: itself if it is visible, else the next from 256 on."""
    seen = np.zeros(256, bool)
    seen[[*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]] = True
    return np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype("<u2")


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of n each, one run after another."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _holds(asked, wanted) -> bool:
    """Whether a setting has the wanted value, or all the wanted values."""
    return isinstance(asked, dict) and all(asked.get(k) == v for k, v in wanted.items()) if isinstance(wanted, dict) else asked == wanted


class Encoder:
    """The ids of many texts at once."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(path))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = byte_letters()
        vocab = self.library.get_vocab(with_added_tokens=False)
        asked, mark = json.loads(self.library.to_str()), chr(letters[NEVER])
        plain = all(chr(x) in vocab for x in letters) and not any(mark in t for t in vocab if len(t) > 1)
        self.by_words = plain and all(_holds(asked.get(k), v) for k, v in STEPS.items()) and _holds(asked["model"], MODEL)
        self.letters, self.mark = letters.copy(), vocab.get(mark)
        self.letters[ord(SPLIT)] = letters[NEVER]

    def whole(self, text: str) -> np.ndarray:
        """The library's own way."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def merged(self, pre_tokens: list[str], word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n words, one after another, and how many each has. word: to which each pre-token belongs, ascending."""
        known = {p: k for k, p in enumerate(dict.fromkeys(pre_tokens))}
        b = np.frombuffer(SPLIT.join(known).encode(), np.uint8)
        letters = self.letters[b].tobytes().decode("utf-16-le")
        cuts = np.flatnonzero(b == ord(SPLIT))
        cuts = cuts[np.flatnonzero(np.diff(cuts // RUN, prepend=0))].tolist()
        ids: list[int] = []
        for x, y in zip([0, *cuts], [*cuts, len(letters)], strict=True):
            ids += [t.id for t in self.library.model.tokenize(letters[x:y])]
        found = np.array(ids, np.int64)
        split = found == self.mark
        count = np.bincount(np.cumsum(split)[~split], minlength=len(known))
        found, begin = found[~split].astype("<u4"), np.cumsum(count) - count
        which = np.fromiter(map(known.__getitem__, pre_tokens), np.int64, len(pre_tokens))
        return found[ragged(begin[which], count[which])], np.bincount(word, count[which], n).astype(np.int64)

    def words(self, distinct: pa.Array, at_once: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """merged() of words that follow a space."""
        got = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))]
        for k in range(0, len(distinct), at_once):
            part = distinct.slice(k, at_once)
            joined = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            found = PRE_TOKEN.findall(joined)
            got.append(self.merged(found, np.cumsum([p[0] == " " for p in found]) - 1, len(part)))
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def heads(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merged() of words that no space precedes."""
        found = [PRE_TOKEN.findall(t) for t in texts]
        return self.merged([p for f in found for p in f], np.repeat(np.arange(len(texts)), [len(f) for f in found]), len(texts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, an END_ID after each, and where each begins; the last bound is the end. Null counts as empty."""
        texts, n = pc.fill_null(texts, ""), len(texts)
        whole = np.full(n, not self.by_words)
        for sign in (*self.special, SPLIT) if self.by_words else ():
            whole |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        numbered = parts.values.dictionary_encode()
        number, distinct = numbered.indices.to_numpy(), numbered.dictionary
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        odd = pc.match_substring_regex(distinct, ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            bad = odd[number]
            bad[offsets[:-1]] = False  # no space stands before the first word
            whole[doc[bad]] = True
        # what stands where: distinct words, then heads, then texts encoded whole, then the end and nothing
        flat, count = self.words(distinct.filter(pa.array(~odd)))
        n_words = len(count)
        placed = np.empty(len(number) + n, np.int64)
        placed[np.arange(len(number)) + doc] = (np.cumsum(~odd) - 1)[number] if odd.any() else number
        heads = np.where(whole, "", parts.values.take(pa.array(offsets[:-1])).to_numpy(zero_copy_only=False)) if n else []
        head_ids, head_count = self.heads(list(heads)) if self.by_words and n else (np.zeros(0, "<u4"), np.zeros(n, np.int64))
        apart = [self.whole(texts[int(i)].as_py()) for i in np.flatnonzero(whole)]
        flat = np.concatenate([flat, head_ids, *apart, np.array([END_ID], "<u4")])
        count = np.concatenate([count, head_count, np.array([len(x) for x in apart], np.int64), [1, 0]])
        begin, (end, nothing) = np.cumsum(count) - count, (len(count) - 2, len(count) - 1)
        if len(apart):
            gone = np.flatnonzero(whole[doc])
            placed[gone + doc[gone]] = nothing
        placed[offsets[:-1] + np.arange(n)] = np.where(whole, n_words + n + np.cumsum(whole) - 1, n_words + np.arange(n))
        placed[offsets[1:] + np.arange(n)] = end
        upto = np.cumsum(count[placed])
        ids = np.empty(int(upto[-1]) if n else 0, "<u4")
        for k in range(0, len(placed), AT_ONCE):
            part = placed[k : k + AT_ONCE]
            ids[upto[k] - count[placed[k]] : upto[k + len(part) - 1]] = flat[ragged(begin[part], count[part])]
        return ids, np.concatenate([[0], upto[offsets[1:] + np.arange(n)]])

    def runs(self, texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """encode() of runs of texts of about `most` bytes, a longer text alone: first, last, ids, bounds."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield (a, b, *self.encode(texts.slice(a, b - a)))
            a = b


def encoder(path: str | None = None) -> Encoder:
    """One a Python worker, till another operator's task comes."""
    kept = common.CACHES.setdefault("tokens", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
