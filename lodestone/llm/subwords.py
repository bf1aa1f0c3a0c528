"""Subword ids of whole texts, by words that each task encodes once.

A text is cut at each space that stands between two characters that aren't white space; the space belongs to the word
after it. Neither tokenizer has a token that reaches over such a place, so the ids of a text are those of its words, one
after another. Words that come again (most do) are looked up by a hash, and their bytes compared; a text without such
spaces is one word and encoded whole. Next to some rare punctuation, of which UTF-8 shares its first bytes with white
space, no cut is made.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from lodestone.llm.common import Texts, sub_batches, word_hashes

#: Bytes of words that a task remembers; beyond them it starts over.
REMEMBERED = 1 << 24
#: Words that are encoded as one text.
JOINED = 500
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


class Ragged:
    """Lists of numbers of one kind, one after another."""

    def __init__(self, kind):
        self.flat, self.bounds = np.zeros(0, kind), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.bounds[at + 1] - self.bounds[at]

    def take(self, at: np.ndarray) -> np.ndarray:
        """The lists at these places, joined."""
        size = self.sizes(at)
        return self.flat[runs(self.bounds[at], size)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `size` of them, joined."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each word, byte after its last, how many words each text has)."""
    low = int(texts.starts[0]) if texts.n else 0
    b, starts, ends = texts.buf[low : int(texts.ends[-1]) if texts.n else 0], texts.starts - low, texts.ends - low
    at = np.flatnonzero(b == 32)
    text = np.searchsorted(starts, at, side="right") - 1
    at = at[(at > starts[text]) & (at + 1 < ends[text])]
    before, after = b[at - 1], b[at + 1]
    # a white space of two or three bytes may end before, or begin after
    b2, b3 = b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
    ends_blank = ((b2 == 0xC2) & ((before == 0x85) | (before == 0xA0))) | ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80))
    a2 = b[np.minimum(at + 2, len(b) - 1)]
    begins_blank = ((after == 0xC2) & ((a2 == 0x85) | (a2 == 0xA0))) | ((after == 0xE1) & (a2 == 0x9A)) | ((after == 0xE2) & ((a2 == 0x80) | (a2 == 0x81))) | ((after == 0xE3) & (a2 == 0x80))
    at = at[~(_BLANK[before] | _BLANK[after] | ends_blank | begins_blank)]
    full = ends > starts
    count = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=texts.n) + full if len(at) else full.astype(np.int64)
    return b, np.sort(np.concatenate([starts[full], at + 1])), np.sort(np.concatenate([ends[full], at])), count


class Words:
    """The words that a task has met, numbered; learn(new words) stores what is wanted of them, in order.

    Words begin with their space; the first of a text only if `first_space` says that one is put before the text.
    """

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], first_space: bool):
        self.learn, self.forget, self.first_space = learn, forget, first_space
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbered, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.int64), Ragged(np.uint8)

    def store(self, b: np.ndarray, i: np.ndarray, j: np.ndarray, bare: np.ndarray) -> np.ndarray:
        numbers = len(self.bytes.bounds) - 1 + np.arange(len(i))
        self.bytes.extend(b[runs(i, j - i)], j - i)
        whole = b.tobytes()
        self.learn([("" if x else " ") + whole[p:q].decode() for p, q, x in zip(i.tolist(), j.tolist(), bare.tolist(), strict=True)])
        return numbers

    def numbers(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, how many each text has). Numbers hold until the next call."""
        if len(self.bytes.flat) > REMEMBERED:
            self.clear()
            self.forget()
        b, i, j, count = word_spans(texts)
        bare = np.zeros(len(i), bool)
        if not self.first_space and len(i):
            bare[(np.cumsum(count) - count)[count > 0]] = True
        h = word_hashes(b, i, j) ^ (bare * np.uint64(0x9E3779B97F4A7C15))
        found, first, place = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        known = np.append(self.hashes, np.uint64(0))[at] == found if len(self.hashes) else np.zeros(len(found), bool)
        known &= at < len(self.hashes)
        new = first[~known]
        number = np.empty(len(found), np.int64)
        number[known] = self.numbered[at[known]]
        if len(new):
            number[~known] = self.store(b, i[new], j[new], bare[new])
            self.hashes, self.numbered = np.insert(self.hashes, at[~known], found[~known]), np.insert(self.numbered, at[~known], number[~known])
        number = number[place]
        # words that share a hash with another one are stored apart
        differ = self.bytes.sizes(number) != j - i
        same = np.flatnonzero(~differ)
        if (wrong := np.flatnonzero(self.bytes.take(number[same]) != b[runs(i[same], j[same] - i[same])])).size:
            differ[same[np.searchsorted(np.cumsum(j[same] - i[same]), wrong, side="right")]] = True
        if differ.any():
            number[differ] = self.store(b, i[differ], j[differ], bare[differ])
        return number, count


def byte_bpe(model: str, plain: bool = False):
    """A tokenizer from its JSON. plain: strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(model)
    found.encode_special_tokens = plain
    return found


def byte_bpe_sizes(tokenizer) -> np.ndarray:
    """The bytes of each token: it is written with a character for each byte."""
    return np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])


def byte_bpe_ids(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_words(words: list[str], encode: Callable[[list[str]], list[list[int]]], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, how many each has). size: the bytes of each id's token.

    Words are encoded JOINED at a time as one text, which is cheaper, and told apart by their bytes. Those that begin or
    end in more white space than their own space are encoded alone, and so are all of a text whose tokens stand for
    other bytes than its own.
    """
    alone = [len(w) < 2 or w[0] != " " or w[1].isspace() or w[-1].isspace() for w in words]
    order = np.argsort(alone, kind="stable")
    n = len(words) - sum(alone)
    chunks = [[words[k] for k in order[i : min(n, i + JOINED)].tolist()] for i in range(0, n, JOINED)]
    ids, counts = [], []
    for chunk, found in zip(chunks, encode(["".join(c) for c in chunks]), strict=True):
        found = np.array(found, np.int64)
        ends, want = np.cumsum(size[found]), np.cumsum([len(w.encode()) for w in chunk])
        at = np.searchsorted(ends, want)
        if ends[-1] != want[-1] or (ends[at] != want).any():
            found, count = ragged(encode(chunk), np.int64)
        else:
            count = np.diff(at, prepend=-1)
        ids.append(found)
        counts.append(count)
    found, count = ragged(encode([words[k] for k in order[n:].tolist()]), np.int64)
    ids, counts = np.concatenate([*ids, found]), np.concatenate([*counts, count])
    begin, back = np.cumsum(counts) - counts, np.argsort(order)
    return ids[runs(begin[back], counts[back])], counts[back]


def ragged(lists: list, kind) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), kind), np.fromiter(map(len, lists), np.int64, len(lists))


def texts_of(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of a batch with their texts, null as empty."""
    for part in sub_batches(batch, column, most):
        yield part, Texts(part.column(column))
