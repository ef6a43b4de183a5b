"""Encoding of texts by way of their distinct words.

A tokenizer that never merges across white space gives a text's ids as those of its words, one after the other.
Arrow splits a batch and numbers its distinct words; only words that are new to the task are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarrymill.llm.shared import bounds, ranges


def words_of(texts: pa.Array, separator: str = " ") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the number of each word in order, and where each text's words begin (one more than texts)."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), separator)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), bounds(pc.list_value_length(lists).to_numpy(zero_copy_only=False))


class WordCodes:
    """Ids of words, kept from batch to batch; forgotten when there are more than most.

    encode gives the ids of some words, one word after the other, and how many each word has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, at_once: int = 1 << 15):
        self.encode, self.most, self.at_once = encode, most, at_once
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids_of(self, words: list[str], numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids begin (one more than texts)."""
        if len(self.at) > self.most:
            self.forget()
        new = [w for w in words if w not in self.at]
        coded = [self.encode(new[i : i + self.at_once]) for i in range(0, len(new), self.at_once)]
        self.at |= zip(new, range(len(self.at), len(self.at) + len(new)), strict=True)
        self.ids = np.concatenate([self.ids, *(flat for flat, _ in coded)]).astype(np.uint32, copy=False)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in coded)]))])
        place = np.fromiter((self.at[w] for w in words), np.int64, len(words))
        first, length = self.ends[place], self.ends[place + 1] - self.ends[place]
        counts = length[numbers]
        return self.ids[ranges(first[numbers], counts)], bounds(counts)[starts]


def flat_ids(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.fromiter((i for x in coded for i in x), np.uint32, lengths.sum()), lengths
