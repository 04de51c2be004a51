"""Two-stage suffix sorting of a block of bytes (Itoh and Tanaka 1999), in whole-array steps.

A suffix is *small* if it is smaller than its successor, else *large*. Only the small ones are sorted directly; the large
ones are induced from them by one scan over the buckets of first bytes. Sorting stops at a depth: suffixes that agree up to
there stand next to each other in any order, which is all that adjacent common prefixes up to that depth need.
"""

from __future__ import annotations

import numpy as np


def big_words(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes at every position as one number in byte order; zeros after the end, for ``pad`` further positions."""
    raw = np.concatenate([text, np.zeros(pad + 8, np.uint8)])
    return np.ndarray((len(text) + pad,), ">u8", raw.tobytes(), strides=(1,)).astype(np.uint64)


def small_suffixes(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than the next one; the last suffix is not."""
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    # A run of equal bytes is decided by the byte after the run.
    at = np.searchsorted(differs, np.arange(n))
    decided = at < len(differs)
    after = differs[np.minimum(at, max(len(differs) - 1, 0))] if len(differs) else np.zeros(n, np.int64)
    return decided & (text[after] < text[np.minimum(after + 1, n - 1)])


def direct_sort(words: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in the order of their first ``depth`` bytes: eight bytes first, then five at a time among
    those that are still tied (40 bits of text below the number of the tied group)."""
    first = words[suffixes]
    order = np.argsort(first)
    suffixes, first = suffixes[order], first[order]
    starts = np.r_[True, first[1:] != first[:-1]]
    done, slots = 8, np.arange(len(suffixes))
    while True:
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        if done >= depth or not tied.any():
            return suffixes
        starts = starts[tied]
        slots = slots[tied]  # places of tied suffixes in the result; groups keep their places
        group = np.cumsum(starts).astype(np.uint64)
        own = suffixes[slots]
        key = (group << np.uint64(40)) | (words[own + done] >> np.uint64(24))
        order = np.argsort(key)
        suffixes[slots] = own[order]
        key = key[order]
        starts = np.r_[True, key[1:] != key[:-1]]
        done += 5


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in the order of their first ``depth`` bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    small = direct_sort(words, np.flatnonzero(small_suffixes(text)), depth)
    small_from = np.searchsorted(text[small], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[n - 1]].append(np.array([n - 1]))  # induced by the end of the text
    out = []
    for byte in range(256):
        # Large suffixes of this bucket: those induced from smaller buckets, then wave by wave what they induce here.
        waves, wave = [], np.concatenate(pending[byte]) if pending[byte] else np.zeros(0, np.int64)
        while len(wave):
            waves.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == byte]
        bucket = np.concatenate([*waves, small[small_from[byte] : small_from[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        lead = text[before]
        before, lead = before[lead > byte], lead[lead > byte]
        if len(before):
            order = np.argsort(lead, kind="stable")
            before, lead = before[order], lead[order]
            cuts = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
            for part, b in zip(np.split(before, cuts[1:]), lead[cuts].tolist()):
                pending[b].append(part)
    return np.concatenate(out)


def repeated_starts(texts: list[bytes], starts: list[int], length: int) -> np.ndarray:
    """Flags over the joined ``texts``: the ``length`` bytes from here occur at another counted position too.

    Counted positions are the first ``starts[i]`` of text ``i``, from each of which ``length`` bytes lie inside it. Suffixes
    of the joined texts are sorted; neighbours among the counted ones whose common prefix reaches ``length`` are equal there.
    """
    text = np.frombuffer(b"".join(texts), np.uint8)
    flags = np.zeros(len(text), bool)
    if not len(text):
        return flags
    words = big_words(text, length + 8)
    counted = np.zeros(len(text) + 1, np.int8)
    begin = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]]
    np.add.at(counted, begin, 1)
    np.add.at(counted, begin + np.asarray(starts), -1)
    order = suffix_array(text, words, length)
    order = order[np.cumsum(counted[:-1], dtype=np.int8)[order] > 0]
    one, next_one = order[:-1], order[1:]
    for at in (*range(0, length - 8, 8), length - 8):  # common prefixes, eight bytes at a time
        same = words[one + at] == words[next_one + at]
        one, next_one = one[same], next_one[same]
    flags[one] = flags[next_one] = True
    return flags
