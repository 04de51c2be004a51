"""Subword lattice language model: a text's probability is summed over all its segmentations into pieces.

The pieces are those of a public tokenizer's vocabulary. Their scores start from the vocabulary's own and are then
re-estimated on the training texts by expectation-maximisation over the words' lattices. No piece crosses a word, so
the forward recursion over a text is the sum of those over its words; each distinct word is worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Cells (words x positions) worked on at a time.
CELLS = 1 << 16
_BASE = 0x100000001B3
_MOD = (1 << 64) - 1


class Pieces:
    """Vocabulary as bytes; a leading blank marks the start of a word. All single bytes are pieces."""

    def __init__(self, pieces: list[bytes], ranks: np.ndarray):
        self.pieces, self.ranks = pieces, ranks
        self.tables = []  # per length: sorted hashes and the numbers of their pieces
        by_length: dict[int, list[tuple[int, int]]] = {}
        for number, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append((hash_bytes(piece), number))
        self.longest = max(by_length)
        for n in range(1, self.longest + 1):
            found = sorted(by_length.get(n, []))
            self.tables.append((np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found], np.int32)))

    def __len__(self) -> int:
        return len(self.pieces)

    def prior(self) -> np.ndarray:
        """Probabilities from the vocabulary's own scores, which are negative ranks: Zipf's law over the ranks."""
        p = 1.0 / (self.ranks + 10.0)
        return p / p.sum()


def hash_bytes(piece: bytes) -> int:
    h = 0
    for c in piece:
        h = (h * _BASE + c + 1) & _MOD
    return h


@lru_cache(maxsize=1)
def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            scores[piece] = model.get_score(i)
    worst = min(scores.values(), default=0.0) - 1
    for c in range(256):
        scores.setdefault(bytes([c]), worst)
    pieces = sorted(scores)
    return Pieces(pieces, -np.array([scores[p] for p in pieces], np.float64))


def lattices(words: list[bytes], pieces: Pieces) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Blocks of words of one length: their positions, and per piece length k a matrix of piece numbers
    (word x start), -1 where the bytes are no piece. The first byte of each is the blank that starts a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        length = int(lengths[same[0]])
        step = max(1, CELLS // length)
        for at in range(0, len(same), step):
            part = same[at : at + step]
            raw = np.frombuffer(b"".join(b" " + words[i] for i in part.tolist()), np.uint8).reshape(len(part), length)
            # Columns are positions, so that a step over positions works on contiguous words.
            code = raw.T.astype(np.uint64) + np.uint64(1)
            key, arcs = np.zeros_like(code), []
            for k in range(1, min(pieces.longest, length) + 1):
                key = (code if k == 1 else key[:-1] * np.uint64(_BASE) + code[k - 1 :])
                hashes, numbers = pieces.tables[k - 1]
                if len(hashes):
                    spot = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
                    arcs.append(np.where(hashes[spot] == key, numbers[spot], -1))
                else:
                    arcs.append(np.full(key.shape, -1, np.int32))
            yield part, arcs


def forward(arcs: list[np.ndarray], logp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-space forward recursion: row i holds the log marginal of the first i bytes. ``logp`` has -inf at its end, where the
    number -1 points."""
    length, width = arcs[0].shape
    score = [logp[a] for a in arcs]
    alpha = np.full((length + 1, width), -np.inf)
    alpha[0] = 0.0
    for end in range(1, length + 1):
        total = alpha[end - 1] + score[0][end - 1]
        for k in range(2, min(len(arcs), end) + 1):
            total = np.logaddexp(total, alpha[end - k] + score[k - 1][end - k])
        alpha[end] = total
    return alpha, score


def word_scores(words: list[bytes], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, over all segmentations."""
    padded, out = np.append(logp, -np.inf), np.empty(len(words))
    for part, arcs in lattices(words, pieces):
        out[part] = forward(arcs, padded)[0][-1]
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """How often each piece is expected in ``counts`` copies of the words (forward-backward)."""
    padded, out = np.append(logp, -np.inf), np.zeros(len(pieces) + 1)
    for part, arcs in lattices(words, pieces):
        alpha, score = forward(arcs, padded)
        length, n = arcs[0].shape[0], counts[part]
        beta = np.full_like(alpha, -np.inf)
        beta[length] = -alpha[length]
        for start in range(length - 1, -1, -1):
            total = beta[start + 1] + score[0][start]
            for k in range(2, min(len(arcs), length - start) + 1):
                total = np.logaddexp(total, beta[start + k] + score[k - 1][start])
            beta[start] = total
        for k, (numbers, s) in enumerate(zip(arcs, score), 1):
            used = numbers >= 0
            share = np.exp(alpha[: length - k + 1][used] + s[used] + beta[k:][used])
            weight = np.broadcast_to(n, numbers.shape)[used]
            out += np.bincount(numbers[used], weights=share * weight, minlength=len(out))
    return out[:-1]
