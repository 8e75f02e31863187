"""Token ids of many texts at once: every distinct piece is encoded once.

The word BPE vocabulary drops white space, lower-cases, and never joins a
letter and a mark (other than an apostrophe) into one token, so the ids of a
text are the ids of its pieces: words cut where an ASCII letter meets an ASCII
mark or digit.  Pieces stay known over the slices and tasks of a worker, up to
``MAX_PIECES``; then the store starts anew."""

from __future__ import annotations

import functools
import os
from itertools import chain

import numpy as np

from errata.llm import textops as T

MAX_PIECES = 1 << 19
MAX_LATEST = 1 << 13
END_ID = 2

# class of each byte: 1 ASCII letter, 2 ASCII mark or digit that never shares a token with a letter
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("'")] = 0


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one letter: printable Latin-1 as
    itself, all others as the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


def default_path() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _room(have: np.ndarray, n: int) -> np.ndarray:
    """``have`` with room for ``n`` items at least."""
    return have if n <= len(have) else np.concatenate([have, np.zeros(max(len(have), n - len(have)), have.dtype)])


class PieceEncoder:
    """Ids of the pieces met so far, by 64-bit hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_letters()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        # slot k has size[k] ids in flat from at[k]; slot 0 is the end of a document
        self.flat, self.n_ids = np.zeros(1 << 16, np.uint32), 1
        self.at, self.size, self.n_slots = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1
        self.flat[0], self.size[0] = END_ID, 1
        # most slots in hash order; the latest by hash, until there are many
        self.hashes, self.slots = np.zeros(0, T.U64), np.zeros(0, np.int64)
        self.latest: dict[int, int] = {}

    def _encode(self, piece: str) -> list[int]:
        if piece.isalpha() and max(piece) < "\u0250" and "\u0130" not in piece:
            # plain Latin letters make one pre-token; its bytes go to the model as they stand
            return [t.id for t in self.model.tokenize(piece.lower().encode().decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Slots of new pieces."""
        lists = [self._encode(p) for p in pieces]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids, slots = self.n_ids + int(sizes.sum()), self.n_slots + len(pieces)
        self.flat = _room(self.flat, ids)
        self.at, self.size = _room(self.at, slots), _room(self.size, slots)
        self.flat[self.n_ids:ids] = np.fromiter(chain.from_iterable(lists), np.uint32, ids - self.n_ids)
        self.at[self.n_slots:slots] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[self.n_slots:slots] = sizes
        new = np.arange(self.n_slots, slots)
        self.n_ids, self.n_slots = ids, slots
        self.latest.update(zip(hashes.tolist(), new.tolist()))
        if len(self.latest) > MAX_LATEST:
            every = np.concatenate([self.hashes, np.fromiter(self.latest, T.U64, len(self.latest))])
            order = np.argsort(every, kind="stable")
            self.slots = np.concatenate([self.slots, np.fromiter(self.latest.values(), np.int64, len(self.latest))])[order]
            self.hashes, self.latest = every[order], {}
        return new

    def _pieces(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        whole = s.data.tobytes()
        if any(x in whole for x in self.specials):
            return (s.data, *T.word_spans(s))
        kind = _KIND[s.data]
        cuts = np.zeros(len(kind), bool)
        cuts[1:] = kind[1:] * kind[:-1] == 2  # one is a letter, the other a mark
        return (T.LOWER[s.data], *T.word_spans(s, cuts))

    def encode(self, s: T.Slice, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts in a row, each ended by ``END_ID``, and the
        offsets of the texts in them."""
        source, starts, ends, first = self._pieces(s)
        slots = self._slots(source, starts, ends)
        if end:
            slots = np.insert(slots, first[1:], 0)
            first = first + np.arange(len(first))
        sizes = self.size[slots]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.at[slots] - total[:-1], sizes) + np.arange(total[-1])
        return self.flat[at], total[first]

    def _slots(self, source: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        distinct, where, back = np.unique(T.span_hashes(source, starts, ends), return_index=True, return_inverse=True)
        if self.n_slots + len(distinct) > MAX_PIECES and self.n_slots > 1:
            self.clear()
        slots = np.full(len(distinct), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            slots = np.where(self.hashes[at] == distinct, self.slots[at], -1)
        if self.latest:
            missing = np.flatnonzero(slots < 0)
            slots[missing] = [self.latest.get(h, -1) for h in distinct[missing].tolist()]
        new = np.flatnonzero(slots < 0)
        if len(new):
            k = where[new]
            slots[new] = self._learn(distinct[new], [source[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[k], ends[k])])
        return slots[back]

    def piece_sizes(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, ends and token counts of a slice's pieces, and ``first``."""
        source, starts, ends, first = self._pieces(s)
        slots = self._slots(source, starts, ends)
        return starts, ends, self.size[slots], first


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for one tokenizer file."""
    return PieceEncoder(path)
