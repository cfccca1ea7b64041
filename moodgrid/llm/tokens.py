"""Token ids of whole texts through the ``tokenizers`` library, each distinct piece encoded once.

Byte-pair merges never cross a pre-token, so a text may be cut wherever a
pre-token surely starts and the pieces encoded on their own. Pieces repeat, so a
worker remembers the ids of those it has met, up to a bound; the rest is encoded
anew each time. The ids are those of encoding the whole text in one call.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from moodgrid.llm.common import ranges, words_of

END_ID = 2
REMEMBERED = 400_000
JOINED = 2_000
# Text that is encoded at once: the more, the more pieces repeat.
TEXT_BYTES = 4 << 20
# Stands between pieces that are encoded in one call; pieces with it go alone.
MARK = "\x01"
CUT = "\x02"
WHITE = (" ", "\n", "\t", "\r", "\v", "\f")
# Spaces after which a cut is not surely safe, or that are not plain ones.
ODD_SPACE = r"[ ][\s\x{85}\x{1c}-\x{1f}\p{Z}]|[ ]$"


class Encoder:
    """Ids of texts with one vocabulary file; ``kind`` tells how texts may be cut.

    ``words``: white space is dropped, so every ASCII white space is a cut.
    ``spaces``: a space belongs to the word behind it, so texts are cut before
    single spaces; a text with other runs of white space is encoded whole.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = kind
        self.width = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        marks = self.model.encode(f" {MARK}" if kind == "spaces" else MARK, add_special_tokens=False).ids
        self.mark, self.lead = marks[-1], len(marks) - 1
        self.known: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.width)

    def _plain(self, pieces: list[str]) -> list[np.ndarray]:
        found = self.model.encode_batch(pieces, add_special_tokens=False)
        return [np.array(e.ids, self.width) for e in found]

    def _fresh(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces not met before, many of them in one call."""
        glue = f" {MARK}" if self.kind == "spaces" else f" {MARK} "
        # Without white space in front nothing would part a piece from the mark.
        alone = [MARK in p or (self.kind == "spaces" and not p.startswith(WHITE)) for p in pieces]
        single = iter(self._plain([p for p, a in zip(pieces, alone, strict=True) if a]))
        rest = [p for p, a in zip(pieces, alone, strict=True) if not a]
        many: list[np.ndarray] = []
        for at in range(0, len(rest), JOINED):
            some = rest[at : at + JOINED]
            ids = np.array(self.model.encode(glue.join(some), add_special_tokens=False).ids, self.width)
            ends = np.concatenate((np.flatnonzero(ids == self.mark) - self.lead, [len(ids)]))
            starts = np.concatenate(([0], ends[:-1] + self.lead + 1))
            if len(ends) != len(some):
                many.extend(self._plain(some))
            else:
                many.extend(ids[a:b] for a, b in zip(starts, ends, strict=True))
        joined = iter(many)
        return [next(single) if a else next(joined) for a in alone]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each piece's ids, and the ids they point into."""
        at = np.array([self.known.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.start[at], self.length[at], self.flat
        words = [pieces[i] for i in new]
        found = self._fresh(words)
        length = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate((self.flat, *found)).astype(self.width)
        start = len(self.flat) + np.cumsum(length) - length
        starts, lengths = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        old = at >= 0
        starts[old], lengths[old] = self.start[at[old]], self.length[at[old]]
        starts[new], lengths[new] = start, length
        room = REMEMBERED - len(self.known)
        if room > 0:
            kept = min(room, len(words))
            self.known.update((w, len(self.start) + i) for i, w in enumerate(words[:kept]))
            self.start = np.concatenate((self.start, start[:kept]))
            self.length = np.concatenate((self.length, length[:kept]))
            self.flat = flat[: len(self.flat) + int(length[:kept].sum())]
        return starts, lengths, flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by text and all ids, each text followed by the end id (null: empty)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.kind == "words":
            offsets, codes, vocabulary = words_of(texts)
        else:
            offsets, codes, vocabulary = self._spaced(texts)
        many, subs, vocabulary = self._cut(vocabulary)
        start, length, flat = self._pieces(vocabulary.to_pylist())
        first = np.cumsum(many) - many
        # Offsets and codes of the pieces of pieces.
        ends = np.concatenate(([0], np.cumsum(many[codes])))
        offsets, codes = ends[offsets], subs[ranges(first[codes], many[codes])]
        pieces = length[codes]
        per_text = np.add.reduceat(np.append(pieces, 0), np.minimum(offsets[:-1], len(pieces)))
        per_text[offsets[1:] == offsets[:-1]] = 0
        ends = np.cumsum(per_text + 1)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, self.width)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        ids[ends - 1] = END_ID
        ids[inner] = flat[ranges(start[codes], pieces)]
        return np.concatenate(([0], ends)), ids

    def _cut(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Parts a stop or comma from the letter before it, and white space from what it follows.

        Both are ends of pre-tokens; far fewer different pieces are left. Gives the
        number of parts of each piece, their codes and their vocabulary.
        """
        if self.kind == "words":
            vocabulary = pc.ascii_lower(vocabulary)
        # U+0130 becomes a letter and a mark when the tokenizer folds it: no cut behind it.
        cut = pc.replace_substring_regex(vocabulary, r"([^\P{L}\x{130}])([.,])", rf"\1{CUT}\2")
        if self.kind == "spaces":
            cut = pc.replace_substring_regex(cut, r"([.,])(\n)", rf"\1{CUT}\2")
        # A piece that holds the cut sign itself stays whole.
        own = pc.match_substring(vocabulary, CUT)
        lists = pc.split_pattern(pc.if_else(own, "", cut), CUT)
        many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = lists.flatten()
        if pc.any(own).as_py():
            at = np.full(len(parts), -1, np.int64)
            held = np.flatnonzero(own.to_numpy(zero_copy_only=False))
            at[(np.cumsum(many) - many)[held]] = held
            parts = pc.if_else(pa.array(at >= 0), pc.take(vocabulary, pa.array(at, mask=at < 0)), parts)
        coded = parts.dictionary_encode()
        return many, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Pieces that start with their space; odd texts are one piece each."""
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        first = np.zeros(int(offsets[-1]), bool)
        first[offsets[:-1]] = True
        parts = lists.flatten()
        lead = pa.array(np.where(first, "", " "), pa.large_string())
        parts = pc.binary_join_element_wise(lead, parts, pa.scalar("", pa.large_string()))
        if odd.any():
            whole = pa.array(np.flatnonzero(odd))
            at = np.full(len(first), -1, np.int64)
            at[offsets[:-1][odd]] = np.arange(int(odd.sum()))
            picked = pc.take(texts.take(whole), pa.array(at, mask=at < 0))
            parts = pc.if_else(pa.array(at >= 0), picked, parts)
        coded = parts.dictionary_encode()
        return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a file; workers are reused from task to task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and executors share a bound."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def each_document(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    return zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
