"""Batch encoding with the tokenizers library.

Texts are cut at places where the tokenizer's own pre-tokenizer always cuts, each different piece is
encoded once per worker, and the ids are gathered with array operations. A text in which such
cuts might not be exact goes to the library whole, so the ids equal ``Tokenizer.encode``'s for every text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skimmer.llm.shared import slices

#: Bytes of pieces that a worker remembers, with their ids, and the longest that it remembers beyond that.
CACHE_BYTES, LONGEST = 16 << 20, 256
#: Bytes of text that are cut at once, about.
CHUNK_BYTES = 2 << 20

_OTHER = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space that touches white space other than one line end pair inside a text: its runs are cut by context.
_CONTEXT = rf"[ {_OTHER}][\s{_OTHER}]|[\s{_OTHER}][ {_OTHER}]|\n\n\n|\n\n\z|\x01"
#: A letter before a sign: the pre-tokenizers always cut there.
_SIGN = r"([\pL\pN])([^\s\pL\pN\pM\x01])"
#: A unit of the pre-tokenizer: letters with at most one space before them; if the tokenizer normalizes texts, only letters that it leaves as they are.
_UNIT, _LOW_UNIT = r"^ ?\pL+\z", r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+\z"
#: Byte-level vocabularies write each byte as a printable character: itself, or one from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: b for b in _SHOWN} | {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: The same as a table, but for the line end, which keeps units apart.
_IN_LINES = np.array([10 if b == 10 else _BYTES[b] for b in range(256)], "<u2")


@lru_cache(maxsize=1)
def _opening() -> str:
    """A pattern for letters that normal form or lower case turns into a letter and a mark: a sign after them joins the mark."""
    ends = lambda c: unicodedata.normalize("NFC", c).lower()[-1:]
    points = [p for p in range(0x80, 0x10000) if unicodedata.category(chr(p))[0] in "LN" and unicodedata.category(ends(chr(p)))[0] == "M"]
    return "[" + "".join(rf"\x{{{p:x}}}" for p in points) + "]"


class PieceEncoder:
    """ids of texts for one tokenizer file; keeps the pieces that it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: whether white space yields ids (byte-level) or only separates words
        self.keeps_space = self._ids("a b") != self._ids("a") + self._ids("b")
        #: the same model for units, a line each, and how many bytes each id stands for
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = self.lines.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        ending = self.tokenizer.model.end_of_word_suffix or ""
        self.sizes[[*vocabulary.values()]] = [len(t.removesuffix(ending)) for t in vocabulary]
        #: the pieces that are remembered, all their ids, the number of ids of each, and in how many slices it was met
        self.pieces, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.counts, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts by all steps of the library, one after another, and the number of each."""
        own = [np.array(x.ids, "<u4") for k in range(0, len(texts), 2000) for x in self.tokenizer.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *own]), np.fromiter(map(len, own), np.int64, len(own))

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of units of the pre-tokenizer, by one call of the model: which are whose, the bytes that they stand for tell."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), pa.scalar("\n", pa.large_string()))
        raw = np.frombuffer(joined[0].as_buffer(), np.uint8)
        ids = np.array(self.lines.encode_batch_fast([_IN_LINES[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(raw == 10), len(raw)) - np.arange(len(units))
        reach = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reach, ends)
        if not len(reach) or reach[-1] != ends[-1] or (reach[last] != ends).any():  # another kind of vocabulary
            return self._whole(units.to_pylist())
        return ids, np.diff(last, prepend=-1)

    def _places(self, found: pa.Array) -> np.ndarray:
        """Where each of different pieces is among those that are remembered; new ones are encoded, units together, and remembered."""
        place = pc.fill_null(pc.index_in(found, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = found.take(pa.array(missing))
            unit = pc.match_substring_regex(new, _UNIT if self.keeps_space else _LOW_UNIT).to_numpy(zero_copy_only=False)
            order, n = np.argsort(~unit, kind="stable"), int(unit.sum())
            new = new.take(pa.array(order))
            coded = ([self._units(new[:n])] if n else []) + ([self._whole(new[n:].to_pylist())] if n < len(new) else [])
            place[missing[order]] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.ids, self.counts = (np.concatenate(x) for x in zip((self.ids, self.counts), *coded))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.uses[place] += 1
        return place

    def _forget(self) -> None:
        """Beyond the budget what was met in one slice only since the last time goes; if that is not half of it, all goes."""
        if self.pieces.nbytes + self.ids.nbytes + self.counts.nbytes + self.uses.nbytes <= CACHE_BYTES:
            return
        stays = (self.uses > 1) & (pc.binary_length(self.pieces).to_numpy() <= LONGEST)
        pieces, ids = self.pieces.filter(pa.array(stays)), self.ids[np.repeat(stays, self.counts)]
        if pieces.nbytes + ids.nbytes + 12 * len(pieces) > CACHE_BYTES >> 1:
            stays[:], pieces, ids = False, self.pieces[:0], ids[:0]
        self.pieces, self.ids, self.counts = pa.concat_arrays([pieces]), ids.copy(), self.counts[stays]
        self.uses = np.ones(len(pieces), np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text. A null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if texts.nbytes <= CHUNK_BYTES + (CHUNK_BYTES >> 3):  # a slice as it is: what it took is used again for the next one
            return self._encode(texts)
        parts = [self._encode(part) for part in slices(texts, size=CHUNK_BYTES)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.keeps_space:
            whole = pc.match_substring_regex(texts, _CONTEXT)
            cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
            cut = pc.replace_substring_regex(cut, _SIGN, r"\1" "\x01" r"\2")
        else:
            whole = pc.match_substring_regex(texts, rf"\x01|{_opening()}")
            cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x01"), "\n", "\x01")
            cut = pc.replace_substring_regex(cut, _SIGN, r"\1" "\x01" r"\2")
            cut = pc.if_else(pc.match_substring_regex(texts, r"[^\x00-\x{ff}]"), cut, pc.utf8_lower(cut))
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(at):
            cut = pc.if_else(whole, pa.scalar("", pa.large_string()), cut)
        lists = pc.split_pattern(cut, "\x01")
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        index, place = coded.indices.to_numpy(), self._places(coded.dictionary)
        flat, first, long = self.ids, (np.cumsum(self.counts) - self.counts)[place], self.counts[place]
        n = long[index]
        ends = np.cumsum(n, dtype=np.int64)
        # where each id is taken from: one further than the one before, but at a piece's first
        some = np.flatnonzero(n)
        begin, size = first[index[some]], n[some]
        step = np.ones(ends[-1], np.int64)
        step[ends[some] - size] = begin - np.concatenate([[0], begin[:-1] + size[:-1] - 1])[: len(some)]
        ids = flat.take(np.cumsum(step))
        self._forget()
        words = np.diff(lists.offsets.to_numpy())
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(ends)
        if len(at):
            own, counts[at] = self._whole(texts.take(pa.array(at)).to_pylist())
            parts = np.split(ids, ends[1:-1])
            for k, x in zip(at.tolist(), np.split(own, np.cumsum(counts[at])[:-1])):
                parts[k] = x
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process and file."""
    return PieceEncoder(path)
