"""Byte-level BPE encoding with a bounded cache of words.

A text is cut where the vocabulary's pre-tokenizer always starts a new piece: before and
after runs of letters (a leading space goes with the run). Such parts can be encoded one by
one and repeat often. A text in which a space meets other white space or that spells a
special token goes to the library whole. One with an apostrophe before a letter, which may
be a contraction, with white space in a row, whose pieces depend on what follows, or with a
character that may be a letter beyond those known here is cut at spaces only.

``encode_arrays`` cuts the bytes of many texts with array operations and numbers the parts by
Arrow, so that each different part is looked up once; texts that need more than the plain cut
take the way above.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BPE_FILE = "byte_bpe_50k.json"
#: Letters that every Unicode version counts as such.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_CUT = re.compile(f" ?[{_LETTERS}]+|(?: |[^ {_LETTERS}])[^ {_LETTERS}]*")
_CUT_AT_SPACES = re.compile("[ ]?[^ ]+")
_CONTRACTION = re.compile(f"'[{_LETTERS}]")
_MIXED_SPACE = re.compile(r" (?=\s|$)")
_SPACES = re.compile(r"\s\s")
#: Characters that no Unicode version counts as letters: ASCII, Latin-1 signs, combining marks, punctuation, symbols, pictographs.
_NO_LETTERS = "\x00-\x7f\x80-©«-´¶-¹»-¿×÷\u0300-\u036f\u2000-\u2064\u20a0-\u20bf\u2190-\u23ff\u2460-\u2bff\u3000-\u3004\u3008-\u3020\ufe0e\ufe0f\ufffd\U0001f300-\U0001faff"
_FOREIGN = re.compile(f"[^{_LETTERS}{_NO_LETTERS}]")
#: Classes of UTF-8 bytes: a space, other white space (as ``\\s`` sees it), a letter or a byte of a character of _LETTERS, an
#: apostrophe, the first byte of a character that is not among _LETTERS, others.
_SPACE, _WHITE, _LETTER, _QUOTE, _FAR, _OTHER = range(6)
_CLASS = bytes(
    _SPACE if b == 32 else _WHITE if chr(b).isspace() and b < 128 else _FAR if b > 0xBF and not 0xC3 <= b <= 0xC9 else _LETTER if b > 127 or chr(b).isalpha() else _QUOTE if b == 39 else _OTHER for b in range(256)
)
#: First bytes that some letters of _LETTERS share with other characters, and which second bytes make the latter.
_SIGNS = {0xC3: np.isin(np.arange(256), [0x97, 0xB7]), 0xC9: np.arange(256) >= 0x90}
#: How a byte-level model spells bytes; a line end parts words here.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(_SELF)))}
_SPELLED[10] = 10


def vocabulary_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedEncoder:
    """Encodes texts to ids exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Ids are held and returned as the bytes of little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, entries: int = 150_000, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.entries, self.most = entries, most
        self.parts: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        # Parts that encode_arrays knows, where the ids of each end, the ids, and the last call that used a part.
        self.held = pa.array([], pa.large_binary())
        self.held_ends, self.held_ids, self.used, self.calls = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def library(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def cut(self, text: str) -> list[str]:
        if _MIXED_SPACE.search(text) or any(s in text for s in self.special):
            return [text]
        linked = _CONTRACTION.search(text) or _SPACES.search(text) or not text.isascii() and _FOREIGN.search(text)
        return (_CUT_AT_SPACES if linked else _CUT).findall(text)

    def encode_many(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each whole text."""
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.parts) >= self.entries:
            self.parts.clear()
        known = self.parts
        new = list({part for cut in cuts for part in cut if part not in known})
        own = dict(zip(new, self.library(new), strict=True)) if new else {}
        known.update((k, v) for k, v in own.items() if len(k) <= 48)
        own = {k: v for k, v in own.items() if len(k) > 48}
        if own:
            return [b"".join([own.get(p) or known[p] for p in cut]) for cut in cuts]
        return [b"".join([known[p] for p in cut]) for cut in cuts]

    def encode_arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (32 bits) of all texts, one after another, and how many each text has. No text may be null."""
        texts = texts.cast(pa.large_string())
        held = self._bytes(texts)
        odd = self._odd(*held)
        if not odd.any():
            return self._encode_plain(*held)
        ids, sizes = self._encode_plain(*self._bytes(texts.filter(pa.array(~odd))))
        own = [np.frombuffer(x, "<u4") for x in self.encode_many(texts.filter(pa.array(odd)).to_pylist())]
        lengths = np.zeros(len(texts), np.int64)
        lengths[odd], lengths[~odd] = [len(x) for x in own], sizes
        out, from_odd = np.empty(int(lengths.sum()), np.uint32), np.repeat(odd, lengths)
        out[from_odd] = np.concatenate(own)
        out[~from_odd] = ids
        return out, lengths

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts, their classes, and where each text begins and the last one ends."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2]
        data = held.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if held else b""
        return data, np.frombuffer(data.translate(_CLASS), np.uint8), offsets - offsets[0]

    def _odd(self, data: bytes, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts may need more than the plain cut; all that do are among them."""
        out = np.zeros(len(offsets) - 1, bool)
        if not data:
            return out
        white = kinds <= _WHITE
        found = [np.flatnonzero(white[1:] & white[:-1])]
        if b"'" in data:
            quotes = np.flatnonzero(kinds[:-1] == _QUOTE)
            found.append(quotes[kinds[quotes + 1] == _LETTER])
        if not data.isascii():
            signs = np.frombuffer(data, np.uint8)
            found.append(np.flatnonzero(kinds == _FAR))
            for first, seconds in _SIGNS.items():
                if bytes([first]) in data:
                    at = np.flatnonzero(signs[:-1] == first)
                    found.append(at[seconds.take(signs[at + 1])])
        out[np.searchsorted(offsets, np.concatenate(found), "right") - 1] = True
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        out[np.flatnonzero(offsets[1:] > offsets[:-1])[kinds[ends] == _SPACE]] = True
        for word in self.special:
            sign = word.encode()
            if sign in data:
                out |= np.array([sign in data[a:b] for a, b in zip(offsets, offsets[1:])], bool)
        return out

    def _encode_plain(self, data: bytes, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        letter, space = kinds == _LETTER, kinds == _SPACE
        begins = space.copy()
        begins[1:] |= (letter[1:] != letter[:-1]) & ~space[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        which = coded.indices.to_numpy()
        flat, first, sizes = self._look_up(coded.dictionary)
        counts = sizes.take(which)
        ends = np.cumsum(counts)
        places = np.repeat(first.take(which) - ends + counts, counts)
        places += np.arange(len(places))
        ids = flat.take(places)
        at = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return ids, np.diff(at)

    def _look_up(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the different parts where its ids begin among them and how many they are."""
        at = pc.index_in(parts, value_set=self.held)
        if at.null_count:
            new = parts.filter(at.is_null())
            own, sizes = self._pieces(new.to_pylist())
            at = pc.coalesce(at, pc.add(pc.cumulative_sum(at.is_null().cast(pa.int32())), pa.scalar(len(self.held) - 1, pa.int32())))
            self.held = pa.concat_arrays([self.held, new])
            self.held_ends = np.append(self.held_ends, self.held_ends[-1] + np.cumsum(sizes))
            self.held_ids = np.append(self.held_ids, own)
            self.used = np.append(self.used, np.zeros(len(sizes), np.int64))
        at = at.to_numpy()
        flat, first, sizes = self.held_ids, self.held_ends[:-1].take(at), np.diff(self.held_ends).take(at)
        self.calls += 1
        self.used[at] = self.calls
        if len(self.held) > self.most:
            self._forget()
        return flat, first, sizes

    def _pieces(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, and how many each has. Runs of letters are one piece each, so the library's model gets them as they are."""
        words = [_CLASS[p[-1]] == _LETTER for p in parts]
        spelled = b"\n".join(compress(parts, words)).decode("latin-1").translate(_SPELLED).split("\n")
        rest = self.tokenizer.encode_batch_fast([p.decode() for p, word in zip(parts, words, strict=True) if not word], add_special_tokens=False)
        tokenize, word_at, rest_at = self.tokenizer.model.tokenize, iter(spelled), iter(rest)
        ids: list[int] = []
        ends = []
        for word in words:
            ids += [t.id for t in tokenize(next(word_at))] if word else next(rest_at).ids
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends, prepend=0)

    def _forget(self) -> None:
        """Drop long parts and those that were not used of late, so that half of the room is free."""
        keep = self.used >= np.partition(self.used, -self.most // 2)[-self.most // 2]
        keep &= pc.binary_length(self.held).to_numpy() <= 48
        sizes = np.diff(self.held_ends)
        self.held, self.used = self.held.filter(pa.array(keep)), self.used[keep]
        self.held_ids = self.held_ids[np.repeat(keep, sizes)]
        self.held_ends = np.append(0, np.cumsum(sizes[keep]))

    def count_many(self, texts: Sequence[str]) -> list[int]:
        """How many ids each whole text has; the cache holds a number for each part."""
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.sizes) >= self.entries:
            self.sizes.clear()
        known = self.sizes
        new = list({part for cut in cuts for part in cut}.difference(known))
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else []
        own = {k: len(e) for k, e in zip(new, found, strict=True)}
        known.update((k, n) for k, n in own.items() if len(k) <= 48)
        own = {k: n for k, n in own.items() if len(k) > 48}
        if own:
            return [sum([own[p] if p in own else known[p] for p in cut]) for cut in cuts]
        return [sum(map(known.__getitem__, cut)) for cut in cuts]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One encoder for each worker process."""
    return CachedEncoder(path)
