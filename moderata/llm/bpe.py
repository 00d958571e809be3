"""Byte-level BPE over Arrow columns: every distinct unit of text between two single spaces is encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A unit that may not be cut off from its neighbours: empty, or white space at an end.
_OPEN = f"^$|^[{_SPACE}]|[{_SPACE}]$"
#: Bytes of units and their ids that a Python worker remembers, about (it forgets all at this size), and characters of the
#: longest unit that is worth it: longer ones seldom come again.
REMEMBERED_BYTES, REMEMBERED_LENGTH = 64 << 20, 64


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Ids of a `tokenizers` file, without begin, end or added special tokens; special strings in a text are found as by its default.

    The pre-tokenizer never joins what a single space between two other characters parts, so a text is the sum of its
    units: the first, and every later one with its space. Texts in which a unit has white space at an end are encoded
    whole. Where the file's ids follow its merges, units go through the equal but faster `tiktoken`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.by_units = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("post_processor") and not any(" " in s or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for s, t in zip(self.special, spec.get("added_tokens", []), strict=True))
        self.fast = self._fast(spec["model"]) if self.by_units else None
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _fast(self, model: dict):
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if model.get("type") != "BPE" or model.get("ignore_merges") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, np.uint32).tobytes()

    def _remembered(self, units: list[str]) -> list[bytes]:
        if self.known_bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.known_bytes = 0
        known, out = self.known, []
        for unit in units:
            ids = known.get(unit)
            if ids is None:
                ids = self._encode(unit)
                if len(unit) <= REMEMBERED_LENGTH:
                    known[unit] = ids
                    self.known_bytes += 200 + len(unit) + len(ids)  # with the objects around them
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text); null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_units:
            parts = [np.frombuffer(self._encode(t), np.uint32) for t in texts.to_pylist()]
            return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, parts)])
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy()
        ends = ends - ends[0]
        units = split.flatten().dictionary_encode()
        place = units.indices.to_numpy()
        whole = np.zeros(len(texts), bool)
        open_ = pc.match_substring_regex(units.dictionary, _OPEN).to_numpy(zero_copy_only=False)
        if len(place):
            whole = np.logical_or.reduceat(open_[place], ends[:-1])
        some = np.diff(ends) == 1  # a text of one unit needs no neighbours
        whole &= ~some
        later = np.ones(len(place), bool)
        later[ends[:-1]] = False
        later &= ~np.repeat(whole, np.diff(ends))
        used = np.zeros(len(open_), bool)
        used[place[later]] = True
        used = np.flatnonzero(used)
        number = np.zeros(len(open_), np.int64)
        number[used] = np.arange(len(used))
        pieces = self._remembered([" " + u for u in units.dictionary.take(pa.array(used)).to_pylist()])
        values = units.dictionary
        heads = [self._encode(texts[i].as_py()) if w else self._encode(values[k].as_py()) for i, (w, k) in enumerate(zip(whole.tolist(), place[ends[:-1]].tolist(), strict=True))]
        pool = np.frombuffer(b"".join([*pieces, *heads]), np.uint32)
        size = np.array([len(x) // 4 for x in [*pieces, *heads]], np.int64)
        at = np.cumsum(size) - size
        # The units in order: a head for each text, then its later units.
        which = np.where(later, number[place], -1)
        which[ends[:-1]] = len(pieces) + np.arange(len(texts))
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        kept = which >= 0
        which, text = which[kept], text[kept]
        n = size[which]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.arange(total[-1]) + np.repeat(at[which] - total[:-1], n)]
        return ids, total[np.searchsorted(text, np.arange(len(texts) + 1))]

    def splices(self, text: str, chunk: int, overlap: int) -> Iterator[tuple[int, list[int]]]:
        """(start, ids) of the parts of a text, encoded by overlapping chunks.

        Two chunks are spliced at a place where both begin a word of the pre-tokenizer. That place is proven stable:
        the pre-tokenizer goes from left to right and looks at most one character ahead, so after a common beginning
        both agree; and the left chunk is right there as long as its own end is further away than a special token is
        long. Where the overlap holds no such place (one long word), chunk and overlap are doubled.
        """
        margin = max([len(s) for s in self.special], default=0) + 2
        start = done = 0
        left = self._view(text, start, chunk)
        while True:
            end, (at, words, ids) = start + chunk, left
            if end >= len(text):
                yield done, ids[np.searchsorted(at, done) :].tolist()
                return
            begin = max(end - overlap, start + 1)
            right = self._view(text, begin, chunk)
            common = np.intersect1d(words, right[1])
            common = common[(common > max(done, begin)) & (common <= end - margin)]
            if not len(common):
                chunk, overlap = chunk * 2, overlap * 2
                left = self._view(text, start, chunk)
                continue
            cut = int(common[-1])
            yield done, ids[np.searchsorted(at, done) : np.searchsorted(at, cut)].tolist()
            start, done, left = begin, cut, right

    def _view(self, text: str, start: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of text[start : start + chunk]: the place of each token, the places where words begin, the ids."""
        got = self.whole.encode(text[start : start + chunk], add_special_tokens=False)
        at = np.array([a for a, _ in got.offsets], np.int64) + start
        word = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
        first = np.concatenate(([True], (word[1:] != word[:-1]) | (word[1:] < 0))) if len(word) else np.zeros(0, bool)
        return at, at[first], np.array(got.ids, np.int64)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of a file, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
