"""Token ids of whole texts, from a public vocabulary file and the tokenizers library.

The library needs about 1.4 s per MB of text, nearly all of it for words that it has met before. So a batch of texts is
cut where no token crosses, each distinct piece is encoded once, and ids are gathered by position. `test_tokens.py` holds the result against the library on whole texts.
"""

from __future__ import annotations

import json
import os
import sys
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"

#: Bytes of text that are encoded together, and pieces that a worker remembers.
CHUNK_BYTES = 4_000_000
REMEMBERED = 250_000

#: Texts of these characters alone are cut by pattern: lower-casing and composition leave such letters one letter each,
#: a run of marks is one pretoken, and so is each digit. Others (apostrophes and "<" among them) are cut at spaces only.
_ODD = r"[^\n A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=>?@\[-`{-~]"
_MARKS = r"([!-&(-/:;=>?@\[-`{-~]+|[0-9])[ \n]?"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file; the folder is $TOKENIZERS_DIR, or that of the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


class Encoder:
    """Ids of many texts at a time, the same as the library gives for each whole text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self.size = self._whole.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        # The short cut holds for vocabularies of the kind that marks word ends and drops white space.
        pretokens = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self._short = stated["model"].get("end_of_word_suffix") == "</w>" and any(
            p.get("behavior") == "Removed" for p in pretokens
        )
        # For pieces that are pretokens already: bytes as the file's letters, one word between two spaces.
        self._words = Tokenizer.from_file(path)
        self._words.normalizer = None
        self._words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {ord(c): letters.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self._ends = np.zeros(self.size, dtype=bool)
        self._ends[[i for w, i in self._words.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True
        self._known: dict[str, int] = {}
        self._flat = np.empty(1 << 16, dtype=np.int32)
        self._start = np.zeros(1 << 14, dtype=np.int32)
        self._length = np.zeros(1 << 14, dtype=np.int32)
        self._used = 0

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each. Null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        if not self._short:
            return self._by_library(texts.to_pylist())
        reach = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
        cuts = np.searchsorted(reach, np.arange(CHUNK_BYTES, reach[-1], CHUNK_BYTES)) + 1
        bounds = sorted({0, *cuts.tolist(), len(texts)})
        parts = [self._chunk(texts.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self._whole.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((i for e in ids for i in e), dtype=np.int32)
        return flat, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def _by_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of lower-case letters, of marks, or of one digit: each ends where a token ends a word."""
        joined = " ".join(w if w.isascii() else w.translate(self._letters) for w in words)
        flat = np.asarray(self._words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
        stops = np.flatnonzero(self._ends[flat]) + 1
        return (flat, np.diff(stops, prepend=0)) if len(stops) == len(words) else self._by_library(words)

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        if not odd.any():
            return self._plain(texts)
        order = np.argsort(odd, kind="stable")
        plain, plain_lengths = self._plain(texts.filter(pa.array(~odd)))
        rest, rest_lengths = self._odd(texts.filter(pa.array(odd)))
        lengths = np.empty(len(odd), dtype=np.int64)
        lengths[order] = np.concatenate([plain_lengths, rest_lengths])
        flat = np.concatenate([plain, rest])
        starts = np.empty(len(odd), dtype=np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return flat[_runs(starts, lengths)], lengths

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), _MARKS, r" \1 ")
        return self._gather(pc.split_pattern(pc.replace_substring(spaced, "\n", " "), " "), self._by_words)

    def _odd(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cut at spaces and line ends alone, each piece encoded as a text of its own, not kept."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.list_flatten(lists).dictionary_encode()
        flat, lengths = self._by_library(coded.dictionary.to_pylist())
        return _per_list(lists, np.asarray(coded.indices), np.cumsum(lengths) - lengths, lengths, flat)

    def _gather(self, lists: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        coded = pc.list_flatten(lists).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, used, count = self._known, self._used, len(self._known)
        row = np.fromiter((known.get(p, -1) for p in pieces), dtype=np.int32, count=len(pieces))
        new = np.flatnonzero(row < 0)
        words = [pieces[i] for i in new.tolist()]
        if words:
            empty = [w for w in words if not w]  # between two spaces
            flat, lengths = encode([w for w in words if w]) if len(words) > len(empty) else (np.empty(0, np.int32), [])
            if empty:
                lengths = np.insert(lengths, words.index(""), 0)
            self._store(flat, np.asarray(lengths), used, count)
            row[new] = np.arange(count, count + len(words))
        out = _per_list(lists, row[np.asarray(coded.indices)], self._start, self._length, self._flat)
        if words and count + len(words) <= REMEMBERED:  # words met first are the frequent ones; later ones are encoded again
            known.update(zip(words, range(count, count + len(words)), strict=True))
            self._used = used + len(flat)
        return out

    def _store(self, flat: np.ndarray, lengths: np.ndarray, used: int, count: int) -> None:
        if used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty(max(len(flat), len(self._flat)), dtype=np.int32)])
        if count + len(lengths) > len(self._start):
            more = np.zeros(max(len(lengths), len(self._start)), dtype=np.int32)
            self._start, self._length = np.concatenate([self._start, more]), np.concatenate([self._length, more])
        self._flat[used : used + len(flat)] = flat
        self._length[count : count + len(lengths)] = lengths
        self._start[count : count + len(lengths)] = used + np.cumsum(lengths) - lengths


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all runs, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) + total < 2**31) else np.int64
    return np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)


def _per_list(lists, row, starts, lengths, flat) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each list of pieces."""
    of = lengths[row]
    ids = flat[_runs(starts[row].astype(np.int64), of)]
    reach = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
    per_list = np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))
    return ids, np.diff(reach[per_list], prepend=0)


def little_endian(ids: np.ndarray) -> bytes:
    """Ids as unsigned 32-bit little-endian integers."""
    return np.ascontiguousarray(ids, dtype="<u4").tobytes()


if sys.byteorder != "little":  # pragma: no cover
    raise ImportError("ids are kept in little-endian order")
