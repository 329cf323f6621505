"""Token ids by a tokenizer file of the tokenizers library.

Where the file's rules allow it (they drop white space, let no token span it, and mark each word's last token),
a text's ids are those of its pieces between white space, one after another. Arrow splits a batch's texts and
finds the different pieces; a piece's ids lie in one flat array that a worker keeps, and a text's ids are
gathered from there. New pieces go through the library many at a time. When the store holds MOST pieces (or as many as
the caller says) or MOST_IDS ids, only those that were met in several batches stay, so memory is bounded. Files with other rules encode whole texts
in the library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST, MOST_IDS = 500_000, 1 << 23
#: New pieces go through the library so many at a time.
TOGETHER = 1000
#: The rules under which pieces may be encoded apart: white space is dropped, and a match of the pattern holds none.
_DROPS_SPACE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Pieces in lower case are not looked for special tokens, whose spelling starts so.
_SPECIAL = "<|"


def _by_piece(rules: dict) -> bool:
    norm, pre = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        [n.get("type") for n in norm.get("normalizers", [])] == _NORMALIZERS
        and pre[0].get("pattern") == {"Regex": _DROPS_SPACE}
        and bool(pre[0].get("invert"))
        and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
        and not pre[1].get("add_prefix_space")
        and rules["model"].get("end_of_word_suffix") == "</w>"
        and rules["model"].get("dropout") is None
        and all(_SPECIAL in t["content"] and not t["normalized"] for t in rules.get("added_tokens", []))
        and not rules.get("truncation")
    )


class WordBpe:
    def __init__(self, path: str, most: int | None = None) -> None:
        self.most = most or MOST
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_piece = _by_piece(json.load(f))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.lengths, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots' ids, one after another, and where each slot's end."""
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[slots] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.ids[at], ends

    def _add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keeps new pieces whose ids lie one after another."""
        first, n = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.used += len(ids)
        self.known.update(zip(pieces, range(first, first + n)))

    def _trim(self) -> None:
        """Keeps the pieces met in most batches, two at least, as long as they fill no more than half the store."""
        n = len(self.known)
        met, lengths = self.met[:n], self.lengths[:n]
        least = 2
        while (stay := met >= least).sum() > self.most // 2 or lengths[stay].sum() > MOST_IDS // 2:
            least *= 2
        kept = [p for p, s in self.known.items() if stay[s] and p]
        ids, ends = self._gathered(np.array([self.known[p] for p in kept], np.int64))
        self._empty()
        self._add(kept, ids, np.diff(ends, prepend=0))

    def _learn(self, pieces: list[str]) -> None:
        """A full stop or comma that ends a piece after an ASCII letter is a token of its own, so that the rest is
        looked up without it."""
        known = self.known
        ended = [p for p in pieces if p[-1] in ".," and "a" <= p[-2:-1] <= "z"]
        whole = set(pieces).difference(ended)
        whole.update(p[:-1] for p in ended)
        whole.update(p[-1] for p in ended)
        whole = sorted(whole - known.keys())
        letters, rest = [p for p in whole if p.isalpha()], [p for p in whole if not p.isalpha()]
        for i in range(0, len(letters), TOGETHER):
            some = letters[i : i + TOGETHER]
            ids = self._library([" ".join(some)])[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):  # each piece is one word at least, so each is just one
                self._add(some, ids, np.diff(ends, prepend=0))
            else:
                rest += some
        for i in range(0, len(rest), TOGETHER):
            found = self._library(rest[i : i + TOGETHER])
            self._add(rest[i : i + TOGETHER], np.concatenate(found), np.array([len(x) for x in found]))
        if ended:
            pairs = np.array([s for p in ended for s in (known[p[:-1]], known[p[-1]])])
            ids, ends = self._gathered(pairs)
            self._add(ended, ids, np.diff(ends[1::2], prepend=0))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids, as unsigned 32-bit integers."""
        if not self.by_piece:
            return self._library(texts.to_pylist())
        if len(self.known) > self.most or self.used > MOST_IDS:
            self._trim()
        odd = pc.match_substring(texts, _SPECIAL)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
        pieces = lists.flatten().dictionary_encode()
        found, get = pieces.dictionary.to_pylist(), self.known.get
        slots = [get(p) for p in found]
        if new := [i for i, s in enumerate(slots) if s is None]:
            self._learn([found[i] for i in new])
            for i in new:
                slots[i] = get(found[i])
        slots = np.array(slots, np.int64)
        self.met[slots] += 1
        ids, ends = self._gathered(slots[pieces.indices.to_numpy()])
        ends = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._library([texts[i].as_py()])[0]
        return out


@lru_cache(maxsize=2)
def word_bpe(path: str, most: int | None = None) -> WordBpe:
    """One encoder a worker process. most: pieces that it keeps, MOST unless given."""
    return WordBpe(path, most)


def parts(batch: pa.RecordBatch, text: int = 1, rows: int = 4096, size: int = 1 << 23):
    """A batch in parts of at most so many rows, and of so many bytes of text unless one row has more."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - at))
        yield batch.slice(at, n)
        at += n


def batches(batch: pa.RecordBatch, rows: int = 200):
    """(ids, texts) of an Arrow batch of doc_id and text, a few rows at a time."""
    for part in parts(batch, rows=rows):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()
