"""Token ids of texts under a word BPE (word ends, white space dropped).

The merges of many words run side by side: words of similar length are rows of
a matrix of symbols, and each round merges, in every row, the leftmost pair of
the lowest rank, as the library does word by word.  A block of texts is encoded
by its distinct words; nothing grows with the number of blocks.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import BYTE_LETTERS

LONGEST = 256
CELLS = 1 << 18

#: Normalizer and pre-tokenizer (fixed values of the vocabulary file) that cut a text as ``PIECE`` does.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"

#: Texts within ASCII, Latin-1, Latin Extended-A, dashes, quotes, other general punctuation and currency signs are cut
#: here (this pattern finds what is beyond, and special strings).  No such character composes, U+0130 apart each
#: lower-cases on its own and alike everywhere, and its class is beyond doubt.  Whatever else a text holds, the library cuts it.
ODD = (r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{12f}\x{131}-\x{17f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}]|<\|")

NO_PAIR = np.int32(1 << 30)


class Merges:
    """Ranked merges of a BPE whose words end in ``WORD_END``."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], dtype: np.dtype):
        self.size = max(vocabulary.values()) + 1
        self.dtype = dtype
        inner, last = (np.array([vocabulary[BYTE_LETTERS[b] + end] for b in range(256)], np.int32) for end in ("", WORD_END))
        self.inner, self.last = inner, last
        pairs = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols (``NO_PAIR``: none; symbols below 0 pair with nothing)."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NO_PAIR)

    def ids(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, library) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:start + length] (UTF-8), one after the
        other, and how many each has.  Very long words go to ``library``."""
        parts, count = [], np.zeros(len(start), np.int64)
        order = np.argsort(length, kind="stable")
        stop = np.searchsorted(length[order], LONGEST, "right")
        at = 0
        while at < stop:  # words of about one length; as many as fill a matrix of CELLS
            low = int(length[order[at]])
            rows = order[at:min(stop, at + max(1, CELLS // (low + low // 4 + 2)))]
            rows = rows[length[rows] <= low + low // 4]
            flat, count[rows] = self._side_by_side(data, start[rows], length[rows])
            parts.append((rows, flat))
            at += len(rows)
        for k in order[stop:].tolist():
            flat = library([data[start[k]:start[k] + length[k]].tobytes().decode()])[0]
            count[k] = len(flat)
            parts.append((np.array([k]), flat))
        before = np.cumsum(count) - count
        out = np.empty(int(count.sum()), self.dtype)
        for rows, flat in parts:
            out[runs(before[rows], count[rows])] = flat
        return out, count

    def _side_by_side(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, rows = int(n.max()) + 2, np.arange(len(n))  # a column without a symbol on either side
        inside = np.arange(width)[None, :] - 1
        symbol = np.full((len(n), width), -1, np.int32)
        symbol[(inside >= 0) & (inside < n[:, None])] = self.inner[data[runs(start, n)]]
        symbol[rows, n] = self.last[data[start + n - 1]]
        rank = np.full((len(n), width), NO_PAIR, np.int32)
        rank[:, :-1] = self.ranks(symbol[:, :-1], symbol[:, 1:])
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (len(n), width)).copy()
        before = after - 2
        live = rows
        while len(live):
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            going = best < NO_PAIR
            live, at, best = live[going], at[going], best[going]
            if not len(live):
                break
            gone = after[live, at]
            next_, prev = after[live, gone], before[live, at]
            symbol[live, at] = self.made[best]
            symbol[live, gone] = -1
            rank[live, gone] = NO_PAIR
            after[live, at], before[live, next_] = next_, at
            rank[live, at] = self.ranks(symbol[live, at], symbol[live, next_])
            rank[live, prev] = self.ranks(symbol[live, prev], symbol[live, at])
        kept = symbol >= 0
        return symbol[kept].astype(self.dtype), kept.sum(axis=1)


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


#: Classes of characters within the alphabet cut here.
SPACE, LETTER, NUMBER, MARK = range(4)


def _classes() -> np.ndarray:
    kind = np.full(0x2100, MARK, np.uint8)
    kind[[*range(9, 14), 0x20, 0xA0]] = SPACE
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]] = LETTER
    kind[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
    return kind


CLASS = _classes()


def pieces(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text, and where its pieces start and how long they are: runs
    of letters, single numbers, runs of marks; an apostrophe that starts a run of
    marks takes a following s, t, m, d, re, ve or ll with it."""
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = CLASS[code]
    first = np.ones(len(code), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    letter = np.concatenate([code, [0, 0, 0]])
    here = np.flatnonzero(first & (code == ord("'")))
    one, two = letter[here + 1], letter[here + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long_ = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    size = np.where(short, 2, np.where(long_, 3, 0))
    here, size = here[size > 0], size[size > 0]
    first[here + 1] = False
    after = here + size
    after = after[after < len(code)]
    first[after] |= kind[after] == LETTER
    first &= kind != SPACE
    width = 1 + (code > 0x7F) + (code > 0x7FF)
    at = np.cumsum(width) - width
    starts = np.flatnonzero(first)
    edge = np.concatenate([np.flatnonzero(first | (kind == SPACE)), [len(code)]])
    stops = edge[np.searchsorted(edge, starts, "right")]
    at = np.concatenate([at, [int(width.sum())]])
    return np.frombuffer(joined.encode(), np.uint8), at[starts], at[stops] - at[starts]


class WordIds:
    """Ids of texts under one tokenizer.

    The words of a block of texts are numbered by ``dictionary_encode``; each
    distinct word is cut into pieces and encoded once, and ``take`` by number
    puts the ids in place.  Texts with a character outside ``ODD``'s alphabet, unsure
    white space or a special string, and all texts under a tokenizer of another
    make, go to the library whole.  Nothing is kept from block to block."""

    def __init__(self, tokenizer_json: bytes):
        self.tok = Tokenizer.from_buffer(tokenizer_json)
        made = json.loads(tokenizer_json)
        model = made["model"]
        self.n_ids = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        cut = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = (made.get("normalizer") == NORMALIZER and model.get("end_of_word_suffix") == WORD_END
                      and not model.get("dropout") and not model.get("ignore_merges")
                      and cut[0].get("pattern") == {"Regex": SPLIT} and [c.get("type") for c in cut] == ["Split", "ByteLevel"])
        if self.known:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merges = Merges(model["vocab"], merges, self.dtype)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, one text after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD) if self.known else pa.array([True] * len(texts))
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.take(pa.array(plain))))
        words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(words), 0)
        coded = words.filter(real).dictionary_encode()
        number, owner = coded.indices.to_numpy(), owner.filter(real).to_numpy()
        count, parts = np.zeros(len(texts), np.int64), []
        if len(number):
            data, start, length = pieces(" ".join(coded.dictionary.to_pylist()))
            flat, n = self.merges.ids(data, start, length, self.library)
            spaces = np.cumsum(data == 0x20)
            word_of = spaces[start]  # words are joined by one space each
            per_word = np.bincount(word_of, weights=n, minlength=len(coded.dictionary)).astype(np.int64)
            first = np.cumsum(per_word) - per_word
            taken = flat[runs(first[number], per_word[number])]
            count[plain] = np.bincount(owner, weights=per_word[number], minlength=len(plain)).astype(np.int64)
            parts.append((plain, taken))
        strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        for at in range(0, len(strange), 64):
            some = strange[at:at + 64]
            found = self.library(texts.take(pa.array(some)).to_pylist())
            count[some] = [len(f) for f in found]
            parts.append((some, np.concatenate(found)))
        before = np.cumsum(count) - count
        out = np.empty(int(count.sum()), self.dtype)
        for rows, flat in parts:
            out[runs(before[rows], count[rows])] = flat
        return out, count
