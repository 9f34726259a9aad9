"""Token counts by dynamic programming over prefixes.

For a byte-level BPE the encoding of every prefix of an encoding is the
encoding of the text it covers.  So the last token of each prefix of a piece
can be found from the shorter prefixes: it is the token ``t`` that ends there
and that BPE keeps apart from the last token of the prefix before it.  One
pass over a piece gives the exact token count of all its prefixes; the table
of a text is the concatenation of the tables of its chunks (white space and
the run it leads to), each kept as differences from one code point to the
next.  Truncation and budget questions are then read off the stored table.

Nulls and empty texts count zero tokens and have an empty table.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import BYTE_LETTERS, ChunkTable, GenerationCache, chunk_keys, chunk_of, file_bytes, per_worker, slices, texts_to_python

#: Split of byte-level BPE before its merges (the library's own pattern).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CONTRACTIONS = frozenset(["'re", "'ve", "'ll"])
CACHE_ENTRIES = 300_000


class PrefixTable(ChunkTable):
    """Token counts of all prefixes under one byte-level BPE tokenizer."""

    def __init__(self, tokenizer_json: bytes, entries: int = CACHE_ENTRIES):
        super().__init__(entries)
        tok = Tokenizer.from_buffer(tokenizer_json)
        self.model = tok.model
        self.special = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.vocab = frozenset(tok.get_vocab(with_added_tokens=False))
        self.reach: dict[str, int] = {}  # longest token by its last three letters
        for t in self.vocab:
            self.reach[t[-3:]] = max(self.reach.get(t[-3:], 0), len(t))
        self.letters = BYTE_LETTERS
        self.whole = GenerationCache(self._is_whole, entries)
        self.apart = GenerationCache(self._stay_apart, entries)

    def _is_whole(self, token: str) -> bool:
        return len(self.model.tokenize(token)) == 1

    def _stay_apart(self, pair: tuple[str, str]) -> bool:
        return [t.value for t in self.model.tokenize(pair[0] + pair[1])] == list(pair)

    def count_prefixes(self, pieces: set[str]) -> dict[str, list[int]]:
        """Token counts at the code point ends of each piece.  Pieces are taken
        in sorted order, so the states of a shared prefix are computed once."""
        vocab, whole, apart, reach = self.vocab, self.whole, self.apart, self.reach
        out: dict[str, list[int]] = {}
        was, last, count = "", [""], [0]
        for piece in sorted(pieces):
            s = piece.encode().decode("latin-1").translate(self.letters)
            k, n = 0, min(len(s), len(was))
            while k < n and s[k] == was[k]:
                k += 1
            del last[k + 1:], count[k + 1:]
            for i in range(k + 1, len(s) + 1):
                far = reach.get(s[i - 3:i] if i > 3 else s[:i], 2)
                for j in range(i - far if i > far else 0, i):
                    t = s[j:i]
                    if t in vocab and (apart[last[j], t] if j else whole[t]):
                        last.append(t)
                        count.append(count[j] + 1)
                        break
                else:
                    raise ValueError(f"no encoding of a prefix of {piece!r}: not a byte-level BPE")
            was = s
            if len(s) == len(piece):
                out[piece] = count[1:]
            else:  # a prefix that ends inside a code point is no text
                ends = accumulate(len(c.encode()) for c in piece)
                out[piece] = [count[e] for e in ends]
        return out

    @staticmethod
    def _pieces(chunk: str) -> list[str]:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in ",." and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return PIECE.findall(chunk)

    def values(self, keys: list[str]) -> dict[str, bytes]:
        """Per chunk the differences of the token count from each code point to
        the next, as little-endian 16-bit integers."""
        pieces = {k: self._pieces(chunk_of(k)) for k in keys}
        wanted = {p for ps in pieces.values() for p in ps}
        wanted |= {p[:i] for p in wanted if p[0] in "' " or p.isspace() for i in (1,)}
        wanted |= {p[1:i] for p in wanted if p in CONTRACTIONS for i in range(2, len(p))}
        counts = self.count_prefixes(wanted)
        return {k: self._deltas(chunk_of(k), ps, counts) for k, ps in pieces.items()}

    def _deltas(self, chunk: str, pieces: list[str], counts: dict[str, list[int]]) -> bytes:
        if len(pieces) == 1 and pieces[0] not in CONTRACTIONS:
            table = counts[pieces[0]]
        else:
            table, before, at = [], 0, 0
            spaces = len(chunk) - len(chunk.lstrip())
            for piece in pieces:
                here = counts[piece]
                total = here[-1]
                if piece in CONTRACTIONS:
                    # cut short it is an apostrophe and letters, two pieces
                    here = [counts["'"][0], *(counts["'"][0] + counts[piece[1:k]][-1] for k in range(2, len(piece))), total]
                if 0 < at < spaces:
                    # a cut inside the white space leaves one run, not a run and a led piece
                    run = self.count_prefixes({chunk[:spaces]})[chunk[:spaces]]
                    cut = min(spaces, at + len(piece))
                    here = [*(n - before for n in run[at:cut]), *here[cut - at:]]
                    if at + len(piece) == cut:
                        total = counts[piece][-1]
                        if cut == spaces and len(chunk) == spaces:
                            here[-1] = total
                table += [before + n for n in here]
                before += total
                at += len(piece)
        return array("h", map(sub, table, [0, *table])).tobytes()

    def text_deltas(self, text: str, keys: list[str]) -> bytes:
        """Differences of the token count over the code points of a whole text."""
        if any(s in text for s in self.special):
            return self._with_specials(text)
        return b"".join(map(self.cache.__getitem__, keys))

    def _plain(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, chunk_keys(text))), "<i2")

    def _with_specials(self, text: str) -> bytes:
        """The library reads a special string inside a text as one token; while
        it is incomplete its prefix counts as ordinary text."""
        out, before = b"", ""
        for part in self.special_re.split(text):
            if part not in self.special:
                before = part
                continue
            d = self._plain(before + part).copy()
            d[-1] += int(self._plain(before).sum(dtype=np.int64)) + 1 - int(d.sum(dtype=np.int64))
            out, before = out + d.tobytes(), ""
        return out + self._plain(before).tobytes()


def prefix_token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                        budgets: tuple[int, ...] = (), keep_table: bool = True) -> DataFrame:
    """One row per row of ``df``: the id, n_bytes (UTF-8), n_tokens, for each
    budget ``fit_<budget>`` (code points of the longest prefix of at most that
    many tokens) and, with ``keep_table``, prefix_deltas: the stored table, as
    little-endian 16-bit differences per code point (see ``tokens_of_prefix``
    and ``longest_prefix``).  Repeated rows are answered each; further columns
    are not carried."""
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(file_bytes(tokenizer_path))  # a fixed file, under 2 MB
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
              T.StructField("n_tokens", T.LongType()), *(T.StructField(f"fit_{b}", T.LongType()) for b in budgets)]
    if keep_table:
        fields.append(T.StructField("prefix_deltas", T.BinaryType()))
    names = [f.name for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = per_worker(PrefixTable, vocabulary.value)
        for batch in slices(batches):
            n_bytes, n_tokens, stored, fits = [], [], [], [[] for _ in budgets]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text, keys in zip(texts, tables.blocks(texts)):
                n_bytes.append(len(text.encode()))
                deltas = tables.text_deltas(text, keys)
                at = np.cumsum(np.frombuffer(deltas, "<i2"), dtype=np.int64)
                n_tokens.append(int(at[-1]) if len(at) else 0)
                for out, budget in zip(fits, budgets):
                    within = np.flatnonzero(at <= budget) if n_tokens[-1] > budget else None
                    out.append(len(at) if within is None else int(within[-1]) + 1 if len(within) else 0)
                if keep_table:
                    stored.append(deltas)
            arrays = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                      *(pa.array(f, pa.int64()) for f in fits)]
            if keep_table:
                arrays.append(pa.array(stored, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts_to_python(df, id_col, text_col).mapInArrow(count, T.StructType(fields))


def tokens_of_prefix(deltas: str | Column, n_chars: str | Column) -> Column:
    """Token count of the first ``n_chars`` code points, read off a stored table."""
    @F.pandas_udf(T.LongType())
    def read(d, n):
        import pandas as pd
        return pd.Series([int(np.frombuffer(x, "<i2")[:max(0, k)].sum(dtype=np.int64)) for x, k in zip(d, n)])
    return read(deltas, n_chars)


def longest_prefix(deltas: str | Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, read off a stored table."""
    @F.pandas_udf(T.LongType())
    def read(d):
        import pandas as pd
        def one(x):
            within = np.flatnonzero(np.cumsum(np.frombuffer(x, "<i2"), dtype=np.int64) <= budget)
            return int(within[-1]) + 1 if len(within) else 0
        return pd.Series([one(x) for x in d], dtype="int64")
    return read(deltas)
