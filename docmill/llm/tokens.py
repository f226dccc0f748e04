"""Problem 8: the token ids of every text under a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer over bytes whose states
are determinised when they are first reached. A state is the set of positions at
which a longer token can still begin, each with the last token of the encoding
up to there; a token leaves the transducer as soon as every such position agrees
on it, so the lookahead is bounded by the longest token that is still possible.
Decoding runs the other way through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's owner cuts text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Memoised words and states per worker; beyond that the memo starts anew (speed only).
MEMO_WORDS, MEMO_STATES = 200_000, 60_000
BATCH_ROWS = 512
_START = -2


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Byte-level BPE of single words; ``encode`` of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((0, _START, -1),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.last: dict[int, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The defining procedure, lowest rank first; only for validating pairs of tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, token: int) -> bool:
        if before == _START:
            ok = self.alone.get(token)
            if ok is None:
                ok = self.alone[token] = self.merge(self.bytes_of[token]) == [token]
            return ok
        key = before << 20 | token
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return ok

    def _advance(self, state: tuple, b: int) -> tuple[tuple, tuple[int, ...]]:
        """Successor of a state, and the tokens that are settled by reaching it."""
        nodes = [self.child.get(n << 8 | b, -1) if n >= 0 else -1 for n, _, _ in state]
        for p, node in enumerate(nodes):
            if node >= 0 and self.token_at[node] >= 0 and self._fits(state[p][1], self.token_at[node]):
                token, link = self.token_at[node], p
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        rows = [(nodes[p], tok, up) for p, (_, tok, up) in enumerate(state)] + [(0, token, link)]
        used = [0] * len(rows)  # paths from live positions through each position
        live = 0
        for p, (node, _, _) in enumerate(rows):
            if node >= 0:
                live += 1
                q = p
                while q >= 0:
                    used[q] += 1
                    q = rows[q][2]
        root = max(p for p in range(len(rows)) if used[p] == live)
        settled, q = [], root
        while rows[q][2] >= 0:
            settled.append(rows[q][1])
            q = rows[q][2]
        keep = [p for p in range(root, len(rows)) if used[p]]
        place = {p: i for i, p in enumerate(keep)}
        new = tuple((rows[p][0], rows[p][1] if i or rows[p][0] >= 0 else -1, place[rows[p][2]] if i else -1) for i, p in enumerate(keep))
        return new, tuple(reversed(settled))

    def word(self, data: bytes) -> list[int]:
        """Token ids of one word of the cut text."""
        out: list[int] = []
        at, step = 0, self.step
        for b in data:
            key = at << 8 | b
            hit = step.get(key)
            if hit is None:
                new, settled = self._advance(self.states[at], b)
                to = self.number.get(new)
                if to is None:
                    to = self.number[new] = len(self.states)
                    self.states.append(new)
                hit = step[key] = (to, settled)
            at, settled = hit
            if settled:
                out.extend(settled)
        rest = self.last.get(at)
        if rest is None:
            state, q, found = self.states[at], len(self.states[at]) - 1, []
            while state[q][2] >= 0:
                found.append(state[q][1])
                q = state[q][2]
            rest = self.last[at] = tuple(reversed(found))
        out.extend(rest)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in self.cut(text):
            ids = words.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) >= MEMO_WORDS:
                        words.clear()
                    words[w] = ids
                if len(self.states) > MEMO_STATES:
                    self._reset()
            out.extend(ids)
        return out


class Utf8Machine:
    """Incremental UTF-8: bytes may stop anywhere inside a character.

    Every maximal broken part of a character becomes one U+FFFD.
    """

    def __init__(self) -> None:
        self.held, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode("utf-8"))
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held.append(b)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        broken = "�" if self.need else ""
        self.__init__()
        return broken


_READY: dict[str, Transducer] = {}


def transducer(path: str = VOCABULARY) -> Transducer:
    """The compiled vocabulary, kept for the life of the process."""
    if path not in _READY:
        _READY[path] = Transducer(load_ranks(path))
    return _READY[path]


def decode_stream(ids: Iterable[int], path: str = VOCABULARY) -> Iterator[str]:
    """Text of a stream of ids, piece by piece; unknown ids count as U+FFFD."""
    machine, own = Utf8Machine(), transducer(path).bytes_of
    for i in ids:
        piece = machine.feed(own[i]) if i in own else machine.end() + "�"
        if piece:
            yield piece
    if rest := machine.end():
        yield rest


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row of ``df``.

    Null and empty texts give an empty list; a blank text gives the tokens of its
    white space. Repeated rows and null ids are kept as they come. Strings such
    as ``<|endoftext|>`` are ordinary text. Columns besides the two are dropped,
    so their names can't clash. An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType

    def run(batches):
        t = transducer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                lists = [t.encode(x) if x else [] for x in part.column(1).to_pylist()]
                ends = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``text`` for each list of ids; a null list gives a null text."""
    kind = df.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            texts = [None if x is None else "".join(decode_stream(x, path)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    out = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Per row: number of tokens, and whether decoding them gives the text again.

    A null text counts as restored, since it has no tokens.
    """
    kind = df.schema[id_col].dataType

    def run(batches):
        t = transducer(path)
        for batch in batches:
            n, same = [], []
            for x in batch.column(1).to_pylist():
                ids = t.encode(x) if x else []
                n.append(len(ids))
                same.append("".join(decode_stream(ids, path)) == (x or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same)], ["id", "n_tokens", "restored"])

    out = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("restored", T.BooleanType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)
