"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are turned into arrays of code-point classes. A small automaton tells where a contraction (``'s``, ``'ll``, ...)
ends; its steps are functions on states, and since composing functions is associative, all states are found by a
blocked scan over the function monoid instead of a loop over characters. Classes and states give every boundary of

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regular expression. The resulting slices feed pair merging by rank through a cache of bounded size. The byte
offset of every token is kept, and decoding joins the tokens' bytes.

Defined cases: a null or empty text has no tokens and decodes to no bytes. Texts of any length are taken whole. Special
tokens are ordinary text. Each row is encoded by itself; null or repeated ids and other columns don't matter.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import batches, raw, small_batches

LETTER, L_STMD, L_RV, L_E, L_L, NUMBER, BLANK, SPACE, QUOTE, OTHER, END = range(11)
#: Code points with the Unicode property White_Space. Fixed values.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
FREE, HELD, AT_QUOTE, AT_RV, AT_L, ENDS_2, ENDS_3 = range(7)
BLOCK = 64


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            table[cp] = kind
    table[WHITE_SPACE] = SPACE
    for chars, kind in (("stmd", L_STMD), ("rv", L_RV), ("e", L_E), ("l", L_L), (" ", BLANK), ("'", QUOTE)):
        table[[ord(c) for c in chars]] = kind
    return table


def _step(state: int, symbol: int) -> int:
    if symbol <= L_L:
        if state == AT_QUOTE:
            return {L_STMD: ENDS_2, L_RV: AT_RV, L_L: AT_L}.get(symbol, FREE)
        return ENDS_3 if (state, symbol) in ((AT_RV, L_E), (AT_L, L_L)) else FREE
    if symbol == QUOTE:
        return HELD if state in (HELD, AT_QUOTE) else AT_QUOTE
    return HELD if symbol in (BLANK, OTHER) else FREE


class Automaton:
    """The monoid that the symbols' step functions generate, with its composition table."""

    def __init__(self):
        self.step = np.array([[_step(s, x) for s in range(7)] for x in range(11)], dtype=np.uint8)
        found = {tuple(range(7)): 0}
        todo = [tuple(range(7))]
        for x in range(11):
            f = tuple(int(v) for v in self.step[x])
            if f not in found:
                found[f] = len(found)
                todo.append(f)
        generators = list(found)
        while todo:
            f = todo.pop()
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in found:
                    found[h] = len(found)
                    todo.append(h)
        self.functions = np.array(list(found), dtype=np.uint8)
        self.of_symbol = np.array([found[tuple(int(v) for v in self.step[x])] for x in range(11)], dtype=np.uint8)
        n = len(found)
        assert n <= 256
        self.then = np.array([[found[tuple(int(b[s]) for s in a)] for b in self.functions] for a in self.functions], dtype=np.uint8).ravel()
        self.size = n

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """For each place the composition of all functions before it (exclusive scan)."""
        n = len(functions)
        if n <= BLOCK:
            out = np.zeros(n, dtype=np.uint8)
            for i in range(1, n):
                out[i] = self.then[int(out[i - 1]) * self.size + int(functions[i - 1])]
            return out
        blocks = -(-n // BLOCK)
        padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
        padded[:n] = functions
        columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        total = np.zeros(blocks, dtype=np.uint8)
        for column in columns:
            total = self.then[total.astype(np.intp) * self.size + column]
        current = self.scan(total)
        out = np.empty((BLOCK, blocks), dtype=np.uint8)
        for i, column in enumerate(columns):
            out[i] = current
            current = self.then[current.astype(np.intp) * self.size + column]
        return out.T.reshape(-1)[:n]

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol, from ``FREE`` at the start."""
        before = self.functions[:, FREE][self.scan(self.of_symbol[symbols])]
        return self.step.ravel()[symbols.astype(np.intp) * 7 + before]


_MADE: dict[str, object] = {}


def tables() -> tuple[np.ndarray, Automaton]:
    if "tables" not in _MADE:
        _MADE["tables"] = (_classes(), Automaton())
    return _MADE["tables"]


def slices(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined by a line feed, byte start and end of every piece, and the number of pieces of each text."""
    classes, automaton = tables()
    joined = b"\n".join(texts) + b"\n"
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    if joined.isascii():
        chars, at = np.frombuffer(joined, dtype=np.uint8), None
    else:
        chars = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        width = np.ones(len(chars), dtype=np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += chars >= least
        at = np.cumsum(width) - width
    stops = ends if at is None else np.searchsorted(at, ends)
    symbols = classes[chars]
    symbols[stops] = END
    state = automaton.states(symbols)
    group = np.array([0, 0, 0, 0, 0, 1, 2, 2, 3, 3, 4], dtype=np.uint8)[symbols]
    previous, following = np.empty_like(group), np.empty_like(group)
    previous[0], previous[1:] = 4, group[:-1]
    following[-1], following[:-1] = 4, group[1:]
    after_blank = np.zeros(len(symbols), dtype=bool)
    after_blank[1:] = symbols[:-1] == BLANK
    is_space = group == 2
    start = np.where(is_space, (previous != 2) | ((following != 2) & (following != 4)), (group != previous) & ~after_blank)
    for last, back in ((ENDS_2, 1), (ENDS_3, 2)):
        found = np.flatnonzero(state == last)
        for k in range(back):
            start[found - k] = False
        start[found + 1] = True
    start[stops] = True
    first = np.flatnonzero(start)
    is_end = group[first] == 4
    begin = first[~is_end]
    end = first[1:][~is_end[:-1]] if len(first) > 1 else first[:0]
    counts = np.diff(np.concatenate(([0], np.cumsum(~is_end)[is_end]))).astype(np.int64)
    if at is not None:
        begin, end = at[begin], at[end]
    return joined, begin, end, counts


class Coder:
    """Ranks, and a cache of the tokens of pieces that is emptied when it grows past ``most`` pieces."""

    def __init__(self, ranks: dict[bytes, int], most: int = 250_000):
        self.ranks = ranks
        self.most = most
        top = max(ranks.values(), default=-1) + 1
        self.words = [b""] * top
        for word, rank in ranks.items():
            self.words[rank] = word
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        self.reset()

    def reset(self) -> None:
        self.cache = _Cache(self)
        self.pieces = 0
        self.new_ids: list[int] = []
        self.new_sizes: list[int] = []
        self.pool = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(1, dtype=np.int64)

    def pooled(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cached pieces one after another, and where each piece's begin."""
        if self.new_sizes:
            self.pool = np.concatenate((self.pool, np.array(self.new_ids, dtype=np.int32)))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(self.new_sizes)))
            self.new_ids, self.new_sizes = [], []
        return self.pool, self.first

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: the adjacent pair of lowest rank is joined first, of equal ones the leftmost."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n <= 32:
            return self._merge_short(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        stop = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i] or after[i] >= n or stop[after[i]] != end:
                continue
            j = after[i]
            gone[j] = 1
            stop[i], after[i] = end, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(piece[i : stop[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop[after[i]]))
            if (p := before[i]) >= 0 and (r := self.ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : stop[i]]])
            i = after[i]
        return out

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, 1 << 60
        cuts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte offsets of all tokens of all texts, and the number of tokens of each text."""
        joined, begin, end, pieces = slices(texts)
        if self.pieces > self.most:
            self.reset()
        cache = self.cache
        index = np.array([cache[joined[a:b]] for a, b in zip(begin.tolist(), end.tolist())], dtype=np.int64)
        pool, first = self.pooled()
        size = (first[1:] - first[:-1])[index] if len(index) else index
        total = int(size.sum())
        take = np.repeat(first[index] - (np.cumsum(size) - size), size) + np.arange(total)
        ids = pool[take]
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(pieces)))]
        tokens = np.diff(ends)
        # tokens cover their text without a gap
        width = self.lengths[ids]
        offsets = np.cumsum(width) - width
        offsets -= np.repeat(np.append(offsets, 0)[ends[:-1]], tokens)
        return ids, offsets.astype(np.int32), tokens

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        size = self.lengths[ids]
        take = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        data = self.bytes[take].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


class _Cache(dict):
    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, piece: bytes) -> int:
        c = self.coder
        ids = c.merge(piece)
        c.new_ids += ids
        c.new_sizes.append(len(ids))
        c.pieces += 1
        if len(piece) <= 256:
            self[piece] = c.pieces - 1
        return c.pieces - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _coder(name: str) -> Coder:
    """One per Python worker; the vocabulary file comes with the job."""
    if _MADE.get("name") != name:
        _MADE.update(name=name, coder=Coder(read_ranks(SparkFiles.get(name))))
    return _MADE["coder"]


def _ship(df: DataFrame, path: str) -> str:
    small_batches(df.sparkSession)
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` and ``offsets`` (byte in the UTF-8 text at which each token begins)."""
    name = _ship(docs, vocabulary)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(stream):
        coder = _coder(name)
        for batch in batches(stream, most=1 << 20):
            ids, offsets, counts = coder.encode(raw(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(ids, counts), _lists(offsets, counts)], names=["id", "ids", "offsets"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` of each row with ``decoded``, the bytes of its ``ids``."""
    name = _ship(encoded, vocabulary)
    rows = encoded.select(F.struct(*keep).alias("row"), F.col(ids_col).alias("ids"))
    schema = rows.select("row", F.lit(b"").alias("decoded")).schema

    def run(stream):
        coder = _coder(name)
        for batch in stream:
            lists = batch.column("ids")
            counts = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(coder.decode(ids, counts), pa.binary())], names=["row", "decoded"])

    return rows.mapInArrow(run, schema).select("row.*", "decoded")
