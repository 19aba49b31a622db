"""Token ids in a content-addressed store.

Each document's ids, ended by ``END``, are cut where a rolling hash of the last ``WINDOW`` ids hits a pattern, so equal
passages are cut alike wherever they stand. A chunk is named by the digest of its ids and stored once; a document's
recipe lists the digests of its chunks. Files under the store's folder, all written by Spark's writers:

    chunks/    digest, n, payload (ids of ``width`` bytes each, little-endian, as one zstd frame)
    recipes/   part, at (place in its part), key, id, n_tokens, local (ids before it in its part), digests; parts in
               ascending key order
    manifest/  part, n_docs, n_tokens, start, width, root; the root of each part's Merkle tree, and part -1 with the whole's

The Merkle trees have ``FAN`` children a node, so a level is one grouping of narrow rows and no task holds a part.
Reading joins recipes with chunks, checks every chunk against its digest, every document against its length, the
parts and the number of documents against the manifest, and fails on any difference or missing chunk. Only digests and
payloads of distinct chunks are shuffled.

Defined cases: a null or empty text is stored as ``END`` alone. Null or repeated ids are documents of their own, ordered
by id (nulls last) and text. An empty table makes an empty store. Other columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Scratch, batches, keyed, partitions_for, raw
from .words import GAP, LOWER, mix, powers, span_hashes

END = 2
WINDOW = 16
CUT_BITS = 9
LEAST, MOST = 64, 4096
DIGEST = 16
SEEN = 200_000
#: Children of a node of the Merkle trees.
FAN = 1024
#: Words joined to one text for the library.
JOINED = 256
#: Bytes of text whose words are looked up at once.
LOOKED_UP = 1 << 18
_BASE = 0x9E3779B97F4A7C55
#: What the vocabulary must do to a text before merging for words to be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words:
    """Ids of texts by the tokenizers library, through a table of white-space separated words.

    The vocabulary drops white space and no token crosses it, so a text's ids are those of its words; words are cut at
    ASCII white space and between a letter or digit and a sign, any other stays within its word and is left to the
    library. The exact text of an added token is cut out first and becomes the token's id, as the library does. Texts
    are brought to lower case where that changes no id, so that fewer words differ. Of the words not met yet, those
    that need no normalising (Latin-1 letters, digits and signs but the apostrophe) are cut into pieces here and merged
    by the library's model, many at a time; a piece ends with the token that holds the vocabulary's mark of a word's
    end. All others go through the whole library. A vocabulary that prepares texts in another way is given whole texts.

    Words are found by hash and then compared byte by byte; a word whose hash another one has is encoded anew. A table
    of more than ``most`` words is begun anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.by_word = self._as_assumed(spec)
        if not self.by_word:
            return
        # no word holds an added token's text but by lower case, and then it is a word like any other
        self.tokenizer.encode_special_tokens = True
        added = sorted({t["content"].encode(): t["id"] for t in spec["added_tokens"]}.items(), key=lambda x: -len(x[0]))
        self.added = [name for name, _ in added]
        self.find_added = re.compile(b"|".join(map(re.escape, self.added)))
        # bytes that no UTF-8 text holds stand for the end of a text and for added tokens
        self.marks = {name: b" \xfe%d " % i for i, name in enumerate(self.added)}
        self.stop = int(np.iinfo(self.kind).max)
        self.fixed = {b"\xff": self.stop} | {self.marks[name].strip(): i for name, i in added}
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.letters = str.maketrans({b: c for b, c in _byte_letters().items() if b != 32})
        self._begin()

    def _begin(self) -> None:
        """A table of the marks alone."""
        self.keys, self.first, self.size = _Grown(np.uint64), _Grown(np.int64), _Grown(np.int32)
        self.id_first, self.id_size = _Grown(np.int64), _Grown(np.int32)
        self.bytes, self.ids = _Grown(np.uint8), _Grown(self.kind)
        self.slots = np.full(1 << 12, -1, dtype=np.int32)
        chars, size = np.frombuffer(b"".join(self.fixed), np.uint8), np.array(list(map(len, self.fixed)))
        end, ids = np.cumsum(size), np.array(list(self.fixed.values()), dtype=self.kind)
        self._put(span_hashes(chars, end - size, end), chars, size, ids, np.arange(len(ids)), np.ones(len(ids), np.int64))

    @staticmethod
    def _as_assumed(spec: dict) -> bool:
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        model = spec["model"]
        return (
            (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and len(steps) == 2
            and steps[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
            and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
            and model["type"] == "BPE"
            and bool(model["end_of_word_suffix"])
            and model["dropout"] is None
            and bool(spec["added_tokens"])
            and all(t["special"] and t["content"].isascii() and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        )

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each ended by ``END``, and their numbers."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_word:
            lists = [e.ids + [END] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for x in lists for i in x], dtype=np.uint32), np.array([len(x) for x in lists], dtype=np.int64)
        joined = b" \xff\n".join(texts) + b" \xff"
        if any(name in joined for name in self.added):
            joined = self.find_added.sub(lambda m: self.marks[m[0]], joined)
        x = _apart(joined)
        # a capital and a combining mark may have a composed form in lower case only; all such marks begin so
        if b"\xcc" not in joined and b"\xcd" not in joined:
            x = _lower(x)
        full = ~GAP[x]
        edge = np.flatnonzero(np.diff(full, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        steps = np.unique(np.concatenate(([0], np.searchsorted(begin, np.arange(LOOKED_UP, len(x), LOOKED_UP)), [len(begin)])))
        ids = np.concatenate([self._of(x[begin[a] : end[b - 1]], begin[a:b] - begin[a], end[a:b] - begin[a]) for a, b in zip(steps[:-1], steps[1:])])
        stops = np.flatnonzero(ids == self.stop)
        ids = ids.astype(np.uint32)
        ids[stops] = END
        return ids, np.diff(stops, prepend=-1)

    def _of(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ids of the words that stand at these places of a text."""
        if self.first.n > self.most:
            self._begin()
        # of a long word only a part is hashed
        hashes = span_hashes(x[: 2 * LOOKED_UP], begin, np.minimum(end, begin + LOOKED_UP))
        size, word = end - begin, x[~GAP[x]]
        at = np.cumsum(size) - size
        index = self._find(hashes)
        new = np.flatnonzero(index < 0)
        if len(new):
            key, one, of = np.unique(hashes[new], return_index=True, return_inverse=True)
            index[new] = of + self._learn(key, word, at[new[one]], size[new[one]])
        differ = self.size[index] != size
        if differ.any():
            same = np.flatnonzero(~differ)
            unlike = self.bytes[_spans(self.first[index[same]], size[same])] != word[_spans(at[same], size[same])]
            differ[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(unlike), "right")]] = True
        else:
            unlike = self.bytes[_spans(self.first[index], size)] != word
            differ[np.searchsorted(at, np.flatnonzero(unlike), "right") - 1] = True
        others: dict[bytes, int] = {}
        for i in np.flatnonzero(differ).tolist():
            name = word[at[i] : at[i] + size[i]].tobytes()
            if name not in others:
                others[name] = self._learn(None, word, at[i : i + 1], size[i : i + 1])
            index[i] = others[name]
        return self.ids[_spans(self.id_first[index], self.id_size[index])]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the table by their hashes, -1 for those that aren't there."""
        mask = len(self.slots) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        out = self.slots[slot].astype(np.int64)
        left = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        while len(left):
            slot[left] = slot[left] + 1 & mask
            out[left] = self.slots[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != hashes[left])]
        return out

    def _put(self, keys: np.ndarray | None, word: np.ndarray, size: np.ndarray, ids: np.ndarray, id_first: np.ndarray, id_size: np.ndarray) -> int:
        """Adds words with distinct keys that aren't there, or, without keys, words that won't be found; the place of
        the first."""
        n = self.first.n
        self.first.add(np.cumsum(size) - size + self.bytes.n)
        self.id_first.add(id_first + self.ids.n)
        for column, x in ((self.keys, np.zeros(len(size), np.uint64) if keys is None else keys), (self.size, size), (self.id_size, id_size), (self.bytes, word), (self.ids, ids)):
            column.add(x)
        if keys is None:
            return n
        places = np.arange(n, n + len(size))
        if 3 * self.first.n > len(self.slots):
            self.slots = np.full(1 << (3 * self.first.n).bit_length(), -1, dtype=np.int32)
            places = np.flatnonzero(self.keys[: self.first.n])
        mask = len(self.slots) - 1
        slot = (self.keys[places] & np.uint64(mask)).astype(np.int64)
        while len(places):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = places[free]
            left = self.slots[slot] != places
            places, slot = places[left], slot[left] + 1 & mask
        return n

    def _learn(self, keys: np.ndarray | None, word: np.ndarray, at: np.ndarray, size: np.ndarray) -> int:
        """Encodes words that stand at these places and puts them into the table."""
        word = word[_spans(at, size)]
        easy = _EASY[word]
        # what follows a lead byte 0xC3 is a letter but for two signs
        easy[1:] |= (word[:-1] == 0xC3) & (word[1:] != 0x97) & (word[1:] != 0xB7)
        first = np.cumsum(size) - size
        easy = np.add.reduceat(~easy, first, dtype=np.int64) == 0
        counts = np.zeros(len(size), dtype=np.int64)
        ids, counts[easy] = self._merged(_lower(word[np.repeat(easy, size)]), size[easy])
        hard = np.flatnonzero(~easy)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([word[a:b].tobytes().decode() for a, b in zip(first[hard], first[hard] + size[hard])], add_special_tokens=False)] if len(hard) else []
        counts[hard] = [len(e) for e in found]
        id_first = np.zeros(len(size), dtype=np.int64)
        order = np.concatenate((np.flatnonzero(easy), hard))
        id_first[order] = np.cumsum(counts[order]) - counts[order]
        ids = np.concatenate((ids, np.array([i for e in found for i in e], dtype=self.kind)))
        return self._put(keys, word, size, ids, id_first, counts)

    def _merged(self, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of letters, digits and signs, and their numbers."""
        if not len(size):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        kind, first = _KIND[word], np.cumsum(size) - size
        # a digit is a piece of its own
        piece = np.diff(kind, prepend=0) != 0
        piece |= kind == _DIGIT
        piece[first] = True
        before = np.cumsum(piece)
        text = np.full(len(word) + int(before[-1]), 32, dtype=np.uint8)
        text[np.arange(len(word)) + before] = word
        cut = [*(first + before[first] - 1)[::JOINED].tolist(), len(text)]
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            some = text[a:b].tobytes().decode("latin-1")
            if not some.isascii():
                some = some.translate(self.letters)
            out.append(np.array(self.model.encode_batch_fast([some], add_special_tokens=False)[0].ids, dtype=self.kind))
        ids = np.concatenate(out)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != before[-1] or ends[-1] != len(ids):
            raise ValueError("pieces and their last tokens differ in number")
        return ids, np.diff(ends[before[first + size - 1] - 1], prepend=0)


class _Grown:
    """An array that more can be added to."""

    def __init__(self, kind: np.dtype):
        self.data, self.n = np.zeros(1 << 10, dtype=kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            data = np.zeros(max(2 * len(self.data), self.n + len(x)), dtype=self.data.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)

    def __getitem__(self, places):
        return self.data[places]


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, one span after another."""
    stops = np.cumsum(size)
    return np.repeat(first - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)


def _apart(joined: bytes) -> np.ndarray:
    """The bytes with a blank before each sign after an ASCII or a common letter, or a digit: no token holds both."""
    x = np.frombuffer(joined, np.uint8)
    sign = np.flatnonzero(_KIND[x] == _SIGN)
    sign = sign[sign > 1]
    before, lead = x[sign - 1], x[sign - 2]
    # after the lead byte 0xC3 come the letters from 0xA0 on, but for one sign
    letter = _ALNUM[before] | ((lead == 0xC3) & (before >= 0xA0) & (before != 0xB7))
    sign = sign[letter]
    out = np.full(len(x) + len(sign), 32, dtype=np.uint8)
    place = np.ones(len(out), dtype=bool)
    place[sign + np.arange(len(sign))] = False
    out[place] = x
    return out


def _lower(x: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of Latin-1 brought to lower case."""
    out = LOWER[x]
    after = np.flatnonzero(x[:-1] == 0xC3) + 1
    letter = x[after]
    out[after[(letter <= 0x9E) & (letter != 0x97)]] += 32
    return out


_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_DIGIT, _SIGN = 2, 3
#: White space and control characters, letters (any other byte of UTF-8 than ASCII, too), digits, signs.
_KIND = np.array([1 if i >= 128 or chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _SIGN if 32 < i < 127 else 0 for i in range(256)], dtype=np.int8)
#: ASCII bytes of words that normalising only brings to lower case and whose pieces are found by kind alone; 0xC3 leads such letters.
_EASY = np.array([32 < i < 127 and i != 39 or i == 0xC3 for i in range(256)])


def cuts(ids: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Ends of the chunks of id streams that stand one after another, and the number of chunks of each stream."""
    n = len(ids)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64)) * powers(_BASE, n))))
        rolling = mix((total[WINDOW:] - total[:-WINDOW]) * powers(pow(_BASE, -1, 1 << 64), n + 1)[: max(n + 1 - WINDOW, 0)])
    found = np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    stops = np.cumsum(counts)
    upto = np.searchsorted(found, stops).tolist()
    found, ends, chunks, first = found.tolist(), [], [], 0
    for stop, size, k in zip(stops.tolist(), counts.tolist(), upto):
        before, last = len(ends), stop - size
        # a window that reaches into the stream before ends within LEAST ids and cuts nothing
        for end in found[first:k] + [stop]:
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST or end == stop and end > last:
                ends.append(end)
                last = end
        first = k
        chunks.append(len(ends) - before)
    return ends, np.array(chunks, dtype=np.int64)


_MADE: dict = {}


def _words(name: str) -> Words:
    """One per Python worker; the vocabulary file comes with the job."""
    if _MADE.get("name") != name:
        _MADE.update(name=name, words=Words(SparkFiles.get(name)))
    return _MADE["words"]


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


CHUNK = pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the store to the folder ``path``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "store")
    rows, _ = keyed(docs, scratch, id_col, text_col)
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    kind = dict(rows.dtypes)["id"]

    def cut(stream):
        words = _words(name)
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        seen: set[bytes] = set()
        for batch in batches(stream, most=1 << 20):
            ids, counts = words.encode(raw(batch.column("text")))
            ends, chunks = cuts(ids, counts)
            wide, narrow = ids.astype("<u4").tobytes(), ids.astype(words.kind).tobytes()
            width, marks, new, fresh, last = words.kind.itemsize, [], [], [], 0
            for end in ends:
                mark = digest(wide[4 * last : 4 * end])
                marks.append(mark)
                fresh.append(mark not in seen)
                if fresh[-1]:
                    seen.add(mark)
                    new.append({"digest": mark, "n": end - last, "payload": pack(narrow[width * last : width * end])})
                last = end
            if len(seen) > SEEN:  # repeats then come once more and are dropped by digest below
                seen.clear()
            owner = np.repeat(np.arange(len(counts)), chunks)
            fresh_of = np.bincount(owner[np.array(fresh, dtype=bool)], minlength=len(counts))
            columns = [batch.column("key"), batch.column("id"), pa.array(counts), _lists(pa.array(marks, pa.binary()), chunks), _lists(pa.array(new, CHUNK), fresh_of)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n_tokens", "digests", "chunks"])

    schema = f"key long, id {kind}, n_tokens long, digests array<binary>, chunks array<struct<digest:binary,n:int,payload:binary>>"
    encoded = scratch.keep(rows.select("key", "id", "text").mapInArrow(cut, schema), "encoded")
    single = encoded.select(F.explode("chunks").alias("c")).select("c.*").groupBy("digest").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))
    single.write.parquet(f"{path}/chunks")

    def number(stream):
        part, at, before = TaskContext.get().partitionId(), 0, 0
        for batch in stream:
            counts = batch.column("n_tokens").to_numpy()
            local = before + np.cumsum(counts) - counts
            columns = [pa.array(np.full(len(counts), part), pa.int32()), pa.array(np.arange(at, at + len(counts))), *[batch.column(c) for c in ("key", "id", "n_tokens")], pa.array(local), batch.column("digests")]
            at, before = at + len(counts), before + int(counts.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "key", "id", "n_tokens", "local", "digests"])

    ordered = encoded.select("key", "id", "n_tokens", "digests").repartitionByRange(partitions_for(spark), "key").sortWithinPartitions("key")
    ordered.mapInArrow(number, f"part int, at long, key long, id {kind}, n_tokens long, local long, digests array<binary>").write.parquet(f"{path}/recipes")
    scratch.drop(encoded)
    start, out = 0, []
    width = Words(vocabulary).kind.itemsize
    for part, n_docs, n_tokens, root in _roots(spark, path):
        out.append((part, n_docs, n_tokens, start, width, root))
        start += n_tokens
    out.append((-1, sum(x[1] for x in out), start, 0, width, _root_of([x[5] for x in out])))
    spark.createDataFrame(out, "part int, n_docs long, n_tokens long, start long, width int, root string").coalesce(1).write.parquet(f"{path}/manifest")


def leaf(n_tokens: Column, digests: Column) -> Column:
    """Hash of a recipe."""
    return F.sha2(F.concat_ws(" ", F.lit("leaf"), n_tokens.cast("string"), F.transform(digests, F.hex)).cast("binary"), 256)


def _root_of(roots: list[str]) -> str:
    return hashlib.sha256(" ".join(["node", *roots]).encode()).hexdigest()


def _roots(spark: SparkSession, path: str) -> list[tuple]:
    """(part, documents, ids, Merkle root) of each part of the recipes, in order; one row a part."""
    recipes = spark.read.parquet(f"{path}/recipes")
    level = recipes.select("part", "at", F.lit(1).cast("long").alias("n_docs"), "n_tokens", leaf(F.col("n_tokens"), F.col("digests")).alias("hash"))
    most = (recipes.agg(F.max("at")).first()[0] or 0) + 1
    while True:
        children = F.array_sort(F.collect_list(F.struct("at", "hash")))
        node = F.sha2(F.concat_ws(" ", F.lit("node"), F.transform(children, lambda x: x["hash"])).cast("binary"), 256)
        level = level.groupBy("part", F.expr(f"at div {FAN}").alias("at")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), node.alias("hash"))
        most = -(-most // FAN)
        if most <= 1:
            return sorted(tuple(r) for r in level.select("part", "n_docs", "n_tokens", "hash").collect())


def verify(spark: SparkSession, path: str) -> dict:
    """Compare the recipes with the Merkle manifest, and return the row of the whole."""
    told = {r["part"]: r.asDict() for r in spark.read.parquet(f"{path}/manifest").collect()}
    found = _roots(spark, path)
    if found != [(p, x["n_docs"], x["n_tokens"], x["root"]) for p, x in sorted(told.items()) if p >= 0]:
        raise ValueError("the recipes differ from the manifest")
    if _root_of([x[3] for x in found]) != told[-1]["root"] or sum(x[1] for x in found) != told[-1]["n_docs"]:
        raise ValueError("the parts differ from the manifest's root")
    return told[-1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (unsigned 32-bit, little-endian)."""
    width = verify(spark, path)["width"]
    recipes = spark.read.parquet(f"{path}/recipes")
    starts = spark.read.parquet(f"{path}/manifest").where("part >= 0").select("part", F.col("start").alias("before"))
    # the manifest has one row for each part
    heads = recipes.join(F.broadcast(starts), "part", "left").select("key", "id", (F.col("before") + F.col("local")).alias("start"), "n_tokens")
    wanted = recipes.select("key", F.posexplode("digests").alias("at", "digest"))
    # left joins: a chunk that is missing is seen below, not dropped with its document
    pieces = wanted.join(spark.read.parquet(f"{path}/chunks"), "digest", "left").groupBy("key").agg(F.collect_list(F.struct("at", "digest", "payload")).alias("pieces"))
    kind = dict(recipes.dtypes)["id"]
    whole = heads.join(pieces, "key", "left")

    def join(stream):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in stream:
            out = []
            for n, pieces in zip(batch.column("n_tokens").to_pylist(), batch.column("pieces").to_pylist()):
                parts = []
                for piece in sorted(pieces or [], key=lambda x: x["at"]):
                    if piece["payload"] is None:
                        raise ValueError("a chunk is missing")
                    data = np.frombuffer(unpack(piece["payload"]), f"<u{width}").astype("<u4").tobytes()
                    if digest(data) != piece["digest"]:
                        raise ValueError("a chunk differs from its digest")
                    parts.append(data)
                out.append(b"".join(parts))
                if len(out[-1]) != 4 * n:
                    raise ValueError("a document differs from its length")
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "start", "n_tokens")] + [pa.array(out, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return whole.select("id", "start", "n_tokens", "pieces").mapInArrow(join, f"id {kind}, start long, n_tokens long, ids binary")
