"""Line deduplication over a suffix array of line ids, built by distributed prefix doubling.

The lines of all documents, blank ones left out, are sequences of line ids (128-bit hashes of the trimmed lines). A run
of lines is a copy if the same lines stand earlier, in the order of documents and lines; the lines of all copies of
``MIN_WORDS`` words or more go, however many lines it takes to reach them.

Round k ranks the suffixes by their first 2 ** k lines: a suffix whose second half has no rank, or whose pair of ranks
is unique, shares no prefix of that length and leaves; the others get the place of their pair in the sorted order of
pairs. So the suffixes of one rank are an interval of the suffix array with a common prefix of 2 ** k lines at least,
and a run of d lines, 2 ** k <= d < 2 ** (k + 1), is named exactly by the ranks of its first and of its last 2 ** k
lines. Every line of a copy of ``MIN_WORDS`` words lies in one that is no longer than needed at one of its ends, so
only such runs are looked up: at most two for each line, of ``MIN_WORDS`` lines at most, each from its two ranks. Their
union is that of all copies, as maximal repeated runs are unions of them. Rounds go on only for places that a run asks
for, so their number depends on ``MIN_WORDS`` and not on the corpus.

Only line ids and places are moved. Ranks are counted before they are joined back, and are places in a range sort of
distinct pairs, so a line that stands in a third of all documents is one row where it is ranked; where it is joined
back, the join's large side is split.

Defined cases: a null text stays null, an empty one empty; blank lines are never compared and stay, unless all other
lines go, which leaves an empty text. Words are cut at blanks, tabs and the other white space of ASCII. Null or repeated
ids are rows of their own, ordered by id (nulls last) and text, so of repeated rows the first keeps its lines. An empty
table gives no rows. Other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, batches, keyed, ranked, raw

MIN_WORDS = 50
_SPACES = b" \t\r\f\v"


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines and numbers of lines of the runs of ``least`` words that aren't longer than needed at one end."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    # from each line on, and up to each line
    end = np.searchsorted(total, total[:-1] + least)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    on, upto = end <= n, begin >= 0
    first = np.concatenate((np.arange(n)[on], begin[upto]))
    size = np.concatenate((end[on] - first[: on.sum()], np.arange(1, n + 1)[upto] - begin[upto]))
    both = np.unique(first * (n + 1) + size)
    return both // (n + 1), both % (n + 1)


def needs(first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The greatest k for which the rank by 2 ** k lines is asked for at each of ``n`` places; -1 for none."""
    k = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    need = np.full(n, -1)
    np.maximum.at(need, first, k)
    np.maximum.at(need, first + size - (1 << k), k)
    for level in range(int(need.max(initial=0)), 0, -1):
        ahead = np.flatnonzero(need >= level) + (1 << (level - 1))
        np.maximum.at(need, ahead, level - 1)
    return need


def _cut(least: int):
    """Lines that any run asks for: their ids, how deep they are asked for, and the runs that begin there."""

    def run(stream):
        for batch in batches(stream, most=1 << 20):
            keys, places, ids, need, sizes, ends = [], [], [], [], [], [0]
            for key, text in zip(batch.column("key").to_pylist(), raw(batch.column("text"))):
                full = [x for x in (line.strip(_SPACES) for line in text.split(b"\n")) if x]
                first, size = windows(np.array([len(x.split()) for x in full], dtype=np.int64), least)
                if not len(first):
                    continue
                deep = needs(first, size, len(full))
                asked = np.flatnonzero(deep >= 0)
                at = np.searchsorted(first, asked)
                upto = np.searchsorted(first, asked, "right")
                keys += [key] * len(asked)
                places += asked.tolist()
                need += deep[asked].tolist()
                ids += [xxhash.xxh3_128_digest(full[i]) for i in asked.tolist()]
                # runs begin only where something is asked for, so they stand in the order of their first lines
                sizes += size.tolist()
                ends += (ends[-1] + np.cumsum(upto - at)).tolist()
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sizes, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.binary()), pa.array(need, pa.int32()), runs], names=["key", "pos", "line", "need", "runs"])

    return run


def cut_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``key``, ``pos``, ``line`` (id), ``need`` and ``runs`` (numbers of lines) of the lines of ``rows``."""
    return rows.where("text is not null").select("key", "text").mapInArrow(_cut(min_words), "key long, pos int, line binary, need int, runs array<int>")


def suffix_intervals(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each k: ``key``, ``pos``, ``rank``, ``first_key`` and ``first_pos`` of the suffixes asked for by 2 ** k lines.

    Only those that share their first 2 ** k lines with another one. Ranks are dense and sorted; the suffixes of one
    rank are an interval of the suffix array, whose earliest suffix is ``first_*``.
    """

    def named(pairs: DataFrame, by: list[str], tag: str) -> DataFrame:
        groups = pairs.groupBy(*by).agg(F.count("*").alias("size"), F.min(F.struct("key", "pos")).alias("first")).where("size > 1").drop("size")
        dealt = ranked(groups, scratch, by, "deeper")
        groups = scratch.keep(dealt, f"ranks-{tag}")
        scratch.drop(dealt)
        joined = pairs.join(groups, by).select("key", "pos", "need", F.col("deeper").alias("rank"), F.col("first.key").alias("first_key"), F.col("first.pos").alias("first_pos"))
        out = scratch.keep(joined, f"depth-{tag}")
        scratch.drop(groups)
        return out

    levels = [named(lines.select("key", "pos", "need", "line"), ["line"], "1")]
    while True:
        depth = 1 << (len(levels) - 1)
        asked = levels[-1].where(F.col("need") >= len(levels)).select("key", "pos", "need", "rank")
        ahead = levels[-1].select("key", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("rank2"))
        pairs = scratch.keep(asked.join(ahead, ["key", "pos"]), "pairs")
        if not pairs.head(1):
            return levels
        levels.append(named(pairs, ["rank", "rank2"], str(2 * depth)))
        scratch.drop(pairs)


def copies(lines: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``key``, ``pos`` and ``size`` of the runs that ``lines`` ask for and whose lines stand earlier as well."""
    runs = lines.where("size(runs) > 0").select("key", "pos", F.explode("runs").alias("size"))
    runs = runs.withColumn("k", F.floor(F.log2("size")).cast("int"))
    out = None
    for k, level in enumerate(levels):
        mine = runs.where(F.col("k") == k).join(level.drop("need"), ["key", "pos"])
        # of exactly 2 ** k lines: the rank alone names the run
        found = mine.where(f"size = {1 << k} and (key <> first_key or pos <> first_pos)").select("key", "pos", "size")
        if k:
            last = level.select("key", F.col("pos").alias("tail"), F.col("rank").alias("rank2"))
            longer = mine.where(f"size > {1 << k}").withColumn("tail", F.col("pos") + F.col("size") - (1 << k)).join(last, ["key", "tail"])
            longer = scratch.keep(longer.select("key", "pos", "size", "rank", "rank2"), "longer")
            by = ["size", "rank", "rank2"]
            # a run has one first copy, so these are as many rows as runs of different lines
            first = longer.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("first")).where("n > 1").drop("n")
            later = longer.join(first, by).where("key <> first.key or pos <> first.pos").select("key", "pos", "size")
            found = found.union(later)
        out = found if out is None else out.union(found)
    return out


def _rebuilt(place: int):
    """Texts (field ``place`` of ``row``) without the lines that are gone, and the numbers of lines that aren't blank."""

    def run(stream):
        for batch in stream:
            texts, counts = [], []
            for text, gone in zip(batch.column("row").field(place).cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist()):
                lines = text.split(b"\n") if text is not None else []
                full = [i for i, x in enumerate(lines) if x.strip(_SPACES)]
                counts.append(len(full))
                if gone:
                    drop = {full[p] for p in gone}
                    text = b"" if len(drop) == len(full) else b"\n".join([x for i, x in enumerate(lines) if i not in drop])
                texts.append(text)
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), kept, pa.array(counts, pa.int32()), batch.column("gone")], names=["row", "kept_text", "n_lines", "gone"])

    return run


def marked(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns), ``kept_text``, ``n_lines``, ``gone`` (places among non-blank lines)."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows, _ = keyed(docs, scratch, id_col, text_col, with_row=True)
    lines = scratch.keep(cut_lines(rows, min_words), "lines")
    levels = suffix_intervals(lines, scratch)
    # the runs of one document, as many as twice its lines at most
    covered = F.flatten(F.transform(F.collect_list(F.struct("pos", "size")), lambda r: F.sequence(r["pos"], r["pos"] + r["size"] - 1)))
    found = scratch.keep(copies(lines, levels, scratch).groupBy("key").agg(F.array_sort(F.array_distinct(covered)).alias("gone")), "gone")
    scratch.drop(lines, *levels)
    # by hint alike at every size, so that what is measured on small tables holds for large ones
    out = rows.select("key", "row").join(found.hint("merge"), "key", "left").select("row", F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"))
    schema = out.select("row", F.lit(None).cast("string").alias("kept_text"), F.lit(0).alias("n_lines"), "gone").schema
    return out.mapInArrow(_rebuilt(docs.columns.index(text_col)), schema)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of later copies; documents that lose all their lines go."""
    out = marked(docs, min_words, id_col, text_col).where("size(gone) = 0 or kept_text <> ''")
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_lines``, ``n_removed``, ``n_runs`` (maximal runs removed) and the ``kept_text``."""
    out = marked(docs, min_words, id_col, text_col)
    runs = F.expr("size(filter(gone, (p, i) -> i = 0 or gone[i - 1] <> p - 1))")
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"), "kept_text")
