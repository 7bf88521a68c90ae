"""Evaluation texts leaking into training text (problem 8).

Size-partitioned MinHash containment search. An item's passage is cut into shingles (five
words; five characters in Han script) and represented by a bottom-k MinHash sketch. Items are
partitioned by their number of shingles n; the bounds of the partitions grow by a fifth, and
k is the lower bound of the partition, so a sketch always holds fewer values than the item
has, and at least four fifths of them. Containment of a sketch in a document is estimated by
looking its values up among the document's shingles, so the document's length does not
dilute it. The share kept must be this high because a leak may be as short as 20 words with
three changed, which leaves as little as one shingle of the item; longer passages leave more.

The documents are read once, whatever the number of items: a bit table of all sketch values,
sized to them and bounded by MAX_BITS, goes to every task and drops nearly all shingles, and
one of the items' word pairs drops those whose surroundings cannot be a leak; what passes
leaves the task as stretches, word numbers of the text around the hits. Stretches and
sketches are joined by value in Spark, so neither the items nor their sketches are held whole
anywhere. What they hit is verified exactly along the common diagonal of stretch and item:
20 consecutive words of the item with at most three changed (40 and 6 characters), the first
and the last of them unchanged, so that a shorter quotation is not filled up by its
neighbours. A redaction counts as one changed word.

Defined results: null and empty texts or passages hold and leak nothing; passages shorter
than the window leak nothing; an item is reported once per document however often it
occurs; items of equal text are each reported, and so are rows of equal id once; extra columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut

#: Documented parameters: shingle length, window and changes allowed for words and for characters, growth of the size partitions, largest bit table (bits, a power of two), bits per value in it.
SHINGLE = 5
WORDS, CHARS = (20, 3), (40, 6)
GROWTH = 1.2
MAX_BITS, BITS_PER_VALUE = 1 << 30, 32

_HYPHEN = re.compile(r"(?<=\w)[-­‐]\s*\n\s*(?=\w)")
_BLOCKS = re.compile(r"\n[ \t\r]*\n\s*")
# page headers: a short line that carries a page number and no sentence
_HEADER = re.compile(r"\s*(?:page \d+|\d+ / \d+ \w \d+/\d+|\d+ \w \d+/\d+ — p\. \d+|\[\d+\] \w+ .{0,40}, p\. \d+ of \d+|[-–—]?\s*\d+\s*[-–—]?)\s*", re.I)
_NUMBER = re.compile(r"\s*(?:\[\d+\]|\(\d+\)|¶\s*\d+|Rn\.\s*\d+|\d+\.)(?=\s)", re.I)
# a redaction stands for the words it hides, as one changed word
_REDACTED = re.compile(r"█+|\[(?:redacted|name withheld|…)\]|(?<!\w)[A-Z]…")
_PUNCT = re.compile(r"[^\w\s]|_")
_HAN = re.compile(r"[㐀-䶿一-鿿]")


def plain(text: str) -> str:
    """Text without what counts as no change: case, accents, punctuation, line ends, word breaks, page headers, paragraph numbers."""
    t = _HYPHEN.sub("", text)
    kept = []
    for b in _BLOCKS.split(t):
        if len(b) < 90 and _HEADER.fullmatch(b):
            continue
        m = _NUMBER.match(b)
        kept.append(b[m.end() :] if m else b)
    t = "\n".join(kept)
    if "█" in t or "…" in t or "redacted]" in t or "withheld]" in t:
        t = _REDACTED.sub("ꙮ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)  # the marks go with the punctuation
    return _PUNCT.sub("", t.casefold())


def units_of(text: str, chars: bool) -> list[str]:
    t = plain(text)
    return list("".join(t.split())) if chars else t.split()


def mix(x: np.ndarray) -> np.ndarray:
    """The MinHash order: a 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """Words to 64-bit numbers, the same in every task; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return n


_numbers = Numbers()


def numbers(units: list[str]) -> np.ndarray:
    return np.fromiter(map(_numbers.__getitem__, units), np.uint64, len(units))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(x: np.ndarray, chars: bool, size: int = SHINGLE) -> np.ndarray:
    """Hash of the five (or so many) units from each position on; words and characters never share a value."""
    n = max(0, len(x) - size + 1)
    h = np.full(n, 1 if chars else 0, np.uint64)
    for k in range(size):
        h *= _BASE
        h += x[k : k + n]
    return mix(h)


def sketch_size(n: int) -> int:
    """k of an item with n shingles: the lower bound of its size partition, below n."""
    low = 1
    while (up := max(low + 1, int(low * GROWTH))) < n:
        low = up
    return low


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, chars, units array of the passage's numbers, k, hashes, places, pairs): one row per passage long enough to leak; pairs are hashes of two units."""
    kind = dict(items.dtypes)["item_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, passage in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                chars = bool(_HAN.search(passage))
                x = numbers(units_of(passage, chars))
                if len(x) < (CHARS if chars else WORDS)[0]:
                    continue
                h = shingles(x, chars)
                value, place = np.unique(h, return_index=True)  # a repeated shingle is one value, found at each of its places below
                kept = value[: sketch_size(len(value))]  # bottom k: values ascend in the MinHash order
                at = np.flatnonzero(np.isin(h, kept))
                rows.append((key, chars, x.astype(np.int64), len(kept), h[at].astype(np.int64), at.astype(np.int32), shingles(x, chars, 2).astype(np.int64)))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [b.schema.field(0).type, pa.bool_(), longs, pa.int32(), longs, pa.list_(pa.int32()), longs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item_id", "chars", "units", "k", "hashes", "places", "pairs"])

    longs = pa.list_(pa.int64())
    return items.filter("passage is not null").select("item_id", "passage").mapInArrow(work, f"item_id {kind}, chars boolean, units array<bigint>, k int, hashes array<bigint>, places array<int>, pairs array<bigint>")


class BitTable:
    """One bit per value, by its leading bits; a value it lacks was never put in. Sized to the values, up to MAX_BITS."""

    def __init__(self, values: DataFrame):
        """values: a column ``hash``. The words of the table are put together by Spark; at most one per 64 bits comes back."""
        n = values.count()
        self.log = min(MAX_BITS, max(1 << 16, 1 << (n * BITS_PER_VALUE).bit_length())).bit_length() - 1
        at = values.select(F.shiftrightunsigned("hash", 64 - self.log).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b")).toArrow()
        table = np.zeros((1 << self.log) // 64, np.uint64)
        table[np.asarray(words.column(0))] = np.asarray(words.column(1)).astype(np.int64).view(np.uint64)
        self.bytes = table.view(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.log)
        return (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def promising(x: np.ndarray, hits: np.ndarray, chars: bool, pairs: BitTable) -> np.ndarray:
    """The hits that lie in a window with enough pairs known to some item: a changed unit breaks two pairs, so no leak is lost."""
    window, changes = CHARS if chars else WORDS
    if len(x) < window:
        return hits[:0]
    total = np.concatenate([[0], np.cumsum(pairs.has(shingles(x, chars, 2)), dtype=np.int64)])
    good = total[window - 1 :] - total[: len(total) - window + 1] >= window - 1 - 2 * changes
    before = np.concatenate([[0], np.cumsum(good)])  # windows that start at a place from hit - reach to hit
    return hits[before[np.minimum(hits + 1, len(good))] > before[np.clip(hits - (window - SHINGLE), 0, len(good))]]


def stretches(documents: DataFrame, values: BitTable, pairs: BitTable) -> DataFrame:
    """(doc_id, chars, units, hashes, places): the parts of every document around promising sketch values; hits closer than two windows share a stretch."""
    kind = dict(documents.dtypes)["doc_id"]
    held = documents.sparkSession.sparkContext.broadcast((values, pairs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, pairs = held.value

        def cut_out(key, text: str, chars: bool) -> Iterator[tuple]:
            x = numbers(units_of(text, chars))
            h = shingles(x, chars)
            hits = np.flatnonzero(values.has(h))
            if len(hits):
                hits = promising(x, hits, chars, pairs)
            if not len(hits):
                return
            reach = (CHARS if chars else WORDS)[0] - SHINGLE
            for run in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach + SHINGLE) + 1):
                lo, hi = max(0, run[0] - reach), min(len(x), run[-1] + SHINGLE + reach)
                yield key, chars, x[lo:hi].astype(np.int64), h[run].astype(np.int64), (run - lo).astype(np.int32)

        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.extend(cut_out(key, text, False))
                if _HAN.search(text):
                    rows.extend(cut_out(key, text, True))
            if rows:
                kinds = [b.schema.field(0).type, pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "chars", "units", "hashes", "places"])

    return documents.filter("text is not null").select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, chars boolean, units array<bigint>, hashes array<bigint>, places array<int>")


def leaks_along(x: np.ndarray, t: np.ndarray, diagonal: int, chars: bool) -> bool:
    """Whether stretch x, shifted by the diagonal against item t, holds a window of the item with few enough changes."""
    window, changes = CHARS if chars else WORDS
    lo, hi = max(0, diagonal), min(len(x), len(t) + diagonal)
    if hi - lo < window:
        return False
    same = x[lo:hi] == t[lo - diagonal : hi - diagonal]
    total = np.concatenate([[0], np.cumsum(same)])
    return bool(((total[window:] - total[:-window] >= window - changes) & same[: len(same) - window + 1] & same[window - 1 :]).any())


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment): every document that holds a passage, wholly or in part, and the item it leaks; containment is the share of the item's sketch found there."""
    s = cut(sketches(items).withColumn("item", F.monotonically_increasing_id()))  # ids of items need not be unique
    values = s.select("item", "chars", F.explode(F.arrays_zip("hashes", "places")).alias("e")).select("item", F.col("e.hashes").alias("hash"), F.col("e.places").alias("q"))
    known = BitTable(values), BitTable(s.select(F.explode("pairs").alias("hash")))
    d = cut(stretches(documents, *known).withColumn("stretch", F.monotonically_increasing_id()))
    hits = d.select("stretch", F.explode(F.arrays_zip("hashes", "places")).alias("e")).select("stretch", F.col("e.hashes").alias("hash"), F.col("e.places").alias("p"))
    found = hits.join(values, "hash").groupBy("stretch", "item", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.count_distinct("hash").alias("n"))
    kinds = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    pairs = found.join(d.select("stretch", "doc_id", "chars", "units"), "stretch").join(s.select("item", "item_id", "k", F.col("units").alias("t")), "item").select("doc_id", "item", "item_id", "chars", "diagonal", "n", "k", "units", "t")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, diagonal = (b.column(i).to_pylist() for i in (3, 4))
            x, t = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(7), b.column(8)))
            good = [leaks_along(x[1][x[0][i] : x[0][i + 1]], t[1][t[0][i] : t[0][i + 1]], diagonal[i], chars[i]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(b.columns[:7], b.schema.names[:7]).filter(pa.array(good, pa.bool_()))

    good = pairs.mapInArrow(check, f"doc_id {kinds[0]}, item bigint, item_id {kinds[1]}, chars boolean, diagonal int, n bigint, k int")
    per = good.groupBy("doc_id", "item", "item_id").agg(F.least(F.lit(1.0), F.sum("n") / F.max("k")).alias("containment"))
    return per.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
