"""Evaluation texts leaking into training text: a prefix-filtered set join over word shingles.

A document and an item share a passage if ``window`` words in a row are equal (words as they read). Every such window is
``window - shingle + 1`` shingles of five words, and a document that holds the window holds all of them in a row; so its rarest
shingle is a necessary prefix. Words go by 64-bit digests, shingles by a rolling hash over these.

The corpus is read and its words are numbered once, whatever the number of items. A map of ``2 ** MAP_BITS`` bits, of the same size
for any query set, tells the places where a shingle of some item may stand; what remains of a document are the runs of such places
that are long enough for a window. From these the frequency of every shingle is counted; each item window is filed under its rarest
shingle; documents meet windows on that shingle only; the place of the shingle bounds where the window lies in the run; and the words
of the window are compared one by one. The map may let places through that hold no item's shingle: that costs time and changes nothing.

The items are the stated query set: a table, of which the driver sees the map alone. A shingle that many runs hold is split by
its measured number of places, and the windows filed under it are copied to as many parts.

Cases: null and empty texts and items shorter than a window give no row. A window within an item that occurs twice, and items
that share a window, all count. Repeated rows of either side count once. Words broken at a line end are read
both ways on either side, each break by itself; of more than six breaks within one window not every choice is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triscope.llm.words import readings
from triscope.sources.scratch import written

WINDOW = 12
SHINGLE = 5
#: Bits of the map of shingles, as a power of two: 16 MB.
MAP_BITS = 27
#: Places of a shingle that meet windows in one part.
PART_PLACES = 100_000
#: Words that are numbered at once.
PORTION = 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Word -> 64-bit digest; filled as words come up."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return v


def shingles_of(words: np.ndarray, shingle: int) -> np.ndarray:
    """The hash of each run of ``shingle`` words."""
    n = max(0, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for j in range(shingle):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + words[j : j + n]
    return out


def _slots(shingles: np.ndarray) -> np.ndarray:
    return ((shingles * _FACTOR) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, window_no, window (digests of words), tokens (its shingles) of each window of the items, in all readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            for item, text in zip(b.column(0), b.column(1).to_pylist()):
                known: set[bytes] = set()  # windows of further readings are numbered on, those that are known by now left out
                first = 0
                for read in readings(text, window):
                    w = np.array([numbers[x] for x in read], np.uint64)
                    n = len(w) - window + 1
                    if n <= 0:
                        continue
                    s, raw = shingles_of(w, shingle), [w[k : k + window].tobytes() for k in range(n)]
                    keep = [k for k in range(n) if raw[k] not in known]
                    known.update(raw)
                    if keep:
                        at, m = np.array(keep), window - shingle + 1
                        sizes = np.full(len(at), window), np.full(len(at), m)
                        own = pa.array([item.as_py()] * len(at), b.schema.field(0).type)
                        yield pa.RecordBatch.from_arrays([own, pa.array(at + first, pa.int32()), _lists(w[_spans(at, sizes[0])], sizes[0]), _lists(s[_spans(at, sizes[1])], sizes[1])], ["item_id", "window_no", "window", "tokens"])
                    first += n

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").where("text is not null").distinct().mapInArrow(run, f"item_id {kind}, window_no int, window array<bigint>, tokens array<bigint>")


def shingle_map(windows: DataFrame) -> np.ndarray:
    """The map of the windows' shingles; what comes to the driver of each task are the slots of a batch, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = np.unique(_slots(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([slots.tobytes()], pa.binary())], ["slots"])

    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in windows.select("tokens").mapInArrow(run, "slots binary").toLocalIterator():
        slots = np.frombuffer(r[0], np.uint32)
        np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return bits


def runs(documents: DataFrame, bits: np.ndarray, window: int, shingle: int) -> DataFrame:
    """doc_id, words, tokens of each run of places of the map that can hold a window."""
    sent = documents.sparkSession.sparkContext.broadcast(bits)
    need = window - shingle + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, numbers = sent.value, Numbers()

        def found(kind: pa.DataType) -> pa.RecordBatch:
            w, lengths = np.array(held, np.uint64), np.array(sizes)
            s = shingles_of(w, shingle)
            slots = _slots(s)
            hit = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
            ends = np.cumsum(lengths)
            for j in range(1, shingle):  # no shingle goes across texts
                at = ends - j
                hit[at[(at >= 0) & (at < len(hit))]] = False
            edges = np.diff(np.r_[False, hit, False].astype(np.int8))
            first, past = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            long = past - first >= need
            first, n = first[long], (past - first)[long]
            own = pa.array([keys[i] for i in np.searchsorted(ends, first, side="right")], kind)
            return pa.RecordBatch.from_arrays([own, _lists(w[_spans(first, n + shingle - 1)], n + shingle - 1), _lists(s[_spans(first, n)], n)], ["doc_id", "words", "tokens"])

        keys: list = []
        sizes: list[int] = []
        held: list[int] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for read in readings(text, window):
                    if len(read) >= window:
                        keys.append(doc_id)
                        sizes.append(len(read))
                        held += [numbers[x] for x in read]
                if len(held) >= PORTION:
                    yield found(b.schema.field(0).type)
                    keys, sizes, held = [], [], []
            if held:
                yield found(b.schema.field(0).type)
                keys, sizes, held = [], [], []

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, words array<bigint>, tokens array<bigint>")


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, part_places: int = PART_PLACES) -> DataFrame:
    """doc_id, item_id, window_no: each window of an item that a document holds. Inputs have doc_id or item_id, and text."""
    lead = window - shingle  # words of a window before its last shingle
    windows = written(item_windows(items, window, shingle), "windows")
    kept = written(runs(documents, shingle_map(windows), window, shingle), "runs")
    places = kept.select("doc_id", F.posexplode("tokens").alias("at", "token"), "words")
    before = F.least(F.col("at"), F.lit(lead))  # of the run only what a window at this place can reach goes along
    hits = places.select("doc_id", "token", before.alias("before"), F.slice("words", F.col("at") - before + 1, before + window).alias("around"))
    rarity = kept.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("places"))
    tokens = windows.select("item_id", "window_no", "window", F.posexplode("tokens").alias("offset", "token")).join(rarity, "token", "left")
    # a shingle that no run holds rules its windows out
    least = F.min(F.coalesce("places", F.lit(0))).alias("places")
    rarest = tokens.groupBy("item_id", "window_no", "window").agg(F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("places", F.lit(0)), F.col("offset"))).alias("p"), least).where("places > 0")
    parts = F.ceil(F.col("places") / part_places).cast("int")
    filed = rarest.select("item_id", "window_no", "window", "p.token", "p.offset", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    hot = rarity.where(F.col("places") > part_places).select("token", parts.alias("parts"))  # a row for each so many places at most
    spread = F.pmod(F.xxhash64("doc_id", "around"), F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")
    split = hits.join(F.broadcast(hot), "token", "left").withColumn("part", spread)
    start = F.col("before") - F.col("offset")
    met = split.join(filed, ["token", "part"]).where(start >= 0)
    return met.where(F.slice("around", F.greatest(start, F.lit(0)) + 1, window) == F.col("window")).select("doc_id", "item_id", "window_no").distinct()
