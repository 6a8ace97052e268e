"""Subject areas of each document: term weighting, truncated singular value decomposition, refined seed centroids.

Passages are the lines of a text, those that end within a sentence joined with the next up to a blank line; a line of more than
``LONGEST`` sentences is cut into windows. Within a line of more than ``WINDOW`` sentences, overlapping windows of that many are judged
besides, so that a passage within another is seen: they add the subjects that they clearly show, and take no part in the fitting. Terms are
words without their endings (so that inflected forms meet), numbered by hash. The weight of a term is its count times its inverse document frequency over all passages
of the corpus times the information it carries about the subjects in a bounded sample of the human labels. The most
informative terms make the vocabulary (``VOCABULARY``, the size of the model); the truncated decomposition of the weighted passages is
found by subspace iteration over the whole corpus. Seed centroids, one per subject and alphabet, come from the titles of the subjects and the
labelled documents; they are refined by assigning all passages and averaging those assigned clearly. A document gets each named
subject that a passage of several sentences is nearest to; a passing mention within a passage about something else is outweighed
there. ``OTHER``, alone, if there is none.

All passes over the corpus run on a written table of term numbers and then on one of embeddings. What tasks send back are
sums of fixed size (vocabulary times dimensions, subjects times dimensions); they are added up as a tree, so that no task adds more
than ``FAN`` of them, however many tasks there are. The driver holds the vocabulary, the basis and the centroids, no counts of terms.

Cases: null and empty texts give no row, as do texts of white space; a text without a clear passage is ``OTHER``. Labels of
unknown documents or subjects are ignored, repeated ones count once, no labels leave the titles. Repeated rows of
documents count as one document. An empty corpus gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triscope.llm.words import odd, table
from triscope.sources.scratch import written

#: At most so many labelled documents, chosen by hash, inform term weights and seeds.
LABELLED = 100_000
BUCKETS = 1 << 20
#: Sums that one task adds up.
FAN = 64
VOCABULARY = 4096
DIMENSIONS = 48
SVD_PASSES = 2
REFINEMENTS = 4
SENTENCES = 3
LONGEST = 14
#: Sentences of a window that is judged besides, and how far apart windows begin: any four sentences in a row lie in one.
WINDOW = 5
STEP = 2
LEAST_DOCS = 3
CLEAR = 0.1
#: Characters whose terms are counted at once.
PORTION = 4_000_000
OTHER = "OTHER"

_HAS_TEXT = r"text rlike '[^\\s\\p{Z}]'"
_WORDS = re.compile(r"[^\W\d_]{3,}")
_LINES = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
_LINE = re.compile(r"\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]")
_ENDED = re.compile(r"[.;!?…][»\")]*\s*$")
_END = re.compile(r"[.;!?…]+[»\")]*(?:\s|$)")
_LATIN = re.compile(r"[b-dfgijlnqrsuvwz]")


#: Endings of Russian and English words. Of each line the longest that leaves ``LEAST_STEM`` letters is taken off.
ENDINGS = (
    "ся сь",
    "ами ями ого его ому ему ыми ими ая яя ое ее ые ие ый ий ой ей ых их ую юю ою ею ом ем ам ям ах ях ов ев иями ией иям иях ия ию ии ет ют ут ит ят ат ете ите ать ять ить еть ти ал ил ел ла ло ли ала ило али или ена ено ены ан ана ано аны а я о е ы и у ю ь й ing ings ed edly es s ly",
    "ост енн нн н ени ани ств тельн еск ск ness ment ation ition al",
)
LEAST_STEM = 3


@cache
def _endings() -> list[list[tuple[str, int]]]:
    """The endings of each line as they are after folding, longest first, with their length."""
    return [sorted({(f, len(f)) for e in line.split() if (f := e.translate(table()))}, key=lambda x: (-x[1], x[0])) for line in ENDINGS]


def stem(folded: str) -> str:
    """A folded word without its endings."""
    for line in _endings():
        n = len(folded)
        for ending, m in line:
            if n - m >= LEAST_STEM and folded.endswith(ending):
                folded = folded[: n - m]
                break
    return folded


class Terms(dict):
    """Lower-case word -> twice the number of its term, plus 1 if of the Latin alphabet; filled as words come up."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        folded = word.translate(table())
        v = self[word] = 2 * (zlib.crc32(stem(folded).encode()) % BUCKETS) + bool(_LATIN.search(folded))
        return v


def sentences(line: str) -> list[str]:
    """The sentences of a line, and what follows the last one's end."""
    cuts = [0, *(m.end() for m in _END.finditer(line)), len(line)]
    return [line[a:b] for a, b in zip(cuts, cuts[1:])]


def spans(n: int) -> Iterator[tuple[int, int]]:
    """The passages of a line of ``n`` ended sentences: from which of its parts to before which."""
    size = LONGEST // 2
    cuts = [0, *range(size, n - size + 1, size), n + 1] if n > LONGEST else [0, n + 1]
    return zip(cuts, cuts[1:])


def window_starts(n: int) -> tuple[int, ...]:
    """Where the overlapping windows begin in a line of ``n`` sentences; none where a window would hold the line."""
    return (*range(0, n - WINDOW, STEP), n - WINDOW) if n > WINDOW else ()


def passages(text: str) -> Iterator[tuple[int, str]]:
    """(number of sentences, text) of each passage."""
    for line in _LINES.split(text):
        if line and not line.isspace():
            parts = sentences(line)
            for a, b in spans(len(parts) - 1):
                yield min(b, len(parts) - 1) - a, "".join(parts[a:b])


def unwrapped(text: str) -> str:
    """The text with the lines of hard-wrapped passages joined, up to a blank line; blank lines are left out.

    A line goes on if it ends within a sentence, or if it and the next have too few sentences for a passage, as where a sentence
    happens to end with a wrapped line.
    """
    blocks: list[list[str]] = []
    last: str | None = None
    few = False
    for line in _LINE.split(text):
        if not line or line.isspace():
            last = None
            continue
        was, few = few, len(_END.findall(line)) < SENTENCES
        if last is None or (_ENDED.search(last[-40:]) and not (was and few)):
            blocks.append([line])
        elif (end := last.rstrip())[-1] in "-‐‑\xad" and end[-2:-1].isalpha():
            blocks[-1][-1] = end[:-1]
            blocks[-1].append(line.lstrip())
        else:
            blocks[-1] += [" ", line]
        last = blocks[-1][-1]
    return "\n".join(map("".join, blocks))


def windows(line: str) -> Iterator[str]:
    """The overlapping windows of a line with more sentences than one."""
    parts = sentences(line)
    for i in window_starts(len(parts) - 1):
        yield "".join(parts[i : i + WINDOW])


def _rows(pairs: Iterator[tuple[object, str]], terms: Terms) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sentences and alphabet of the passages and, with sentences below 0, of the windows; sizes, terms and counts of their bags
    of terms. A sentence is read once, however many windows hold it."""
    keys, counted, lengths, found = [], [], [], []
    split_by, number, find = odd(), terms.__getitem__, _WORDS.findall

    def add(key: object, n: int, parts: list[list[int]]) -> None:
        keys.append(key)
        counted.append(n)
        lengths.append(sum(map(len, parts)))
        for p in parts:
            found.extend(p)

    for key, text in pairs:
        text = text.lower()
        if split_by.search(text):
            text = unicodedata.normalize("NFC", text).translate(table())
        for line in unwrapped(text).split("\n"):
            if not line:
                continue
            parts = [list(map(number, find(x))) for x in sentences(line)]
            n = len(parts) - 1
            for a, b in spans(n):
                add(key, min(b, n) - a, parts[a:b])
            for i in window_starts(n):
                add(key, -WINDOW, parts[i : i + WINDOW])
    total = len(keys)
    all_terms, at = np.array(found, np.int64), np.repeat(np.arange(total), lengths)
    latin = np.bincount(at, all_terms & 1, total) * 3 > np.array(lengths)
    pairs_of, counts = np.unique(at * BUCKETS + (all_terms >> 1), return_counts=True)
    sizes = np.bincount(pairs_of // BUCKETS, minlength=total)
    return keys, np.array(counted, np.int32), latin, sizes, (pairs_of % BUCKETS).astype(np.int32), counts.astype(np.int32)


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))


def _portions(pairs: Iterator[tuple[object, str]], chars: int = PORTION) -> Iterator[list[tuple[object, str]]]:
    """Documents in portions of at least so many characters, the last but for fewer; each is held at once."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[1])
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def term_table(documents: DataFrame) -> DataFrame:
    """doc_id, sentences, latin, terms, counts of each passage, and of each window with sentences below 0."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            for pairs in _portions(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                keys, sentences, latin, sizes, ids, counts = _rows(iter(pairs), terms)
                columns = [pa.array(keys, b.schema.field(0).type), pa.array(sentences), pa.array(latin), _lists(sizes, ids), _lists(sizes, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sentences", "latin", "terms", "counts"])

    return documents.select("doc_id", "text").where(_HAS_TEXT).mapInArrow(run, f"doc_id {kind}, sentences int, latin boolean, terms array<int>, counts array<int>")


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def _sum_runs(x: np.ndarray, rows: np.ndarray, v: np.ndarray, first: np.ndarray, portion: int = 4000) -> np.ndarray:
    """The sums of ``x[rows] * v`` over runs that begin at ``first``; about ``portion`` entries at a time, which fit into a cache."""
    out = np.zeros((len(first), x.shape[1]), x.dtype)
    cuts = np.unique(np.r_[0, np.searchsorted(first, np.arange(portion, len(rows), portion)), len(first)])
    for a, b in zip(cuts, cuts[1:]):
        i, j = first[a], first[b] if b < len(first) else len(rows)
        part = x[rows[i:j]]
        part *= v[i:j, None]
        out[a:b] = np.add.reduceat(part, first[a:b] - i, axis=0)
    return out


class Space:
    """Vocabulary, term weights and projection."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, basis: np.ndarray):
        self.place, self.weight, self.basis = place, weight, basis

    def weighted(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, column, value) of the unit vectors of passages, in the order of passages."""
        at = self.place[terms]
        keep = at >= 0
        row = np.repeat(np.arange(len(sizes)), sizes)[keep]
        at = at[keep]
        v = counts[keep].astype(np.float32) * self.weight[at]
        norm = np.sqrt(np.bincount(row, v * v, len(sizes)))
        return row, at, (v / np.maximum(norm, 1e-12)[row]).astype(np.float32)

    def embed(self, row: np.ndarray, at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.basis.shape[1]), np.float32)
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = _sum_runs(self.basis, at, v, first)
        return out


def _of_batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = b.column(b.schema.get_field_index("terms"))
    return _flat(b, "terms"), _flat(b, "counts"), np.diff(lists.offsets.to_numpy())


def _summed(parts: DataFrame, tasks: int, fan: int = FAN) -> np.ndarray:
    """The sum of the equally long float arrays (slot, part, data) that as many tasks give out: added ``fan`` at a time until few are
    left, then joined by slot."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for b in batches:
            first = b if first is None else first
            for x in b.column(2):
                v = np.frombuffer(x.as_py(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([first.column(0)[:1], first.column(1)[:1], pa.array([total.tobytes()], pa.binary())], ["slot", "part", "data"])

    while True:
        tasks = -(-tasks // fan)
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("slot", "part").applyInArrow(add, _PARTS)
        if tasks <= 1:
            break
    rows = parts.collect()  # one row for each slot
    return np.concatenate([np.frombuffer(r["data"], np.float64) for r in sorted(rows, key=lambda r: r["slot"])]) if rows else np.zeros(0)


def _send(total: np.ndarray, slot: int = 131_072) -> pa.RecordBatch:
    from pyspark import TaskContext

    flat = total.ravel().astype(np.float64)
    pieces = [flat[i : i + slot].tobytes() for i in range(0, len(flat), slot)]
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([part] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], ["slot", "part", "data"])


_PARTS = "slot int, part int, data binary"


def _tasks(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def decompose(passages: DataFrame, space: Space, passes: int) -> np.ndarray:
    """An orthonormal basis of the leading right singular vectors."""
    basis, tasks = space.basis, _tasks(passages)
    for _ in range(passes):
        sent = passages.sparkSession.sparkContext.broadcast(Space(space.place, space.weight, basis.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sent.value
            total = np.zeros(s.basis.shape, np.float64)
            for b in batches:
                terms, counts, sizes = _of_batch(b)
                row, at, v = s.weighted(terms, counts, sizes)
                if len(row):
                    e = s.embed(row, at, v, len(sizes))
                    order = np.argsort(at, kind="stable")
                    c = at[order]
                    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                    total[c[first]] += _sum_runs(e, row[order], v[order], first)
            yield _send(total)

        total = _summed(passages.select("terms", "counts").mapInArrow(run, _PARTS), tasks)
        if not len(total):
            return basis
        basis = np.linalg.qr(total.reshape(basis.shape))[0]
    return basis


def _nearest(e: np.ndarray, latin: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the nearest centroid of the passage's alphabet, and how much nearer it is than the next."""
    n = len(centroids) // 2
    sims = np.where(latin[:, None], e @ centroids[n:].T, e @ centroids[:n].T)
    best = sims.argmax(1)
    top = sims[np.arange(len(e)), best]
    sims[np.arange(len(e)), best] = -np.inf
    return best + n * latin, top - (sims.max(1) if n > 1 else -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _vectors(b: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(b"".join(b.column(b.schema.get_field_index("e")).to_pylist()), np.float16).reshape(-1, dimensions).astype(np.float32)
    return e, b.column(b.schema.get_field_index("latin")).to_numpy(zero_copy_only=False).astype(int)


def assign_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, labelled: int = LABELLED, vocabulary: int = VOCABULARY, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, subject_code. ``subjects`` has subject_code, title_ru, title_en; ``labels`` has doc_id, subject_code."""
    spark = documents.sparkSession
    context = spark.sparkContext
    named = sorted({(r[0], f"{r[1] or ''}\n{r[2] or ''}") for r in subjects.select("subject_code", "title_ru", "title_en").collect() if r[0]})
    codes = [c for c, _ in named]
    n = len(codes)
    if not n:
        return documents.where(_HAS_TEXT).select("doc_id", F.lit(OTHER).alias("subject_code")).distinct()
    table_of_terms = written(term_table(documents), "terms")
    known = labels.where(F.col("subject_code").isin(codes) & F.col("doc_id").isNotNull()).select("doc_id", "subject_code").distinct()
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))  # bounded by the parameter

    # document frequencies over the whole corpus; what a term tells about the subjects over the labelled passages and the titles
    whole = table_of_terms.where("sentences >= 0")
    frequency = whole.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    total = whole.count()
    title_codes, _, title_latin, title_sizes, title_terms, title_counts = _rows(((c, t.replace("\n", "\n\n")) for c, t in named), Terms())
    titles = spark.createDataFrame([(int(t), c) for t, c in zip(title_terms, np.repeat(title_codes, title_sizes))], "term int, subject_code string")
    shown = table_of_terms.where(F.col("sentences") >= SENTENCES).join(known, "doc_id").select(F.explode("terms").alias("term"), "subject_code").unionByName(titles)
    seen = written(shown.groupBy("term", "subject_code").agg(F.count("*").alias("n")), "shown")
    of_subject = dict(seen.groupBy("subject_code").agg(F.sum("n")).collect())  # as many rows as subjects
    shares = {c: (of_subject.get(c, 0) + 1) / (sum(of_subject.values()) + n) for c in codes}
    share = spark.createDataFrame(list(shares.items()), "subject_code string, share double")
    told = seen.join(F.broadcast(share), "subject_code").groupBy("term").agg(F.collect_list(F.struct("n", "share")).alias("of"))  # as long as there are subjects
    all_seen = F.aggregate("of", F.lit(0.0), lambda a, x: a + x["n"]) + 2
    given = lambda x: (x["n"] + 2 * x["share"]) / F.col("all_seen")
    where_seen = F.aggregate("of", F.lit(0.0), lambda a, x: a + given(x) * F.log(given(x) / x["share"]))
    elsewhere = (1 - F.aggregate("of", F.lit(0.0), lambda a, x: a + x["share"])) * 2 / F.col("all_seen") * F.log(2 / F.col("all_seen"))
    worth = told.withColumn("all_seen", all_seen).withColumn("information", where_seen + elsewhere).join(frequency, "term").withColumn("worth", F.round(F.col("docs") * F.col("information"), 9))
    best = worth.where("worth > 0").orderBy(F.desc("worth"), "term").limit(vocabulary).select("term", "docs", "information").toPandas().sort_values("term")
    chosen = best["term"].to_numpy(np.int64)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    weight = (np.log((total + 1) / best["docs"].to_numpy(np.float64)) * best["information"].to_numpy(np.float64)).astype(np.float32)

    k = max(1, min(dimensions, len(chosen)))
    start = np.random.default_rng(0).standard_normal((max(1, len(chosen)), k)).astype(np.float32)
    space = Space(place, weight, start)
    space.basis = decompose(whole, space, SVD_PASSES).astype(np.float32) if len(chosen) else start
    sent = context.broadcast(space)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            terms, counts, sizes = _of_batch(b)
            e = _unit(s.embed(*s.weighted(terms, counts, sizes), len(sizes))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in e], pa.binary())], ["doc_id", "sentences", "latin", "e"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    embedded = written(table_of_terms.mapInArrow(embed, f"doc_id {kind}, sentences int, latin boolean, e binary"), "embedded")
    long = embedded.where(F.col("sentences") >= SENTENCES)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * n, k))
        for b in batches:
            e, latin = _vectors(b, k)
            of = np.array([codes.index(c) for c in b.column(2).to_pylist()], int)
            np.add.at(sums, of + n * latin, e)
        yield _send(sums)

    tasks = _tasks(long)
    found = _summed(long.join(known, "doc_id").select("e", "latin", "subject_code").mapInArrow(seeds, _PARTS), tasks)
    sums = found.reshape(2 * n, k) if len(found) else np.zeros((2 * n, k))
    vectors = _unit(space.embed(*space.weighted(title_terms, title_counts, title_sizes), len(title_sizes)))
    np.add.at(sums, [codes.index(c) + n * int(x) for c, x in zip(title_codes, title_latin)], vectors)
    centroids = _unit(sums)

    for _ in range(REFINEMENTS):
        now = context.broadcast(centroids.astype(np.float32))

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2 * n, k))
            for b in batches:
                e, latin = _vectors(b, k)
                if len(e):
                    best, lead = _nearest(e, latin, now.value)
                    clear = lead > CLEAR
                    for c in np.unique(best[clear]):
                        sums[c] += e[clear & (best == c)].sum(0, dtype=np.float64)
            yield _send(sums)

        found = _summed(long.select("e", "latin").mapInArrow(refine, _PARTS), tasks)
        if len(found):
            sums = found.reshape(2 * n, k)
            centroids = _unit(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, centroids))
    last = context.broadcast(centroids.astype(np.float32))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, latin = _vectors(b, k)
            sentences = b.column(1).to_numpy()
            best, lead = _nearest(e, latin, last.value) if len(e) else (np.zeros(0, int), np.zeros(0))
            ok = (np.abs(sentences) >= SENTENCES) & (lead > np.where(sentences < 0, CLEAR, 0)) & (np.abs(e).sum(1) > 0)
            code = [codes[c % n] if y and codes[c % n] != OTHER else None for c, y in zip(best.tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.string())], ["doc_id", "subject_code"])

    each = embedded.mapInArrow(final, f"doc_id {kind}, subject_code string")
    per_document = each.groupBy("doc_id").agg(F.collect_set("subject_code").alias("codes"))  # a set of at most so many codes as there are subjects
    return per_document.select("doc_id", F.explode(F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit(OTHER)))).alias("subject_code"))
