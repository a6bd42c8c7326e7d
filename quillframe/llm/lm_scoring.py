"""Stupid-backoff scores of every document against all other documents.

The model is the corpus' own n-gram counts. A document is scored by the counts
of the rest of the corpus: its own occurrences are taken off, so copies of a
text make it likely and its own words don't. At each position the longest
n-gram that others hold gives its relative frequency, each step back costs a
factor of 0.4, and a word that nobody else has counts as half an occurrence.

It is relational, over three tables whose rows hold many n-grams each:

- *texts*, written once: a batch of documents as word hashes, with an id of its own.
- *asked*: a batch's distinct n-grams with their counts, exploded by the bucket
  of their hash. Grouped by bucket they are the count table, partitioned by hash.
- *told*: the count table joined to what was asked, back to the batch: how often
  other batches hold each n-gram. Summed per document, it gives the scores.

Words and pairs are counted first. A longer n-gram can only occur in another
document if both n-grams in it that are a word shorter do, so only those
positions ask for it. That leaves nothing out, and is done once per order above two.
Hashes are sorted within a bucket and stored by their differences, byte by byte,
as most of their upper bytes are then zero. A frequent n-gram is one entry per
batch, however many documents hold it. There are as many buckets as the number
of words asks for, so what a task holds doesn't grow with the corpus.

Defined results: null texts and texts without words have no tokens and a null
score. Repeated rows are documents of their own and see each other. Ids may be of
any type; rows without one are scored like any other. Other columns are ignored.
An empty table gives no rows. Counts cover all documents and texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ngram_join, workers
from .ngram_join import spark_schema, stir, table_of

ORDER = 3
BACKOFF = 0.4
NOBODY = 0.5
#: Words that a Python worker gathers into one batch, and distinct n-grams of a bucket, about.
BATCH_WORDS, BUCKET_GRAMS = 1_500_000, 1_500_000

ASKED = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("level", pa.int64()), ("grams", pa.binary()), ("times", pa.binary())])
TOLD = pa.schema([("batch", pa.int64()), ("level", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])


def planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones, and so on: upper bytes are mostly zero and pack well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the whitespace-separated words, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams(words: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``level`` + 1 words that end at each position, and whether the document has that many words by then."""
    full = np.arange(len(words)) >= level
    out = words.copy()
    for k in range(1, level + 1):
        out[k:] = stir(out[k:] * np.uint64(0x9E3779B97F4A7C15) + words[:-k])
        full[k:] &= doc[k:] == doc[:-k]
    return out, full


class Batch:
    """A row of *texts* with what it has been told so far."""

    def __init__(self, row: dict):
        self.row, self.sizes = row, np.frombuffer(row["sizes"], "i8")
        self.words = np.frombuffer(row["vocabulary"], "u8")[from_planes(row["words"], "u4")]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        #: by level: occurrences in other documents of the n-gram that ends at each position
        self.others: list[np.ndarray] = []

    def asks(self, level: int) -> tuple[np.ndarray, ...]:
        """Positions that ask at this level, their distinct n-grams in order, each one's count, and each position's place among them."""
        every, full = grams(self.words, self.doc, level)
        if level > 1:
            below = self.others[level - 1] > 0
            full[1:] &= below[1:] & below[:-1]
        at = np.flatnonzero(full)
        return at, *np.unique(every[at], return_inverse=True, return_counts=True)

    def hear(self, level: int, told: list[tuple[int, bytes]]) -> None:
        """Take what the parts of a level tell, in their order, which is that of the n-grams."""
        at, found, place, times = self.asks(level)
        elsewhere = np.concatenate([from_planes(c, "i8") for _, c in sorted(told)]) if told else np.empty(0, np.int64)
        # own occurrences of each document are taken off
        _, back, own = np.unique(self.doc[at] * (len(found) + 1) + place, return_inverse=True, return_counts=True)
        rest = np.zeros(len(self.words), np.int64)
        rest[at] = (elsewhere + times)[place] - own[back]
        self.others.append(rest)

    def asked(self, level: int, buckets: int) -> list[tuple]:
        _, found, _, times = self.asks(level)
        edges = np.r_[0, np.searchsorted(bucket_of(found, buckets), np.arange(buckets), "right")]
        rows = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = found[edges[b] : edges[b + 1]]
            rows.append((level * buckets + b, self.row["batch"], level, planes(np.diff(own, prepend=np.uint64(0))), planes(times[edges[b] : edges[b + 1]].astype(np.uint32))))
        return rows

    def scores(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """By document: the sum of logs without the corpus' size, and how many unigrams want it."""
        top = np.minimum(np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes), order - 1)
        part, done = np.zeros(len(self.words)), np.zeros(len(self.words), bool)
        for level in range(order - 1, 0, -1):
            use = np.flatnonzero(~done & (self.others[level] > 0))
            part[use] = np.log10(self.others[level][use] / self.others[level - 1][use - 1]) + (top[use] - level) * np.log10(BACKOFF)
            done[use] = True
        use = np.flatnonzero(~done)
        part[use] = np.log10(np.maximum(self.others[0][use], NOBODY)) + top[use] * np.log10(BACKOFF)
        n = len(self.sizes)
        return np.bincount(self.doc, part, n), np.bincount(self.doc[use], minlength=n).astype(np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted n-grams are sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def gather(id_type: pa.DataType):
    """Rows of *texts*."""

    def packed(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(parts)
        known, place, times = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers
        number = np.empty(len(known), np.uint32)
        number[order] = np.arange(len(known))
        binary = [np.array([len(p) for p in parts], np.int64).tobytes(), known[order].tobytes(), planes(number[place])]
        columns = [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([len(words)], pa.int64()), *(pa.array([b], pa.binary()) for b in binary)]
        return pa.RecordBatch.from_arrays(columns, ["batch", "ids", "n_words", "sizes", "vocabulary", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                parts.append(word_hashes(t.as_py()))
                held += len(parts[-1])
                if held >= BATCH_WORDS or len(ids) >= 40_000:
                    yield packed(ids, parts)
                    ids, parts, held = [], [], 0
        if ids:
            yield packed(ids, parts)

    return run


def ask_first(levels: range, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for level in levels:
                    yield table_of(Batch(row).asked(level, buckets), ASKED)

    return run


def count_table(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams with their counts over all batches, and each asked one's place among them."""
    known, place = np.unique(hashes, return_inverse=True)
    return known, np.bincount(place, times, len(known)).astype(np.int64), place


def tell(table: pa.Table) -> pa.Table:
    """One part of the count table, joined to what each batch asked of it."""
    hashes = [np.cumsum(from_planes(g.as_py(), "u8"), dtype=np.uint64) for g in table.column("grams")]
    times = np.concatenate([from_planes(t.as_py(), "u4") for t in table.column("times")]).astype(np.int64)
    _, counts, place = count_table(np.concatenate(hashes), times)
    elsewhere = counts[place] - times
    ends = np.cumsum([len(h) for h in hashes])
    told = [planes(x) for x in np.split(elsewhere, ends[:-1])]
    return pa.table([table.column("batch"), table.column("level"), table.column("part"), pa.array(told, pa.binary())], schema=TOLD)


def told_batches(table: pa.Table, levels: range) -> Iterator[Batch]:
    """The batch of a group of *texts* and *told* rows, after hearing ``levels``."""
    rows = table.to_pylist()
    told: dict[int, list[tuple[int, bytes]]] = {}
    for r in rows:
        if r["level"] is not None:
            told.setdefault(r["level"], []).append((r["part"], r["counts"]))
    for r in rows:
        if r["level"] is None:
            batch = Batch(r)
            for level in levels:
                batch.hear(level, told.get(level, []))
            yield batch


def ask_next(level: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([table_of(b.asked(level, buckets), ASKED) for b in told_batches(table, range(level))], ASKED)

    return run


def score(order: int, id_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for b in told_batches(table, range(order)):
            part, n_unigrams = b.scores(order)
            out.append(pa.table([pa.array(b.row["ids"], id_type), pa.array(b.sizes), pa.array(part), pa.array(n_unigrams)], names=["doc_id", "n_words", "log10_part", "n_unigrams"]))
        return pa.concat_tables(out)

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, log10_score, mean_log10`` for every row of ``docs(doc_id, text)``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    workers.ship(__name__)
    workers.ship(ngram_join.__name__)
    common.small_batches(spark)
    ws = common.Workspace(spark, "lm_scoring")
    kind = docs.schema["doc_id"].dataType
    id_type, name = to_arrow_type(kind), kind.simpleString()
    source = docs.select("doc_id", "text").mapInArrow(gather(id_type), f"batch long, ids array<{name}>, n_words long, sizes binary, vocabulary binary, words binary")
    texts = ws.save(source, "texts", "zstd")
    total = texts.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(common.partitions(spark), -(-total // BUCKET_GRAMS))

    first = range(min(order, 2))
    told = [ws.save(texts.mapInArrow(ask_first(first, buckets), spark_schema(ASKED)).groupBy("part").applyInArrow(tell, spark_schema(TOLD)), "told1", "zstd")]
    ws.drop()  # the exchanges behind a written table can go

    def home() -> DataFrame:
        return common.stacked(texts, *told, allow_missing=True).groupBy("batch")

    for level in range(2, order):
        told.append(ws.save(home().applyInArrow(ask_next(level, buckets), spark_schema(ASKED)).groupBy("part").applyInArrow(tell, spark_schema(TOLD)), f"told{level}", "zstd"))
        ws.drop()
    parts = ws.save(home().applyInArrow(score(order, id_type), f"doc_id {name}, n_words long, log10_part double, n_unigrams long"), "parts")
    ws.drop("texts", "told1", *(f"told{level}" for level in range(2, order)))
    whole = F.col("log10_part") - F.col("n_unigrams") * F.log10(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)))
    scored = F.when(F.col("n_words") > 0, whole)
    return parts.select("doc_id", "n_words", scored.alias("log10_score"), (scored / F.col("n_words")).alias("mean_log10"))
