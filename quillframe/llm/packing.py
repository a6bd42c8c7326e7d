"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are tokenized where they lie and only piece lengths and checksums move
on. Packing looks at the histogram of piece lengths, which has ``capacity``
entries however large the corpus is. The reduction permanently fixes sets that
provably dominate all others that hold the same longest piece: alone if nothing
fits beside it, with an exact complement, or with the longest piece that fits if
no two pieces do. The rest is packed best-fit decreasing over counts, equal bins
together. The plan, a list of length ranks per run of equal bins, goes back to
the pieces by their rank among pieces of equal length.

Ids are those of the tokenizer as its file has it: where a text holds the string
of an added token, that is one id.

Defined results: null and empty texts are one piece holding the end id. Repeated
rows are packed each on their own; ranks among ties follow the id, then the
piece. Documents over ``capacity`` are cut, the first piece taking what is over.
Other columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, workers

CAPACITY = 2048
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 800_000
#: Bytes of text that are encoded together, but for a text that alone has more.
BYTES_TOGETHER = 3 << 20
#: Words that the tokenizer encodes at once: what it returns for each is far larger than its ids.
WORDS_TOGETHER = 8192
#: Rows that Spark hands to Python at once, within the bytes of common.small_batches.
ROWS_TOGETHER = 1200


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte offsets at which texts can be cut without changing any id, the texts' own ``edges`` among them.

    The byte-level vocabulary always parts a space from what stands before it if something visible follows, a single
    newline from what is visible on both sides, and a full stop or comma at a word's end from the letter before.
    Characters that may be white space, and "<", where the added token may stand, aren't taken for visible.
    """
    free = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        visible = ((data > 32) & (data < 127) & (data != 60)) | ((data >= 0xC3) & ((data < 0xE1) | (data > 0xE3)))
        free[: len(data) - 1] = (data[:-1] == 32) & visible[1:]
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        line = np.flatnonzero((data[1:-1] == 10) & (letter[:-2] | (data[:-2] == 46)) & visible[2:]) + 1
        stop = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & letter[:-2] & ((data[2:] == 32) | (data[2:] == 10))) + 1
        free[stop] = True
        # neither end of a line cut may fall on the end of a text
        inner = np.zeros(len(data) + 1, bool)
        inner[edges] = True
        line = line[~(inner[line] | inner[line + 1])]
        free[line] = free[line + 1] = True
    last = edges[1:-1]
    free[last[last > 0] - 1] = False
    free[edges] = True
    return np.flatnonzero(free)


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of ranges, one range after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 else np.int64
    at = np.repeat((begins - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return at


class Encoder:
    """Ids of whole texts. Words are found and grouped as Arrow columns; only words not met before are encoded.

    Met words are known by their 128-bit digests, in arrays sorted by the first half.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids = np.empty(0, "<u4")
        self.low, self.high = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begins, self.sizes, self.met = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint8)

    def forget(self) -> None:
        """Let go of all words but those that were met in several columns of texts."""
        keep = np.flatnonzero(self.met > 1)[: REMEMBERED // 2]
        self.low, self.high, self.met = self.low[keep], self.high[keep], self.met[keep]
        begins, self.sizes = self.begins[keep], self.sizes[keep]
        self.ids = self.ids[ragged(begins, self.sizes)]
        self.begins = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each of some distinct words has its own, and how many."""
        import xxhash

        if len(self.low) > REMEMBERED:
            self.forget()
        texts = words.to_pylist()
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<u8").reshape(-1, 2)
        at = np.searchsorted(self.low, digests[:, 0])
        near = np.minimum(at, max(0, len(self.low) - 1))
        taken = self.low[near] == digests[:, 0] if len(self.low) else np.zeros(len(texts), bool)
        known = taken & (self.high[near] == digests[:, 1]) if len(self.low) else taken
        begins, sizes = np.empty(len(texts), np.int32), np.empty(len(texts), np.int32)
        begins[known], sizes[known] = self.begins[near[known]], self.sizes[near[known]]
        self.met[near[known]] = np.minimum(self.met[near[known]], 254) + 1
        new = np.flatnonzero(~known)
        if len(new):
            unknown = [texts[i] for i in new.tolist()]
            found: list[list[int]] = []
            for i in range(0, len(unknown), WORDS_TOGETHER):
                found += [e.ids for e in self.tokenizer.encode_batch_fast(unknown[i : i + WORDS_TOGETHER], add_special_tokens=False)]
            sizes[new] = np.fromiter(map(len, found), np.int32, len(found))
            begins[new] = np.cumsum(sizes[new]) - sizes[new] + len(self.ids)
            self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(found), "<u4", int(sizes[new].sum()))]
            # of words whose digests begin alike, one is remembered
            new = new[~taken[new]]
            new = new[np.unique(digests[new, 0], return_index=True)[1]]
            columns = [("low", digests[new, 0]), ("high", digests[new, 1]), ("begins", begins[new]), ("sizes", sizes[new]), ("met", np.ones(len(new), np.uint8))]
            for name, values in columns:
                setattr(self, name, np.insert(getattr(self, name), at[new], values))
        return begins, sizes

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of a column's texts, one after the other, and where each text begins and the last ends."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
        edges = edges - edges[0]
        starts = word_starts(data, edges)
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        begins, sizes = self.look_up(words.dictionary)
        nth = words.indices.to_numpy()
        size = sizes[nth]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.ids[ragged(begins[nth], size)]
        return ids, np.r_[0, ends][np.searchsorted(starts, edges)]

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text]))[0].tolist()


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def worker_encoder(path: str, run_id: str) -> Encoder:
    """One encoder per worker process for all tasks of one run; what an earlier run remembered is let go. This module is shipped anew with each task, so it is kept outside of it."""
    kept = workers.worker_state()
    if (run_id, path) not in kept:
        kept.clear()
        kept[run_id, path] = Encoder(path)
    return kept[run_id, path]


def together(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column of texts, BYTES_TOGETHER each, or one text that has more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + BYTES_TOGETHER, "right")))
        yield column.slice(first, last - first)
        first = last


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for every piece of every row."""
    workers.ship(__name__)
    common.small_batches(docs.sparkSession, ROWS_TOGETHER)
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        workers.give_back()
        encoder, end = worker_encoder(path or tokenizer_path(), run_id), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            row = 0
            for texts in together(batch.column("text")):
                ids, edges = encoder.encode_column(texts)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    for i, (s, n) in enumerate(cut(b - a + 1, capacity)):
                        # the end id stands after the document's last one
                        crc = zlib.crc32(ids[a + s : min(a + s + n, b)])
                        out.append((row, i, s, n, zlib.crc32(end, crc) if a + s + n > b else crc))
                    row += 1
            cols = list(zip(*out, strict=True)) or [()] * 5
            arrays = [batch.column("doc_id").take(pa.array(cols[0], pa.int32())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()
        workers.give_back()

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fixed runs ``(bins, lengths of each bin)`` and the counts that remain.

    The longest remaining length j is looked at in turn:
    - nothing fits beside j: {j} dominates;
    - j has an exact complement k: whatever else stood beside j could take k's place, so {j, k} dominates;
    - no two remaining pieces fit beside j: {j, longest that fits} dominates.
    A length to which none applies is left, with all shorter ones still tried.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)  # ascending, kept free of exhausted lengths
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def take(bins: int, *items: int) -> None:
        fixed.append((bins, items))
        for n in items:
            left[n] -= bins
            if not left[n]:
                del left[n]
                lengths.remove(n)

    for j in sorted(left, reverse=True):
        while j in left:
            room = capacity - j
            if room in left:
                bins = left[j] // 2 if room == j else min(left[j], left[room])
                if bins:
                    take(bins, j, room)
                    continue
            # what may stand beside one j: the counts without it
            own = 1 if left[j] > 1 else 0
            beside = [n for n in lengths[:3] if n != j or own]
            if not beside or beside[0] > room:
                take(left[j], j)
                continue
            small = beside[0]
            second = small if left[small] - (small == j) > 1 else next((n for n in beside if n > small), capacity + 1)
            if small + second > room:
                at = bisect.bisect_right(lengths, room) - 1
                k = lengths[at]
                if k == j and not own:
                    k = lengths[at - 1]
                bins = left[j] // 2 if k == j else min(left[j], left[k])
                # taking k may exhaust the small pieces, so the test is repeated after each run of equal bins
                take(bins, j, k)
                continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: bins that hold the same are filled together."""
    open_bins: dict[int, list[list]] = {}  # room left -> [[bins, items]]
    rooms: list[int] = []

    def put(room: int, bins: int, items: tuple[int, ...]) -> None:
        if not bins:
            return
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        for group in open_bins[room]:
            if group[1] == items:
                group[0] += bins
                return
        open_bins[room].append([bins, items])

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):  # no open bin: new ones, each as full as this length makes it
                per = capacity // n
                bins, over = divmod(left, per)
                put(capacity - per * n, bins, (n,) * per)
                put(capacity - over * n, int(over > 0), (n,) * over)
                break
            room = rooms[at]
            groups = open_bins[room]
            group = groups[-1]
            per = min(room // n, left)
            bins = min(group[0], left // per)
            left -= bins * per
            group[0] -= bins
            if not group[0]:
                groups.pop()
                if not groups:
                    del open_bins[room]
                    rooms.pop(at)
            put(room - per * n, bins, group[1] + (n,) * per)
    return [(g[0], g[1]) for groups in open_bins.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Runs ``(bins, lengths of each bin)`` that use every piece once."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first_rank, last_rank, sequence, per_bin, offset``: equal lengths in a bin stand side by side."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for bins, items in runs:
        offset = 0
        for n in dict.fromkeys(items):
            per, first = items.count(n), used.get(n, 0)
            out.append((n, first, first + per * bins - 1, sequence, per, offset))
            used[n] = first + per * bins
            offset += per * n
        sequence += bins
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module's text."""
    spark = docs.sparkSession
    ws = common.Workspace(spark, "packing")
    pieces = ws.save(token_pieces(docs, path, capacity, end_id), "pieces")
    # At most ``capacity`` rows, so the histogram and the plan made from it stay small at any size.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list[tuple]] = {}
    for n, *slot in slots(plan(counts, capacity)):
        by_length.setdefault(n, []).append(slot)
    lookup = {n: np.array(sorted(x), np.int64).T for n, x in by_length.items()}

    # Rank among equal lengths without bringing all pieces of a length together: buckets of a length are counted first.
    # With c pieces there are about sqrt(c) buckets of sqrt(c), so neither of the two windows grows faster than that.
    shares = F.broadcast(spark.createDataFrame([(n, math.isqrt(c) + 1) for n, c in counts.items()], "length long, buckets long"))
    cell = pieces.join(shares, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets")).drop("buckets")
    cells = cell.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start"))
    ranked = cell.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    workers.ship(__name__)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, _, start, per, place_at = lookup[int(n)]
                run = np.searchsorted(first, rank[at], "right") - 1
                nth = rank[at] - first[run]
                sequence[at] = start[run] + nth // per[run]
                offset[at] = place_at[run] + nth % per[run] * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "rank").mapInArrow(place, schema)
