"""Language identification by a mixture of language models.

Each language has a model of character trigrams within words. A document is seen
as words drawn from a mixture of languages; expectation-maximisation estimates
the proportions, and languages are taken into the document's set one at a time
for as long as the penalised log-likelihood grows. The main language of the set
is the prediction and its proportion the score.

The models are tables of hashed trigrams, whose size doesn't depend on the
corpus. They are fitted on the whole texts of at most ``per_language`` labelled
documents a language, those with the smallest hashed ids: a documented bound on
training. Predictions read whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0.
Equal texts get equal results. Rows with a null label train nothing. With no
labelled row at all every document is ``und``; ``keep_known`` then keeps none. Repeated rows give one result
each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, workers

SLOTS = 1 << 17
PER_LANGUAGE = 1000
SMOOTHING = 0.05
ROUNDS = 12
#: Log-likelihood that one more language must win for each document, and for each log word.
PENALTY = 3.0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams around each letter, lower-cased, and where each word begins among them."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[codes]
    codes = np.where(known, codes, 32).astype(np.uint64)
    at = np.flatnonzero(known)
    mixed = codes[at - 1] * np.uint64(0x9E3779B97F4A7C15) + codes[at] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(47)).astype(np.int64) & (SLOTS - 1), np.flatnonzero(~known[at - 1])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities ``(SLOTS, languages)`` from ``labelled(doc_id, text, lang)``."""
    workers.ship(__name__)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", F.lit(7)).alias("key"), "text")
    # The first ``per_language`` by key, without a task that sees all of a language: rows are counted by 4096 ranges of
    # the key, which tells the ranges that the first ones are in, and ranked inside their range.
    keys = rows.select("doc_id", "lang", "key", F.shiftright("key", 52).alias("cell"))
    cells = keys.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell")) - F.col("n")
    wanted = cells.select("lang", "cell", before.alias("before")).filter(F.col("before") < per_language)
    nth = F.col("before") + F.row_number().over(Window.partitionBy("lang", "cell").orderBy("key", "doc_id"))
    chosen = keys.join(F.broadcast(wanted), ["lang", "cell"]).withColumn("nth", nth).filter(F.col("nth") <= per_language).select("doc_id", "lang", "key")
    sample = rows.join(F.broadcast(chosen.dropDuplicates()), ["doc_id", "lang", "key"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.give_back(all_of_it=True)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                totals[lang] = totals.get(lang, 0) + np.bincount(trigrams(text)[0], minlength=SLOTS)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(total[used])], ["lang", "slot", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((SLOTS, len(langs)), SMOOTHING)
    table[counts["slot"].to_numpy(), np.searchsorted(langs, counts["lang"])] += counts["n"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def proportions(likelihood: np.ndarray, chosen: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM over words: mixture weights of the ``chosen`` languages and the log-likelihood."""
    own = likelihood[:, chosen]
    peak = own.max(1, keepdims=True)
    odds = np.exp(own - peak)
    weight = np.full(len(chosen), 1 / len(chosen))
    for _ in range(rounds):
        share = odds * weight
        weight = (share / share.sum(1, keepdims=True)).mean(0)
    return weight, float(np.log(odds @ weight).sum() + peak.sum())


def mixture(text: str | None, langs: list[str], table: np.ndarray) -> tuple[str, float, str]:
    """Main language, its proportion, and all languages of the set with theirs."""
    slots, starts = trigrams(text or "")
    if not len(slots) or not langs:
        return "und", 0.0, ""
    words = np.add.reduceat(table[slots], starts, axis=0).astype(np.float64)
    chosen = [int(words.sum(0).argmax())]
    weight, best = np.ones(1), float(words[:, chosen[0]].sum())
    cost = PENALTY + np.log(len(words))
    ceiling = words.max(1)
    while len(chosen) < len(langs) and float(ceiling.sum()) - best > cost:
        # what a language could win at most, word by word, picks the next one
        inside = words[:, chosen].max(1)
        gains = [(np.maximum(words[:, k] - inside, 0).sum(), -k) for k in range(len(langs)) if k not in chosen]
        extra = -max(gains)[1]
        if max(gains)[0] <= cost:
            break
        grown, value = proportions(words, [*chosen, extra])
        if value - best <= cost:
            break
        chosen, weight, best = [*chosen, extra], grown, value
    order = sorted(range(len(chosen)), key=lambda i: (-weight[i], chosen[i]))
    return langs[chosen[order[0]]], float(min(1.0, max(0.0, weight[order[0]]))), ",".join(f"{langs[chosen[i]]}:{weight[i]:.3f}" for i in order)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``docs``' id with ``lang_pred, score, lang_set``."""
    workers.ship(__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mixture(t.as_py(), langs, table) for t in batch.column("text")]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string())], ["doc_id", "lang_pred", "score", "lang_set"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, lang_set string")


def keep_known(docs: DataFrame, langs: list[str], table: np.ndarray, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that have a language with a share of ``least_score`` or more, in one pass, with it as their ``lang``."""
    workers.ship(__name__)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.give_back(all_of_it=True)
        for batch in batches:
            found = [mixture(t.as_py(), langs, table)[:2] for t in batch.column("text")]
            known = pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_())
            predicted = pa.array([lang for lang, _ in found], pa.string())
            arrays = [predicted.cast(batch.column(c).type) if c == "lang" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(known)
        workers.give_back()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out, and predict all of ``docs(doc_id, text, lang)``."""
    langs, table = fit(docs.filter(~held_out()))
    return predict(docs, langs, table).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set")
