"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are classified by a multinomial logistic regression over sparse word
n-grams. It is trained here, on perturbed copies of licence notices against
ordinary sentences. Its thresholds are calibrated on families held out as a whole. Its
features are only n-grams that hold a licence word, one of STEMS: a bound of the model,
by which a paragraph without one has no feature at all and counts as of no licence, and
a cheap pattern finds the paragraphs worth scoring. Scoring is an
explode of n-grams and a join with the weight table, whose size is the model's.
A prediction counts when the template of its family is contained in the
paragraph to a sufficient degree, both all of it and what no other family's template
has of it. A line that is likely a licence, but of no family that a template
confirms, is ``unknown``. All of it is DataFrame functions.

A notice is one line, or runs over several up to the next blank line. So what is
scored is every line alone and every run of lines from it within its paragraph,
until the run has twice the words of the longest template after its first line.
Lines without a word aren't counted. Of confirmed runs that overlap, one stands:
that with the largest share of its template's word pairs, then the shortest,
then the first.

Defined results: null and empty texts have one empty line and no licence.
Equal texts get equal results; repeated rows give one result each. Other
columns are ignored. An empty table gives no rows. Texts are scanned whole.
"""

from __future__ import annotations

import random
import re
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Short licence notices by family, public wording.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Distributed under the terms of the GNU Lesser General Public License."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
}
#: Sentences that speak of licences, rights or software and grant nothing.
ORDINARY = (
    "He was licensed to drive a lorry.", "The licence fee was raised this year.", "She asked permission to leave the room.", "The software was slow and nobody liked it.",
    "A driving license must be renewed.", "The general public was not admitted.", "Free of charge until noon.", "The apache helicopter landed.", "They released the version under review.",
    "Copyright law is taught in the second year.", "The warranty covers parts only.", "Redistribution of wealth was debated.", "Under the terms of the treaty the border moved.",
)
#: A feature holds one of these stems.
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "apache", "gnu", "mozilla", "commons", "bsd", "mit", "isc", "cc")
WORD = "[a-z0-9]+"
NO_LICENCE, UNKNOWN = "none", "unknown"
#: The model's classes.
CLASSES = [NO_LICENCE, *NOTICES]
#: Share of a template's words and word pairs that the paragraph must hold.
CONTAINED = 0.6
SEED = 11
COPIES = 60


def is_feature(gram: str) -> bool:
    return any(w.startswith(STEMS[:5]) or w in STEMS[5:] for w in gram.split())


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] + [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False)]


def features(text: str) -> set[str]:
    return {g for g in grams(re.findall(WORD, text.lower())) if is_feature(g)}


def examples(rng: random.Random) -> list[tuple[set[str], int, set[str]]]:
    """Features, class and all n-grams of notices with words dropped and put among others, and of ordinary sentences."""
    filler = [w for s in ORDINARY for w in re.findall(WORD, s.lower())]
    out = []
    for label, family in enumerate(CLASSES):
        for text in NOTICES.get(family, ORDINARY):
            words = re.findall(WORD, text.lower())
            for _ in range(COPIES):
                kept = [w for w in words if rng.random() > 0.08] or words
                around = [rng.choice(filler) for _ in range(rng.randrange(12))]
                at = rng.randrange(len(around) + 1)
                every = grams(around[:at] + kept + around[at:])
                out.append(({g for g in every if is_feature(g)}, label, set(every)))
    return out


def fitted(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse multinomial logistic regression by proximal gradient steps."""
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(rounds):
        p = softmax(x @ w + b)
        w = w - 2.0 * (x.T @ (p - y) / len(x) + 1e-4 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4, 0)
        b -= 2.0 * (p - y).mean(0)
    return w, b


@cache
def train() -> tuple[dict[str, np.ndarray], np.ndarray, float, float, float]:
    """Weights by n-gram, biases, temperature, and the thresholds of a family and of any licence.

    The temperature comes from held-back copies. The thresholds come from families
    held out as a whole, one at a time, which stand for licences that the model
    doesn't know: at most one in twenty of their copies may be given another
    family's name, templates included (some lost the one word that tells them apart), and nine in ten should be found to be some licence.
    """
    rng = random.Random(SEED)
    data = examples(rng)
    rng.shuffle(data)
    fit, hold = data[: len(data) * 4 // 5], data[len(data) * 4 // 5 :]
    vocabulary = {g: i for i, g in enumerate(sorted({g for x, *_ in fit for g in x}))}

    def matrix(rows: list) -> np.ndarray:
        m = np.zeros((len(rows), len(vocabulary)))
        for i, (x, *_) in enumerate(rows):
            m[i, [vocabulary[g] for g in x if g in vocabulary]] = 1
        return m

    k = len(NOTICES) + 1
    x, label = matrix(fit), np.array([label for _, label, _ in fit])
    w, b = fitted(x, np.eye(k)[label], 400)
    scores, truth = matrix(hold) @ w + b, np.array([label for _, label, _ in hold])
    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    named, some = [], []
    for family in range(1, k):
        rest = label != family
        known = [c for c in range(k) if c != family]
        w0, b0 = fitted(x[rest], np.eye(k)[label[rest]][:, known], 120)
        # n-grams that only the family held out has are unknown to the model
        p = softmax((x[~rest] @ w0 + b0) / temperature)
        for i, row in zip(np.flatnonzero(~rest), p, strict=True):
            other = CLASSES[known[int(row.argmax())]]
            confirmed = other != NO_LICENCE and any(holds(fit[i][2], other, t) for t in NOTICES[other])
            named.append(float(row.max()) if confirmed else 0.0)
        some += (1 - p[:, 0]).tolist()
    grid = np.round(np.arange(0.3, 1.0, 0.05), 2)
    threshold = next((t for t in grid if (np.array(named) >= t).mean() <= 0.05), 0.95)
    any_licence = next((t for t in grid[::-1] if (np.array(some) >= t).mean() >= 0.9), 0.5)
    weights = {g: np.round(w[i], 6) for g, i in vocabulary.items() if np.abs(w[i]).max() > 1e-6}
    return weights, np.round(b, 6), temperature, float(threshold), float(max(0.5, any_licence))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def classify(text: str) -> str:
    """What ``scan`` says of one line, in plain Python: a family, NO_LICENCE, or UNKNOWN for a licence that no template confirms."""
    weights, bias, temperature, threshold, any_licence = train()
    found = [weights[g] for g in sorted(features(text)) if g in weights]
    if not found:
        return NO_LICENCE
    p = softmax(((bias + sum(found)) / temperature)[None])[0]
    family = CLASSES[int(p.argmax())]
    held = set(grams(re.findall(WORD, text.lower())))
    if family != NO_LICENCE and p.max() >= threshold and any(holds(held, family, t) for t in NOTICES[family]):
        return family
    return UNKNOWN if 1 - p[0] >= any_licence else NO_LICENCE


def holds(held: set[str], family: str, notice: str) -> bool:
    """Whether a text's n-grams contain enough of a template, and of what only its family has of it."""
    whole, own = template(notice), distinctive(family, notice)
    return len(held & whole) / len(whole) >= CONTAINED and len(held & own) / len(own) >= CONTAINED


def distinctive(family: str, notice: str) -> set[str]:
    """Words and pairs of a template that no other family's templates have."""
    return template(notice) - {g for other, ts in NOTICES.items() if other != family for t in ts for g in template(t)}


def template(notice: str) -> set[str]:
    words = re.findall(WORD, notice.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def model_table(spark: SparkSession) -> DataFrame:
    weights = train()[0]
    return spark.createDataFrame([(g, [float(v) for v in w]) for g, w in weights.items()], "gram string, weights array<double>")


#: Words of the longest template, twice: a run of lines takes another line while it has fewer.
RUN_WORDS = 2 * max(len(re.findall(WORD, t.lower())) for ts in NOTICES.values() for t in ts)
#: All words of templates, and how many of them a text needs to hold CONTAINED of any template.
KNOWN = sorted({w for ts in NOTICES.values() for t in ts for w in re.findall(WORD, t.lower())})
LEAST_KNOWN = 4
#: Lines are joined with their numbers before them; a blank one divides paragraphs.
BLANK_LINE = r"(?:^|\n)[0-9]+:[ \t\x0B\f\r]*(?=\n|\z)"


def runs_of(lines: str, pattern: str):
    """Runs ``first, last, words`` of numbered ``lines`` that may hold a template: each line alone, and with as many of the next as RUN_WORDS takes."""
    kind = "struct<first:int,last:int,n:int,known:int,stem:boolean,words:array<string>>"
    words = F.transform(lines, lambda x: F.struct(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)).alias("words"), x.rlike(pattern).alias("stem")))
    known = lambda x: F.size(F.array_intersect(x, F.array(*map(F.lit, KNOWN))))
    # the first word is the line's number; n counts the words after the first line
    alone = lambda pos, own, stem: F.struct(pos.alias("first"), pos.alias("last"), F.lit(0).alias("n"), known(own).alias("known"), stem.alias("stem"), own.alias("words")).cast(kind)
    singles = F.transform(F.filter(words, lambda x: F.size(x["words"]) > 1), lambda x: alone(x["words"][0].cast("int"), F.slice(x["words"], F.lit(2), F.size(x["words"]) - 1), x["stem"]))

    def longer(runs, x):
        last = F.element_at(runs, -1)
        run = F.struct(
            last["first"].alias("first"), x["last"].alias("last"), (last["n"] + F.size(x["words"])).alias("n"), (last["known"] + x["known"]).alias("known"),
            (last["stem"] | x["stem"]).alias("stem"), F.concat(last["words"], x["words"]).alias("words"),
        ).cast(kind)
        return F.when(last["n"] < RUN_WORDS, F.concat(runs, F.array(run))).otherwise(runs).cast(f"array<{kind}>")

    def from_line(x, i):
        runs = F.aggregate(F.slice("singles", i + 2, F.lit(RUN_WORDS)), F.array(x).cast(f"array<{kind}>"), longer)
        # a line without a word of a template begins no notice
        return F.when(x["known"] > 0, F.filter(runs, lambda r: r["stem"] & (r["known"] >= LEAST_KNOWN))).otherwise(F.array().cast(f"array<{kind}>"))

    return singles, F.flatten(F.transform("singles", from_line))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, n_license, n_unknown, families, places, scores`` for every row of ``docs(doc_id, text)``.

    ``n_paragraphs`` counts lines. ``families`` is the sorted distinct list of
    confirmed licences, ``places`` lists line:family of each by its first line,
    unknown ones among them, and ``scores`` the probability of each: of the family,
    or for unknown ones of any licence at all.
    """
    spark = docs.sparkSession
    ws = common.Workspace(spark, "license_scan")
    _, bias, temperature, threshold, any_licence = train()
    names = CLASSES
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    pattern = "(?i)(?<![a-z0-9])(" + "|".join(STEMS[:5]) + "|(" + "|".join(STEMS[5:]) + ")(?![a-z0-9]))"
    numbered = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(i.cast("string"), F.lit(":"), x)), "\n")
    pieces = rows.filter(F.col("text").rlike(pattern)).select(F.xxhash64("text").alias("text_key"), "doc_id", F.posexplode(F.split(numbered, BLANK_LINE, -1)).alias("piece", "paragraph"))
    singles, runs = runs_of("lines", pattern)
    pieces = pieces.filter(F.col("paragraph").rlike(pattern)).select("doc_id", "text_key", "piece", F.split("paragraph", "\n", -1).alias("lines")).withColumn("singles", singles)
    runs = pieces.select("doc_id", "text_key", "piece", F.explode(runs).alias("run"))
    runs = runs.select("doc_id", "text_key", "piece", F.col("run.first").alias("first"), F.col("run.last").alias("last"), F.col("run.words").alias("words"))

    def joined(n: int):
        at = F.sequence(F.lit(1), F.size("words") - n + 1)
        return F.when(F.size("words") >= n, F.transform(at, lambda i: F.array_join(F.slice("words", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    def share(held: str, grams: set[str]):
        return F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(grams))))) / len(grams)

    most = lambda of: of[0] if len(of) == 1 else F.greatest(*of)
    # of runs over several lines, what holds no template needs no score
    templates = most([share("pairs", template(t)) for ts in NOTICES.values() for t in ts])
    runs = runs.withColumn("pairs", F.concat("words", joined(2))).filter((F.col("first") == F.col("last")) | (templates >= CONTAINED))
    lines = ws.save(runs.select("doc_id", "text_key", "piece", "first", "last", F.array_distinct(F.concat("pairs", joined(3))).alias("held")).distinct(), "runs")
    # the weight table is as large as the model, whatever the corpus
    place = ("doc_id", "text_key", "piece", "first", "last")
    scored = lines.select(*place, F.explode("held").alias("gram")).join(F.broadcast(model_table(spark)), "gram")
    sums = scored.groupBy(*place).agg(*(F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(len(names))))
    logits = [(F.col(f"s{i}") + float(bias[i])) / temperature for i in range(len(names))]
    top = F.array_max(F.array(*(F.struct(z.alias("score"), F.lit(-i).alias("minus")) for i, z in enumerate(logits))))
    total = sum((F.exp(z - F.greatest(*logits)) for z in logits[1:]), F.exp(logits[0] - F.greatest(*logits)))
    other = F.exp(logits[0] - F.greatest(*logits)) / total
    every = ws.save(sums.select(*place, top.alias("top"), (1 / total).alias("p"), (1 - other).alias("licence")), "judged")
    judged = every.filter((F.col("p") >= threshold) & (F.col("top.minus") < 0))
    judged = judged.withColumn("family", F.element_at(F.array(*map(F.lit, names)), 1 - F.col("top.minus")))

    def by_family(of):
        return F.coalesce(*(F.when(F.col("family") == f, most([share("held", of(t)) for t in ts])) for f, ts in NOTICES.items()))

    keys = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"]) & (a["piece"] == b["piece"]) & (a["first"] == b["first"]) & (a["last"] == b["last"])
    confirmed = judged.join(lines, keys(judged, lines)).select(*(judged[c] for c in place), "family", "held", "p")
    enough = lambda held, f, t: (share(held, template(t)) >= CONTAINED) & (share(held, distinctive(f, t)) >= CONTAINED)
    confirmed = confirmed.filter(F.coalesce(*(F.when(F.col("family") == f, reduce(Column.__or__, [enough("held", f, t) for t in ts])) for f, ts in NOTICES.items())))
    # of runs that overlap, the one with most of its template's pairs is the notice, then the shortest, then the first
    kind = "array<struct<worse:double,extra:int,first:int,last:int,family:string,p:double>>"
    worse = (-by_family(lambda t: {g for g in template(t) if " " in g})).alias("worse")
    ranked = confirmed.select(*place, F.struct(worse, (F.col("last") - F.col("first")).alias("extra"), "first", "last", "family", "p").alias("run"))
    ranked = ranked.groupBy("doc_id", "text_key", "piece").agg(F.array_sort(F.collect_list("run")).cast(kind).alias("runs"))
    free = lambda taken, x: ~F.exists(taken, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"]))
    notices = F.aggregate("runs", F.array().cast(kind), lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken).cast(kind))
    notices = ranked.select("doc_id", "text_key", "piece", F.explode(notices).alias("run"))
    notices = ws.save(notices.select("doc_id", "text_key", "piece", "run.first", "run.last", "run.family", "run.p"), "notices")
    # a line of its own that reads like a licence, outside of all notices
    lone = every.filter((F.col("first") == F.col("last")) & (F.col("licence") >= any_licence)).drop("top", "p").alias("a")
    covered = notices.alias("b")
    same = F.expr("a.doc_id <=> b.doc_id and a.text_key = b.text_key and a.piece = b.piece and a.first between b.first and b.last")
    unknown = lone.join(covered, same, "left_anti").select("doc_id", "text_key", F.struct("first", F.lit(UNKNOWN).alias("family"), F.round("licence", 3).alias("score")).alias("hit"))
    hits = common.stacked(notices.select("doc_id", "text_key", F.struct("first", "family", F.round("p", 3).alias("score")).alias("hit")), unknown)
    found = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("hit")).alias("found"))
    found = ws.save(found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "found"), "found")
    facts = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_paragraphs"))
    out = facts.join(found, facts["doc_id"].eqNullSafe(found["found_id"]) & (facts["text_key"] == found["found_key"]), "left")
    known = F.filter("found", lambda x: x["family"] != UNKNOWN)
    listed = lambda hits, of: F.coalesce(F.array_join(F.transform(hits, of), ","), F.lit(""))
    n = lambda hits: F.coalesce(F.size(hits), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_paragraphs", n(known).alias("n_license"), n(F.filter("found", lambda x: x["family"] == UNKNOWN)).alias("n_unknown"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ","), F.lit("")).alias("families"),
        listed("found", lambda x: F.concat_ws(":", x["first"], x["family"])).alias("places"), listed("found", lambda x: x["score"].cast("string")).alias("scores"),
    )
