"""Problem 6: repetition inside a single document, judged by weak supervision.

One pass measures each text: the repeated share of its word runs and of its
lines, sentences, paragraphs and pages, and the share of its most frequent run.
Labelling rules turn the measures into votes (repetitive, fine, abstain).  The
corpus is reduced to the number of documents for each pattern of votes, at
most 3^6 rows whatever its size, on which expectation-maximisation estimates the
accuracy of every rule; the posterior probability of "repetitive" then replaces
the demand that all rules agree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, small_batches
from .words import chunks, hash_words, runs, strip_tags

MEASURES = ("run_share", "line_share", "sentence_share", "paragraph_share", "page_share", "top_share")


@dataclass(frozen=True)
class RepetitionRules:
    run: int = 5
    #: The share from which on a text is a case.
    share: float = 0.25
    #: A rule votes "repetitive" from the first value on, "fine" up to the second, and abstains between and without units.
    #: None of them is the share of a case, so the model is not given the answer.
    bounds: tuple[tuple[float, float], ...] = ((0.35, 0.12), (0.30, 0.05), (0.30, 0.05), (0.30, 0.02), (0.34, 0.0), (0.02, 0.004))
    rounds: int = 100


_SENTENCES = re.compile(r"(?<=[.!?。！？])\s+|\n")
_PARAGRAPHS = re.compile(r"\n\s*\n|</(?:p|li|div|pre|table|footer|section)>")
_PAGES = re.compile(r"\n\n---\n\n|\f|</section>")


def _unit_share(units: list[str], least: int) -> float | None:
    """Share of the characters of units that were there before; None with fewer than two units."""
    kept = [u for u in (" ".join(x.split()).lower() for x in units) if len(u) >= least]
    if len(kept) < 2:
        return None
    seen: set[str] = set()
    again = 0
    for u in kept:
        if u in seen:
            again += len(u)
        else:
            seen.add(u)
    return again / sum(map(len, kept))


def measures(text: str, words: np.ndarray, n: int) -> tuple:
    """(runs, repeated runs, run_share, line, sentence, paragraph, page and top share); None where there is nothing to measure."""
    r = runs(words, n)
    _, count = np.unique(r, return_counts=True)
    total, again = len(r), int(len(r) - len(count))
    text = text.replace("\r\n", "\n")
    plain = strip_tags(text)
    return (
        total,
        again,
        again / total if total else None,
        _unit_share(plain.split("\n"), 10),
        _unit_share(_SENTENCES.split(plain), 10),
        _unit_share([strip_tags(x) for x in _PARAGRAPHS.split(text)], 20),
        _unit_share([strip_tags(x) for x in _PAGES.split(text)], 20),
        (int(count.max()) - 1) / total if total > 20 else None,
    )


def _measure_batches(rules: RepetitionRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), []
            for a, b in chunks(texts):
                words, at = hash_words(texts[a:b])
                rows += [measures(texts[a + k], words[at[k] : at[k + 1]], rules.run) for k in range(b - a)]
            columns = list(zip(*rows)) if rows else [[]] * (2 + len(MEASURES))
            types = [pa.int64(), pa.int64(), *[pa.float64()] * len(MEASURES)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, types))], ["key", "runs", "repeated_runs", *MEASURES]
            )

    return run


def measured(docs: DataFrame, key: str, text: str, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """(key, runs, repeated_runs, the MEASURES, vote_0 ...) of every text; votes are 1, 0 or -1 for abstaining."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    schema = "key string, runs long, repeated_runs long, " + ", ".join(f"{m} double" for m in MEASURES)
    rows = own.mapInArrow(_measure_batches(rules), schema).distinct()
    votes = {
        f"vote_{k}": F.when(F.col(m) >= high, 1).when(F.col(m) <= low, 0).otherwise(-1)
        for k, (m, (high, low)) in enumerate(zip(MEASURES, rules.bounds))
    }
    return rows.withColumns(votes)


def label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior probability of "repetitive" for each pattern of votes, by EM on two latent classes.

    Rules are independent given the class; an abstention is no evidence.  The start assumes that a rule is right in
    0.8 of its votes.  A pattern of abstentions only has the prior.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    k = votes.shape[1]
    yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
    prior, hit, false = 0.1, np.full(k, 0.8), np.full(k, 0.2)
    post = np.zeros(len(votes))
    for _ in range(rounds):
        a = np.log(prior) + yes @ np.log(hit) + no @ np.log(1 - hit)
        b = np.log(1 - prior) + yes @ np.log(false) + no @ np.log(1 - false)
        new = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        w1, w0 = weight * new, weight * (1 - new)
        prior = float(np.clip((w1.sum() + 1) / (weight.sum() + 10), 1e-4, 0.5))
        hit = np.clip((w1 @ yes + 4) / (w1 @ (yes + no) + 5), 0.5, 0.999)  # a rule is better than chance
        false = np.clip((w0 @ yes + 1) / (w0 @ (yes + no) + 5), 0.001, 0.5)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {p: float(x) for (p, _), x in zip(patterns, new)}


def judged(docs: DataFrame, key: str, text: str, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """measured() with the posterior, is_candidate and is_case: whether the repeated share of the text reaches the wanted one.

    A candidate is likely repetitive by the posterior, or undecided by it: then the rule on the share itself did not vote
    "fine".  An exact check of the share of the candidates gives the cases, so none is lost as long as the wanted share is above
    the bound of that vote.  A text with fewer words than a run is no case.  NULL texts are left out; a row that is given twice counts once.
    """
    rows = checkpointed(measured(docs, key, text, rules))
    names = [f"vote_{k}" for k in range(len(MEASURES))]
    counts = rows.groupBy(*names).count().collect()  # at most 3^6 rows
    model = label_model([(tuple(r[n] for n in names), r["count"]) for r in counts], rules.rounds)
    spark = docs.sparkSession
    schema = ", ".join(f"{n} int" for n in names) + ", posterior double"
    table = spark.createDataFrame([(*p, x) for p, x in model.items()], schema)
    case = (F.col("runs") > 0) & (F.col("repeated_runs") >= F.lit(rules.share) * F.col("runs"))
    return rows.join(F.broadcast(table), names).withColumn("is_candidate", (F.col("posterior") >= 0.5) | (F.col("vote_0") != 0)).withColumn("is_case", case).drop(*names)
