"""Quality rules as a short-circuit cascade.

Each rule rejects a text by some statistics of it. On a sample the operator
measures what each statistic costs and which texts each rule rejects, then
orders the rules greedily by rejection per cost: the cost of a rule is that of
the statistics not yet computed, its rejection counts texts that still pass.
A text meets the rules in that order until one rejects it.

The order changes the speed, never the verdict, so a small sample is enough
(``SAMPLE_ROWS`` texts of at most ``SAMPLE_BYTES`` bytes).

Rules: null text is empty and fails the base rules; repeated rows get equal
verdicts; null ids are kept as they are; an empty input gives no rows; all
columns of the input pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.doc_stats import LETTER, UPPER, DocStats
from logloom.llm.frames import as_bytes, batched, doc_table, only

SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 16
# Cost in seconds of comparing statistics that are there already.
BARE_COST = 2e-7


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[DocStats], bool]


BASE_RULES = (
    Rule("too_few_words", ("words",), lambda d: d.n_words < 50),
    Rule("repeated_windows", ("words", "word_ids", "n_repeat_words"), lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
RULES = BASE_RULES + (
    Rule("symbols", ("words", "n_symbols"), lambda d: d.n_symbols > 0.1 * d.n_words),
    Rule("shouting_marks", ("words",), lambda d: d.data.count(b"!") > 0.2 * d.n_words),
    Rule("upper_case", ("byte_counts",), lambda d: d.share(UPPER, LETTER) > 0.5),
    Rule("repeated_lines", ("lines", "n_dup_lines"), lambda d: d.n_dup_lines > 0.4 * len(d.lines)),
    Rule("one_word", ("words", "word_ids", "top_word_share"), lambda d: d.top_word_share > 0.25),
    Rule("word_length", ("words", "text", "word_chars"), lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("ellipses", ("lines",), lambda d: sum(x.rstrip().endswith((b"...", "…".encode())) for x in d.lines) > 0.3 * len(d.lines)),
    Rule("bullets", ("lines",), lambda d: sum(x.lstrip().startswith((b"- ", b"* ", "•".encode())) for x in d.lines) > 0.9 * len(d.lines)),
)


def measured(texts: list[bytes], rules: tuple[Rule, ...]) -> tuple[dict[str, float], np.ndarray]:
    """Mean seconds of each statistic, and per rule and text whether it rejects."""
    cost: dict[str, float] = {}
    docs = [DocStats(t) for t in texts]
    for name in dict.fromkeys(n for rule in rules for n in rule.needs):  # a statistic's own needs stand before it
        began = time.perf_counter()
        for d in docs:
            getattr(d, name)
        cost[name] = (time.perf_counter() - began) / max(1, len(docs))
    return cost, np.array([[rule.rejects(d) for d in docs] for rule in rules], bool).reshape(len(rules), len(docs))


def ordered(rules: tuple[Rule, ...], cost: dict[str, float], rejected: np.ndarray) -> tuple[Rule, ...]:
    """Greedy order by rejection per cost."""
    alive, have, left, out = np.ones(rejected.shape[1], bool), set(), list(range(len(rules))), []
    while left:
        price = {i: BARE_COST + sum(cost[n] for n in rules[i].needs if n not in have) for i in left}
        best = max(left, key=lambda i: ((rejected[i] & alive).sum() / price[i], -price[i]))
        left.remove(best)
        have.update(rules[best].needs)
        alive &= ~rejected[best]
        out.append(rules[best])
    return tuple(out)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in the order that a sample suggests."""
    sample = docs.select(docs[text_col].cast("string").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_rows).collect()
    return ordered(rules, *measured([r.text.encode() for r in sample], rules))


def first_rejection(doc: DocStats, rules: tuple[Rule, ...]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(doc)), None)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept."""
    order = cascade(docs, rules, text_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(DocStats(t), order) is None for t in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed`` and ``kept``.

    The base statistics are computed for every text, since they are returned;
    the other rules run as a cascade on the texts that pass the base rules.
    """
    base = {r.name for r in BASE_RULES}
    order = tuple(r for r in cascade(docs, rules) if r.name not in base)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch["doc_id"]} | {n: [] for n in (*names, "base_failed", "kept")}
        for data in as_bytes(batch["text"]):
            doc = DocStats(data)
            for n in names:
                out[n].append(getattr(doc, n))
            failed = first_rejection(doc, BASE_RULES) is not None
            out["base_failed"].append(failed)
            out["kept"].append(not failed and first_rejection(doc, order) is None)
        return out

    return batched(doc_table(docs), judge, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean")
