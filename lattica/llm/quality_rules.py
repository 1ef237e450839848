"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a document, with the statistics that it needs first) and
selectivity (share of documents it rejects) are estimated on a sample, and the
rules then run in order of rejection per cost; a document that a rule rejects is
not measured again. The order changes the cost only: a document is kept if no rule
rejects it. So each task draws its own sample from the rows that it has anyway:
nothing is read twice, and no sample travels.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .textblocks import chunks, column_bytes
from .textstats import Measures


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the statistics of ``group`` and says which texts fail."""

    name: str
    group: str
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


#: The base rules come first here, but the cascade orders all of them anew.
BASE_RULES = (
    Rule("few_words", "words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", "words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "bytes", lambda m: 20 * m["symbol"] > m["word_chars"]),
    Rule("shouting", "bytes", lambda m: 10 * m["upper"] > 3 * (m["upper"] + m["lower"])),
    Rule("exclaiming", "bytes", lambda m: 25 * m["exclaim"] > m["word_chars"]),
    Rule("digits", "bytes", lambda m: 2 * m["digit"] > m["word_chars"]),
    Rule("repeated_lines", "lines", lambda m: 10 * m["n_dup_lines"] > 4 * m["n_lines"]),
    Rule("letterless", "letters", lambda m: 2 * m["letterless"] > m["words"]),
    Rule("one_word", "top", lambda m: 10 * m["top"] > 4 * m["words"]),
    Rule("lists", "marks", lambda m: (m["lines"] >= 5) & (10 * m["listed"] > 9 * m["lines"])),
    Rule("cut_lines", "marks", lambda m: (m["lines"] >= 5) & (10 * m["cut_short"] > 4 * m["lines"])),
)
#: Statistics that the base counts need for every document.
BASE_GROUPS = ("bytes", "words", "lines")
SAMPLE_DOCS = 64


def cascade(texts: list[bytes], rules: tuple[Rule, ...], order: list[int], measures: Measures | None = None) -> np.ndarray:
    """Which texts pass all rules, tried in ``order`` on those still passing."""
    m = measures or Measures(texts)
    rows = np.arange(len(texts))
    for k in order:
        if not len(rows):
            break
        rows = rows[~rules[k].rejects(m.get(rules[k].group, rows))]
    kept = np.zeros(len(texts), bool)
    kept[rows] = True
    return kept


def plan(texts: list[bytes], rules: tuple[Rule, ...] = RULES, made: tuple[str, ...] = (), sample: int = SAMPLE_DOCS) -> list[int]:
    """Order of the rules by rejection per cost, from a sample drawn evenly from ``texts``.

    The next rule is the one that rejects most of what is left for its cost. A
    group of statistics is paid for by the first rule that needs it; those in
    ``made`` are there already.
    """
    if not texts:
        return list(range(len(rules)))
    rows = np.unique(np.linspace(0, len(texts) - 1, min(sample, len(texts))).astype(np.int64))
    picked = [texts[i] for i in rows.tolist()]
    everyone, group_cost, rule_cost, fails = np.arange(len(picked)), {}, [], []
    m = Measures(picked)
    for rule in rules:
        began = time.perf_counter()
        got = m.get(rule.group, everyone)
        if rule.group not in group_cost:
            group_cost[rule.group] = time.perf_counter() - began
        began = time.perf_counter()
        fails.append(rule.rejects(got))
        rule_cost.append(time.perf_counter() - began)
    order, left, paid = [], np.ones(len(picked), bool), set(made)
    while len(order) < len(rules):
        worth = {k: ((fails[k] & left).sum() + 0.5) / max(1e-9, rule_cost[k] + group_cost[rules[k].group] * (rules[k].group not in paid)) for k in range(len(rules)) if k not in order}
        best = max(worth, key=lambda k: (worth[k], -k))
        order.append(best)
        left &= ~fails[best]
        paid.add(rules[best].group)
    return order


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: the base counts, whether the base rules fail it, and whether it is kept.

    The base counts are made for every document; the cascade runs on those that
    the base rules pass, and makes further statistics only for what is left.
    Null text has no words and is rejected. Rows stand alone, so ties, repeated
    ids and rows, and further columns of ``docs`` change nothing; very long texts
    are measured whole, one at a time; an empty table gives no rows.
    """
    runtime.prepare(docs.sparkSession)
    rest = tuple(r for r in rules if r not in BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: list[int] = []
        for batch in batches:
            texts = column_bytes(batch.column("text"))
            if not order and texts:
                order = plan(texts, rest, BASE_GROUPS)
            for first, part in chunks(texts):
                m, rows = Measures(part), np.arange(len(part))
                b, w, li = m.get("bytes", rows), m.get("words", rows), m.get("lines", rows)
                failed = np.logical_or.reduce([r.rejects(w) for r in BASE_RULES])
                kept = ~failed
                passing = _Rows(m, np.flatnonzero(kept))
                kept[kept] = cascade(passing.texts, rest, order, passing)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, len(part)),
                    "n_words": pa.array(w["n_words"], pa.int64()), "word_chars": pa.array(b["word_chars"], pa.int64()),
                    "n_symbols": pa.array(b["symbol"], pa.int64()), "n_dup_lines": pa.array(li["n_dup_lines"], pa.int64()),
                    "n_repeat_words": pa.array(w["n_repeat_words"], pa.int64()), "base_failed": failed, "kept": kept,
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(runtime.trimmed(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


class _Rows(Measures):
    """Some rows of measured texts, numbered anew."""

    def __init__(self, whole: Measures, rows: np.ndarray):
        self.whole, self.rows, self.texts = whole, rows, [whole.texts[i] for i in rows.tolist()]

    def get(self, group: str, rows: np.ndarray) -> dict[str, np.ndarray]:
        return self.whole.get(group, self.rows[rows])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns (null text: rejected)."""
    runtime.prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: list[int] = []
        for batch in batches:
            texts = column_bytes(batch.column(at))
            if not order and texts:
                order = plan(texts, rules)
            kept = [cascade(part, rules, order) for _, part in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.empty(0, bool)))

    return docs.mapInArrow(runtime.trimmed(run), docs.schema)
