"""Quality rules: text statistics, and decision lists learned from labelled statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII white space, and the characters that count as symbols.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = b".!?:;,"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_text_lines", "n_digits", "n_upper", "n_stops", "n_distinct", "longest_word")
#: Rates that rules may test, as Spark SQL over the counts; every divisor is at least 1.
RATES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_text_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "digit_rate": "n_digits / greatest(n_chars, 1)",
    "upper_rate": "n_upper / greatest(n_chars, 1)",
    "stop_rate": "n_stops / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_text_lines, 1)",
    "words": "cast(n_words as double)",
    "longest_word": "cast(longest_word as double)",
}
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS; a null text has none of anything."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    chars = len(text or "")
    lines = raw.split(b"\n")
    with_word = [line for line in lines if line.strip()]
    n = len(words)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    repeated = 0
    if n >= 4 and len(number) < n:
        at = np.array(ids, np.int64)
        _, pair = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1].astype(np.int64) * len(number) + at[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        if twice.any():
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= twice
            repeated = int(inside.sum())
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (n, chars - less(SPACE), less(SYMBOLS), len(with_word) - len(set(with_word)), repeated, chars, len(lines), len(with_word), less(DIGITS), less(UPPER), less(STOPS), len(number), max(map(len, words), default=0))


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document, whole texts; null and empty texts count 0 (and one empty line)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *COUNTS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, STATS)


def with_rates(stats: DataFrame) -> DataFrame:
    """The counts and, as columns r_<name>, the rates."""
    return stats.withColumns({f"r_{name}": F.expr(sql).cast("double") for name, sql in RATES.items()})


@dataclass
class Rule:
    """A conjunction of thresholds: (rate, '<=' or '>', value)."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    precision: float = 0.0
    covered: int = 0

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for name, op, value in self.conditions:
            ok &= (x[name].to_numpy() <= value) if op == "<=" else (x[name].to_numpy() > value)
        return ok

    def sql(self, prefix: str = "r_") -> str:
        return " AND ".join(f"{prefix}{name} {op} {value!r}D" for name, op, value in self.conditions)


def learn(x: pd.DataFrame, bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_covered: int = 5, min_precision: float = 0.7, cuts: int = 64, seed: int = 5) -> list[Rule]:
    """A decision list for `bad` by sequential covering.

    Two thirds of the rows grow a rule, condition by condition, by information gain over cut points
    at quantiles; the last third prunes its final conditions for (p - n) / (p + n) and must confirm
    the precision. Rows that a rule covers leave before the next is grown.
    """
    rng = np.random.default_rng(seed)
    names = list(x.columns)
    points = {c: np.unique(np.quantile(x[c].to_numpy(), np.linspace(0, 1, cuts + 1))) if len(x) else np.array([]) for c in names}
    for c in names:  # cut between neighbouring values, not on them
        points[c] = (points[c][:-1] + points[c][1:]) / 2
    left = np.arange(len(x))
    rules: list[Rule] = []
    while len(rules) < max_rules and bad[left].sum() >= min_covered:
        left = rng.permutation(left)
        grow, prune = left[: 2 * len(left) // 3], left[2 * len(left) // 3 :]
        gx, gy, rule = x.iloc[grow], bad[grow], Rule()
        inside = np.ones(len(grow), bool)
        while len(rule.conditions) < max_conditions and (~gy[inside]).any():
            p0, n0 = gy[inside].sum(), inside.sum()
            best = (1e-9, None)
            for c in names:
                values = gx[c].to_numpy()[inside]
                order = np.argsort(values, kind="stable")
                cum = np.concatenate([[0], np.cumsum(gy[inside][order])])
                at = np.searchsorted(values[order], points[c], "right")
                for op, p, n in (("<=", cum[at], at), (">", p0 - cum[at], n0 - at)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= min_covered, p * (np.log2(p / np.maximum(n, 1)) - np.log2(max(p0, 1) / n0)), -1)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (c, op, float(points[c][gain.argmax()])))
            if best[1] is None:
                break
            rule.conditions.append(best[1])
            inside &= Rule([best[1]]).holds(gx)
        if not rule.conditions:
            break
        px, py, worth = x.iloc[prune], bad[prune], []
        for k in range(1, len(rule.conditions) + 1):
            hit = Rule(rule.conditions[:k]).holds(px)
            worth.append((2 * py[hit].sum() - hit.sum()) / max(hit.sum(), 1))
        rule.conditions = rule.conditions[: int(np.argmax(worth)) + 1]
        hit = rule.holds(x.iloc[left])
        rule.covered, rule.precision = int(hit.sum()), float(bad[left][hit].mean()) if hit.any() else 0.0
        confirmed = rule.holds(px)
        if rule.precision < min_precision or confirmed.any() and py[confirmed].mean() < min_precision - 0.1:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def as_case(rules: list[Rule]) -> str:
    """The list as one ordered Spark conditional: the first rule that holds rejects, else the document is kept."""
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END" if rules else "true"


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12000, seed: int = 5) -> list[Rule]:
    """Learn the list from at most `max_rows` labelled documents, those with the least seeded hash of their id.

    Labels that are null, or whose document is absent, teach nothing; of repeated ids the least label
    holds. Only the sampled documents' rates come to the driver.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"))
    sample = marked.orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("i"), "left_semi")
    rates = [f"r_{name}" for name in RATES]
    rows = with_rates(statistics(texts)).join(F.broadcast(sample), F.col("doc_id") == F.col("i")).select("doc_id", "y", *rates).toPandas().sort_values(["doc_id", *rates])
    x = rows[rates].rename(columns=lambda c: c.removeprefix("r_")).reset_index(drop=True)
    return learn(x, (rows["y"] == 0).to_numpy())


#: The base rules: fewer than 50 words, or over half of the words in repeated three-word windows.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, rates, base_failed and kept of each document; kept is false where the base rules fail, else the list's verdict.

    Null and empty texts fail the base rules; a null id stays null; repeated rows are judged alike.
    """
    judged = with_rates(statistics(docs, id_col=id_col, text_col=text_col)).withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & F.expr(as_case(rules)))
