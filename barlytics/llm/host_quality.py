"""Quality rules with host verdicts.

Each text is measured and judged by its own rules. Failures are summed by host, the
hosts' rates are shrunk towards a beta prior fitted to all hosts, and a host whose
shrunk rate is above ``max_host_rate`` is rejected with all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlytics.llm.tables import SLICE, free, holds, release, stored, strings

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [m.split()[0] for m in MEASURES.split(", ")]
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window that must not repeat.
WINDOW = 8

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows that stand in the text twice or more, the first included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        sums += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    order = np.sort(sums)
    if not (order[1:] == order[:-1]).any():
        return 0  # equal windows have equal sums
    rank, width = ids.astype(np.int64), 1
    while width < WINDOW:
        m = len(rank) - width
        rank = np.unique(rank[:m] * (len(ids) + 1) + rank[width : width + m], return_inverse=True)[1]
        width *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids) if len(seen) < len(words) else 0,
    )


def _measure(texts: pa.Array) -> pa.Array:
    holds("host_quality", list)  # nothing of its own; what earlier operators remember goes
    release()
    rows = [measure_text(t) for i in range(0, len(texts), SLICE) for t in strings(texts.slice(i, SLICE))]
    columns = list(zip(*rows)) if rows else [[]] * len(NAMES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def measures(text: Column) -> Column:
    """The measures of a text as a struct; a null text has no words."""
    return F.arrow_udf(_measure, MEASURES).asNondeterministic()(text.cast("string"))


def failed(m: str = "") -> Column:
    """The document's own rules: too few words, or over 30 % of them in repeated windows."""
    return (F.col(f"{m}n_words") < 20) | (100 * F.col(f"{m}n_repeat_words") > 30 * F.col(f"{m}n_words"))


def host_rates(judged: DataFrame, host: str, base_failed: str) -> DataFrame:
    """host, n, n_failed, shrunk: rates shrunk to the beta prior of all hosts.

    The prior has the pooled rate as its mean; its weight follows from the spread of
    the hosts' rates beyond what their numbers of documents explain. A null host is no
    host and has no row.
    """
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(base_failed).cast("long")).alias("n_failed")
    )
    hosts = stored(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n")
    total = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum("n_failed").alias("bad"),
        F.sum(F.col("n_failed") * rate).alias("squares"),  # n times the squared rate
    ).first()
    if not total["docs"]:
        return hosts.withColumn("shrunk", F.lit(0.0))
    mean = total["bad"] / total["docs"]
    spread = max(total["squares"] / total["docs"] - mean * mean, 0.0) - mean * (1 - mean) * total["hosts"] / total["docs"]
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return hosts.withColumn("shrunk", (F.col("n_failed") + mean * weight) / (F.col("n") + weight))


def rejected_hosts(rates: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """Hosts to reject, as a stored table, so that the planner knows its size."""
    return stored(rates.filter(F.col("shrunk") > max_host_rate).select("host"), "bad-hosts")


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """doc_id, measures, base_failed, host_rejected, kept of each row of ``docs``.

    Null texts have no words and fail; documents without host are judged by their own
    rules alone; repeated rows are judged row by row and count as often in their host.
    """
    rows = docs.select("doc_id", F.col(host).alias("__host"), measures(F.col("text")).alias("m"))
    rows = stored(rows.select("doc_id", "__host", "m.*").withColumn("base_failed", failed()), "measured")
    bad = rejected_hosts(host_rates(rows, "__host", "base_failed"), max_host_rate)
    rows = rows.join(bad.withColumn("host_rejected", F.lit(True)), rows["__host"] == bad["host"], "left")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return rows.select("doc_id", *NAMES, "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def keep(docs: DataFrame, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Null and empty texts fail by their own rules; rows with a null host are judged by those alone.
    """
    m, bad_text = free("__m", docs.columns), free("__failed", docs.columns)
    measured = docs.withColumn(m, measures(F.col("text"))).withColumn(bad_text, failed(f"{m}."))
    bad = rejected_hosts(host_rates(measured.select(F.col(host).alias("__host"), F.col(bad_text).alias("__failed")), "__host", "__failed"), max_host_rate)
    good = measured.filter(~F.col(bad_text)).drop(m, bad_text)
    return good.join(bad.withColumnRenamed("host", m), good[host] == F.col(m), "left_anti")
