"""The enrichment queue: pure state transitions, batch replay, and a stateful stream with the same function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "ref_id string, status string, attempts int, strategy_level int, difficulty int, priority double, completeness_before double, last_error string"


def fresh(completeness: float = 0.0, priority: float = 1.0, level: int = 0) -> dict:
    return {"status": "pending", "attempts": 0, "strategy_level": level, "difficulty": 0, "priority": priority, "completeness_before": completeness, "last_error": None}


def enqueue(state: dict | None, priority: float, difficulty: int, level: int, completeness: float) -> dict:
    """A new entry, a resurrected one (done becomes pending, attempts 0), or the old one at the higher priority."""
    if state is None:
        return fresh(completeness, priority, level) | {"difficulty": difficulty}
    if state["status"] == "done":
        return state | {"status": "pending", "attempts": 0, "priority": priority, "strategy_level": level, "last_error": "taken up again"}
    return state | {"priority": max(state["priority"], priority)}


#: Outcomes of an attempt in the order they are looked at: name, condition, what it changes. x holds the state, the
#: completeness reached (now), the error, and the attempts made with this one (tries).
_OUTCOMES = (
    ("wait", lambda x: (x["error"] or "").startswith("cooldown"), lambda x: {"status": "pending", "last_error": x["error"]}),
    ("reached", lambda x: x["now"] >= 0.8 or x["now"] - x["completeness_before"] > 0.05, lambda x: {"status": "done", "attempts": x["tries"], "last_error": None}),
    ("given up", lambda x: x["strategy_level"] > 3, lambda x: {"status": "done", "attempts": x["tries"], "last_error": "given up: every strategy was tried"}),
    ("set aside", lambda x: x["tries"] > 2, lambda x: {"status": "done", "attempts": x["tries"], "strategy_level": 4, "last_error": "set aside: left to the last strategy"}),
    ("harder", lambda x: True, lambda x: {
        "status": "pending", "attempts": x["tries"], "strategy_level": x["strategy_level"] + 1, "difficulty": min(3, x["strategy_level"] + 1),
        "priority": round(max(0.0, 1.0 - x["now"]) * max(0.1, 1.0 / (1 + x["tries"])), 3), "last_error": x["error"],
    }),
)


def outcome(state: dict, completeness: float, error: str | None = None) -> tuple[str, dict]:
    """Name of an attempt's outcome and the state after it."""
    x = state | {"now": completeness, "error": error, "tries": state["attempts"] + 1}
    name, changes = next((name, changes) for name, holds, changes in _OUTCOMES if holds(x))
    return name, state | changes(x)


def complete(state: dict, completeness: float, error: str | None = None) -> dict:
    """The state after one attempt."""
    return outcome(state, completeness, error)[1]


def _fold(key: str, pdf: pd.DataFrame, state: dict | None) -> dict:
    for c, e in zip(pdf["completeness"], pdf["error"]):
        if state is None:
            state = fresh(0.0)
        elif state["status"] == "done":
            state = enqueue(state, 1.0, 0, 0, state["completeness_before"])
        state = complete(state, float(c) if c == c and c is not None else 0.0, e if isinstance(e, str) else None)
    return state


def replay(events: DataFrame) -> DataFrame:
    """events(ref_id, ts, event_id, completeness, error) -> the state of every entry after all its attempts in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        key = pdf["ref_id"].iloc[0]
        return pd.DataFrame([{"ref_id": key} | _fold(key, pdf, None)])

    return events.groupBy("ref_id").applyInPandas(run, STATE)


def stream(events: DataFrame) -> DataFrame:
    """The same transitions over a stream of attempts; state is kept per entry, and each batch's changes come out."""
    columns = [c.split()[0] for c in STATE.split(", ")]

    def run(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = dict(zip(columns[1:], held.get)) if held.exists else None
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        state = _fold(key[0], pdf, state)
        held.update(tuple(state[c] for c in columns[1:]))
        yield pd.DataFrame([{"ref_id": key[0]} | state])

    return events.groupBy("ref_id").applyInPandasWithState(run, STATE, STATE.split(", ", 1)[1], "update", "NoTimeout")


def tier_predicates() -> dict[int, str]:
    """Which queued records a tier takes, by strategy level and what is known of them."""
    ids = "(coalesce(doi, '') <> '' OR coalesce(pmid, '') <> '' OR coalesce(arxiv_id, '') <> '' OR coalesce(isbn, '') <> '')"
    return {
        1: f"strategy_level <= 3 AND {ids}", 2: f"strategy_level <= 3 AND NOT {ids} AND coalesce(url, '') <> ''", 3: f"strategy_level <= 3 AND NOT {ids} AND coalesce(url, '') = '' AND year IS NOT NULL",
        4: f"strategy_level <= 3 AND NOT {ids} AND coalesce(url, '') = '' AND year IS NULL", 5: "strategy_level >= 4",
    }


def dequeue(queue: DataFrame, refs: DataFrame, tier: int, n: int, skip: DataFrame | None = None) -> DataFrame:
    """The n most urgent pending entries of a tier: nearly complete records (0.6 to 0.8) first, then by priority."""
    q = queue.filter("status = 'pending'").join(refs.select(F.col("id").alias("ref_id"), "doi", "pmid", "arxiv_id", "isbn", "url", "year"), "ref_id").filter(tier_predicates()[tier])
    if skip is not None:
        q = q.join(skip.select("ref_id"), "ref_id", "left_anti")
    near = F.when(F.col("completeness_before").between(0.6, 0.8), 0).otherwise(1)
    return q.orderBy(near, F.desc("priority"), "ref_id").limit(n).select(queue.columns)


def reset_stale(queue: DataFrame, as_of, minutes: int = 10) -> DataFrame:
    """Active entries whose last attempt is older become pending again."""
    stale = (F.col("status") == "active") & (F.col("last_attempt") < F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(minutes)))
    return queue.withColumn("status", F.when(F.coalesce(stale, F.lit(False)), "pending").otherwise(F.col("status")))


def route_result(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, level: what an attempt gained sends a record on: identifier 0, address 1, metadata 2, junk title parked at 4."""
    from codexlake.functions.scalar import junk_reason

    b = before.select("id", *[F.col(c).alias(f"b_{c}") for c in ("doi", "pmid", "arxiv_id", "isbn", "url", "year", "journal")])
    x = after.join(b, "id")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    gained = lambda *cs: sum((F.when(none(f"b_{c}") & ~none(c), 1).otherwise(0) for c in cs), F.lit(0)) > 0
    level = F.when(gained("doi", "pmid", "arxiv_id", "isbn"), 0).when(gained("url"), 1).when(gained("year", "journal"), 2).when(junk_reason(F.col("title")).isNotNull(), 4).otherwise(3)
    return x.select("id", level.alias("level"))
