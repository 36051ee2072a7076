"""Driver-side workflows: guarded states, step retries, degradation, audit rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from time import sleep
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in order, and the step policy.
INGEST = ["RECEIVED", "PARSED", "CHUNKED", "EXTRACTED", "VECTOR_STORED", "SNAPSHOT_STORED", "GRAPH_STORED", "COMPLETED"]
QA = ["QUESTION_RECEIVED", "MEMORY_LOADED", "RETRIEVAL_COMPLETED", "ANSWER_GENERATED", "COMPLETED"]
LEDGER = [("RECEIVED", "PROCESSING"), ("PROCESSING", "SUCCEEDED"), ("PROCESSING", "FAILED"), ("RECEIVED", "FAILED"), ("FAILED", "RECEIVED")]
ATTEMPTS, DELAY_S = 3, 0.2


class IllegalTransition(RuntimeError):
    pass


@dataclass
class Run:
    """One run of a workflow: a state moves along its list, or to FAILED from anywhere but the end."""

    states: list[str]
    state: str = ""
    attempts: dict[str, int] = field(default_factory=dict)
    degrade_reasons: list[str] = field(default_factory=list)
    reasoning: list[str] = field(default_factory=list)
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    ended_at: datetime | None = None

    def __post_init__(self) -> None:
        self.state = self.state or self.states[0]

    def to(self, state: str) -> None:
        nxt = self.states[self.states.index(self.state) + 1 :][:1] if self.state in self.states else []
        if state not in nxt and not (state == "FAILED" and self.state not in (self.states[-1], "FAILED")):
            raise IllegalTransition(f"{self.state} to {state}")
        self.state = state
        if state in (self.states[-1], "FAILED"):
            self.ended_at = datetime.now(timezone.utc)

    def degrade(self, reason: str) -> None:
        if reason not in self.degrade_reasons:
            self.degrade_reasons.append(reason)

    def step(self, name: str, fn: Callable[[], Any], attempts: int = ATTEMPTS, delay_s: float = DELAY_S) -> Any:
        """fn with retries; the last failure is raised."""
        for i in range(attempts):
            self.attempts[name] = self.attempts.get(name, 0) + 1
            try:
                return fn()
            except Exception:
                if i + 1 == attempts:
                    raise
                sleep(delay_s)

    def retries(self) -> dict[str, int]:
        return {k: max(n - 1, 0) for k, n in self.attempts.items()}

    def audit(self) -> dict:
        return {"state": self.state, "retry_attempts": self.retries(), "degraded": bool(self.degrade_reasons), "degrade_reasons": list(self.degrade_reasons), "started_at": self.started_at, "ended_at": self.ended_at}


def allowed_pairs(states: list[str]) -> list[tuple[str, str]]:
    return list(zip(states, states[1:])) + [(s, "FAILED") for s in states[:-1]]


def transitions(log: DataFrame, run: str, state: str, order: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(<run>, <order>, before, <state>, legal) of each run's transitions in order: a validator over audit logs.

    A run has a bounded number of states; its first row has no `before` and is legal.
    """
    w = Window.partitionBy(run).orderBy(order)
    x = log.select(run, order, state).withColumn("before", F.lag(state).over(w))
    ok = F.lit(False)
    for a, b in pairs:
        ok = ok | ((F.col("before") == a) & (F.col(state) == b))
    return x.withColumn("legal", F.col("before").isNull() | F.coalesce(ok, F.lit(False)))


def retry_counts(attempts: DataFrame, run: str, stage: str) -> DataFrame:
    """(<run>, <stage>, retries): attempts less the first."""
    return attempts.groupBy(run, stage).agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("retries"))


def merged_reasons(workflow: Column, agent: Column) -> Column:
    """Ordered distinct: those of the workflow first; nulls count as none."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(workflow, none), F.coalesce(agent, none))
