"""Admission of calls under quotas, as a stateful stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MINUTE = 60_000_000


class Quota:
    """Decisions of one scope in the order in which its calls come: at most ``rpm`` calls and ``tpm``
    tokens in any trailing minute, ``rpd`` calls and ``tpd`` tokens in a day of ``zone``, and ``spacing``
    microseconds between admitted calls. Only admitted calls count. Holds at most ``rpm`` calls."""

    def __init__(self, rpm: int, tpm: int, rpd: int, tpd: int, spacing: int, zone: str) -> None:
        self.rpm, self.tpm, self.rpd, self.tpd, self.spacing, self.zone = rpm, tpm, rpd, tpd, spacing, ZoneInfo(zone)
        self.recent: deque[tuple[int, int]] = deque()
        self.day, self.calls, self.used, self.last = "", 0, 0, None

    def decide(self, at: int, tokens: int) -> str | None:
        """Why the call is refused, or None. A call earlier than the last admitted one is taken at
        the time of that one."""
        if self.last is not None:
            at = max(at, self.last)
        day = datetime.fromtimestamp(at / 1e6, timezone.utc).astimezone(self.zone).date().isoformat()
        if day != self.day:
            self.day, self.calls, self.used = day, 0, 0
        while self.recent and self.recent[0][0] <= at - MINUTE:
            self.recent.popleft()
        if tokens > self.tpm or tokens > self.tpd:
            return "larger_than_quota"
        if self.calls + 1 > self.rpd:
            return "requests_a_day"
        if self.used + tokens > self.tpd:
            return "tokens_a_day"
        if len(self.recent) + 1 > self.rpm:
            return "requests_a_minute"
        if sum(n for _, n in self.recent) + tokens > self.tpm:
            return "tokens_a_minute"
        if self.last is not None and at - self.last < self.spacing:
            return "spacing"
        self.recent.append((at, tokens))
        self.calls, self.used, self.last = self.calls + 1, self.used + tokens, at
        return None

    def dump(self) -> tuple:
        return ([a for a, _ in self.recent], [n for _, n in self.recent], self.day, self.calls, self.used, -1 if self.last is None else self.last)

    def load(self, state: tuple) -> None:
        at, tokens, self.day, self.calls, self.used, last = state
        self.recent, self.last = deque(zip(at, tokens)), None if last < 0 else last


def admissions(calls: DataFrame, rpm: int, tpm: int, rpd: int, tpd: int, spacing: int = 0, zone: str = "UTC") -> DataFrame:
    """``(scope, call, at, reason)`` for a stream ``(scope, call, at, tokens)`` of calls, ``at`` in
    microseconds: reason is NULL for admitted ones. Calls of a batch are decided by time, then name;
    a NULL time or scope is refused as ``invalid``, NULL tokens count 0. One scope's calls are decided
    one after another, as each decision depends on those before."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q = Quota(rpm, tpm, rpd, tpd, spacing, zone)
        if state.exists:
            q.load(state.get)
        rows = sorted((r for pdf in batches for r in zip(pdf["at"], pdf["call"].fillna(""), pdf["tokens"].fillna(0))), key=lambda r: (r[0] if r[0] == r[0] else -1, r[1]))
        out = [(key[0], call, None, "invalid") if at != at or key[0] is None else (key[0], call, int(at), q.decide(int(at), int(tokens))) for at, call, tokens in rows]
        state.update(q.dump())
        yield pd.DataFrame(out, columns=["scope", "call", "at", "reason"]).astype({"at": "Int64"})

    held = "at array<long>, tokens array<long>, day string, calls long, used long, last long"
    return calls.groupBy("scope").applyInPandasWithState(step, "scope string, call string, at long, reason string", held, "append", GroupStateTimeout.NoTimeout)
