"""Requests for the same work, as one: what asks for a repository again while its work waits is served with it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WORK = "repo_key string, first_at timestamp, last_at timestamp, requests long"


def coalesced(requests: DataFrame, delay_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """repo_key, first_at, last_at, requests: one row for all requests of a repository from one on until ``delay_seconds`` after it.

    requests: a stream of repo_key, requested_at. Only the open work of a repository is state: two times and a count, however many requests there are. Work comes out
    when the watermark has passed its delay, or when a request after that opens the next one. Requests behind the watermark are dropped; null
    keys are one repository; null times are left out.
    """
    delay = pd.Timedelta(seconds=delay_seconds)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        open_ = None
        if state.exists:
            first, last, n = state.get
            open_ = (pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n)
        if state.hasTimedOut:
            done.append((*key, *open_))
            open_ = None
            state.remove()
        else:
            times = sorted(t for b in batches for t in b["requested_at"])
            for t in times:
                if open_ is not None and t < open_[0]:  # an earlier one came later: the work began with it
                    open_ = (t, open_[1], open_[2] + 1)
                elif open_ is not None and t < open_[0] + delay:
                    open_ = (open_[0], max(t, open_[1]), open_[2] + 1)
                else:
                    if open_ is not None:
                        done.append((*key, *open_))
                    open_ = (t, t, 1)
            if open_ is not None:
                state.update((open_[0].value // 1000, open_[1].value // 1000, open_[2]))
                # No time before the watermark can be waited for.
                state.setTimeoutTimestamp(max((open_[0] + delay).value // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["repo_key", "first_at", "last_at", "requests"])

    rows = requests.select("repo_key", "requested_at").filter(F.col("requested_at").isNotNull()).withWatermark("requested_at", late)
    return rows.groupBy("repo_key").applyInPandasWithState(run, WORK, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
