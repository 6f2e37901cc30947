"""Delivery with retries on a stream: what waits for its next attempt waits in state and holds no task.

Each pair of alert and channel is a key of its own. The first attempt is made when the task comes; a failed one sets a
timer for the next, after the wait of the retry plan with its jitter. The receipt leaves with the attempt that settles
the task, so a channel that is down delays only its own tasks, and by no more than their waits.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ravelin.operators import delivery as D
from ravelin.streaming.jobs import use_state_store

RECEIPT = "alert_id string, channel string, payload string, status string, error string, attempts int, attempted_at timestamp"
PENDING = T.StructType([T.StructField("task", T.StringType()), T.StructField("made", T.IntegerType()), T.StructField("due", T.LongType())])
SETTLED = T.StructType([T.StructField("settled", T.BooleanType())])


class RetryProcessor(StatefulProcessor):
    def __init__(self, send: Callable[[str, str, dict, str], int], delays: list[int], remember_ms: int) -> None:
        self.send, self.delays, self.remember_ms = send, delays, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)
        self.settled = handle.getValueState("settled", SETTLED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A task that came before, and is under way or settled, is not sent again."""
        tasks = [json.loads(task) for frame in rows for task in frame.task.tolist()]
        if tasks and not self.pending.exists() and not self.settled.exists():
            yield from self._attempt(key, tasks[0], 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.pending.exists():
            task, made, due = self.pending.get()
            if int(due) <= now:
                yield from self._attempt(key, json.loads(task), int(made), now)
        elif self.settled.exists():
            self.settled.clear()

    def _attempt(self, key, task: dict, made: int, now: int) -> Iterator[pd.DataFrame]:
        problem, made = "", made + 1
        if not task.get("url"):
            made -= 1  # nothing is sent
        else:
            try:
                status = self.send(key[1], task["url"], task.get("headers") or {}, task.get("payload") or "")
                problem = f"webhook returned status {status}" if status >= D.FAILURE_STATUS else ""
            except Exception as error:  # noqa: BLE001 - a sender may raise anything
                problem = str(error) or type(error).__name__
        if problem and made <= len(self.delays):
            due = now + max(1, int(self.delays[made - 1] * random.uniform(D.JITTER_LOW, D.JITTER_HIGH)))
            self.pending.update((json.dumps(task), made, due))
            self.handle.registerTimer(due)
            return
        if self.pending.exists():
            self.pending.clear()
        self.settled.update((True,))
        self.handle.registerTimer(now + self.remember_ms)
        status, error = (D.DLQ, f"{D.RETRIES_SPENT}: {problem}") if problem else (D.SENT, "")
        yield pd.DataFrame({"alert_id": [key[0]], "channel": [key[1]], "payload": [task.get("payload")], "status": [status], "error": [error], "attempts": [made], "attempted_at": [pd.Timestamp(now, unit="ms", tz="UTC")]})

    def close(self) -> None:
        pass


def stream_deliver(
    tasks: DataFrame, send: Callable[[str, str, dict, str], int], attempts: int = D.ATTEMPTS, base_ms: int = D.BASE_DELAY_MS, remember_ms: int = 3_600_000
) -> DataFrame:
    """Receipts of a stream of ``delivery_tasks``, as ``deliver`` gives them; ``dead_letters`` applies to them. A task
    that comes again within ``remember_ms`` after it was settled is not sent again. Delivery is at least once: a
    micro-batch that is repeated sends its attempts again."""
    use_state_store(tasks.sparkSession)
    rows = tasks.select("alert_id", "channel", F.to_json(F.struct("url", "headers", "payload")).alias("task"))
    processor = RetryProcessor(send, D.retry_delays(attempts, base_ms), remember_ms)
    return rows.groupBy("alert_id", "channel").transformWithStateInPandas(processor, RECEIPT, "Append", "ProcessingTime")
