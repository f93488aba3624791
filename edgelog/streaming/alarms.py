"""T5: the N-of-N alarm as a stateful streaming operator.

Input: a stream of closed-period statistics (key, bucket, value) - e.g. the
output of the T4 job read back as a file stream.  Per key the state keeps the
last bucket seen, the last N-1 (present, breach) flags and the current alarm
state; missing periods between two buckets are filled by the missing-data
policy.  An event-time timeout fills the trailing periods up to the
watermark, so a key that stops reporting still breaches (BREACHING).  The
result equals the batch evaluator (``operators.alarms``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edgelog.functions.timekeys import micros_to_ntz
from edgelog.operators.alarms import AlarmSpec

STATE_SCHEMA = "last_us long, present string, breach string, state string, waiting string"


def evaluate_stream(closed: DataFrame, spec: AlarmSpec, period_seconds: int, keys: list[str] | None = None,
                    hold: bool = True) -> DataFrame:
    """``closed``: streaming (keys, bucket TIMESTAMP, value) with a watermark
    on ``bucket``.  Buckets travel to the state function as epoch microseconds
    (no time-zone conversion in between); the result has ``bucket`` as
    TIMESTAMP_NTZ (UTC wall clock).

    ``hold``: periods wait until the watermark has passed them, so a period that is delivered late, but within the
    watermark's delay, is still evaluated in its place; without it a period counts when it arrives.  The state
    function holds plain values only, so workers need no copy of this package."""
    keys = keys or ["metric"]
    step = period_seconds * 1_000_000
    n, threshold, comparator = spec.periods, spec.threshold, spec.comparator
    breaching, notify_ok = spec.missing == "BREACHING", spec.notify_ok
    columns = [*keys, "bucket_us", "previous", "state", "value"]
    kinds = dict(closed.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", bucket_us long, previous string, state string, value {kinds['value']}"
    whole = kinds["value"] in ("tinyint", "smallint", "int", "bigint")

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, present, breach, cur, waiting = state.get
            last = None if last is None or last < 0 else int(last)
            present, breach = list(present), list(breach)
        else:
            last, present, breach, cur, waiting = None, [], [], "OK", ""
        queue = [(int(b), float.fromhex(v) if v else None) for b, v in (x.split("=") for x in waiting.split())]
        out = []

        def step_to(b, value):
            nonlocal present, breach, cur
            has = value is not None
            present = (present + ["1" if has else "0"])[-n:]
            brk = breaching
            if has:
                brk = (value >= threshold if comparator == ">=" else value > threshold if comparator == ">" else
                       value < threshold if comparator == "<" else value <= threshold)
            breach = (breach + ["1" if brk else "0"])[-n:]
            full = len(breach) == n
            if breaching:
                raw = "ALARM" if full and all(x == "1" for x in breach) else "OK"
            else:
                raw = None if (not full or "0" in present) else ("ALARM" if all(x == "1" for x in breach) else "OK")
            new = raw if raw is not None else cur
            if new != cur and (notify_ok or new == "ALARM"):
                out.append((*key, b, cur, new, int(value) if has and whole else value))
            cur = new

        wm = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            rows = pd.concat(list(pdfs))
            queue += [(int(b), None if pd.isna(v) else float(v)) for b, v in zip(rows["bucket_us"], rows["value"])]
        queue.sort(key=lambda x: x[0])
        while queue and not (hold and queue[0][0] > wm):
            b, v = queue.pop(0)
            if last is not None:
                g = last + step
                while g < b:
                    step_to(g, None)
                    g += step
            step_to(b, v)
            last = b
        if state.hasTimedOut and last is not None:
            b = last + step
            while b <= wm and not (queue and b >= queue[0][0]):
                step_to(b, None)
                last = b
                b += step
        kept = " ".join(f"{b}=" + ("" if v is None else v.hex()) for b, v in queue)
        state.update((-1 if last is None else last, "".join(present), "".join(breach), cur, kept))
        after = queue[0][0] if queue else last + step
        state.setTimeoutTimestamp(max(after // 1000, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({"value": "Int64"}) if whole else frame

    keyed = closed.withColumn("bucket_us", F.unix_micros("bucket"))
    trans = keyed.groupBy(*keys).applyInPandasWithState(
        run, schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return trans.select(*keys, micros_to_ntz(F.col("bucket_us")).alias("bucket"), "previous", "state", "value")
