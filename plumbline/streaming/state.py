"""Keyed state over event streams: seen ids, cooldowns, decayed counters and claims."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How long ids stay known, how long a claim may take at most and at least, and the decay of counters.
SEEN, CLAIM_TTL_S, CLAIM_LEAST_S, DECAY = "7 days", 7 * 86400, 15, 0.75
#: Buckets of keys whose states are kept together.
BUCKETS = 4096


def first_seen(events: DataFrame, key: list[str], time: str, keep: str = SEEN) -> DataFrame:
    """Each key once within `keep` of event time; state older than the watermark goes."""
    return events.withWatermark(time, keep).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Rows and distinct keys per window of event time; events later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def _bucket(key: str, buckets: int) -> Column:
    """Keys share the state of their bucket, as a call of Python for each key costs more than all of its rows; null has its own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int").alias("_bucket")


def decayed_counters(runs: DataFrame, key: str, order: str, value: str, factor: float = DECAY, buckets: int = BUCKETS) -> DataFrame:
    """After each batch, per key: runs so far and the decayed sum, in which each run counts `factor` times the next.

    Runs come in the order of `order` (null first) from batch to batch; a run without a value adds nothing. The state is one
    row for each of `buckets` hash buckets of keys, which must stay the same as long as the stream lives: a batch calls
    Python once for each bucket it touches and rewrites that bucket's counters, two numbers and the key each.
    Its runs are folded as arrays, so of a hot key a batch holds three values a run.
    """

    def step(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, n, recent = state.get if state.exists else ([], [], [])
        known = dict(zip(keys, zip(n, recent)))
        rows = pd.concat(list(frames), ignore_index=True).sort_values([order, value], na_position="first")
        codes, found = pd.factorize(rows[key], use_na_sentinel=False)
        counts, by_key = np.bincount(codes), np.argsort(codes, kind="stable")
        age = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(len(rows))
        sums = np.bincount(codes[by_key], weights=rows[value].to_numpy()[by_key] * factor ** age.astype(float))
        found = [None] if bucket[0] < 0 else found.tolist()
        for k, more, add in zip(found, counts.tolist(), sums.tolist()):
            n_k, recent_k = known.get(k, (0, 0.0))
            known[k] = (n_k + more, recent_k * factor**more + add)
        state.update((list(known), [c for c, _ in known.values()], [r for _, r in known.values()]))
        yield pd.DataFrame({key: found, "runs": [known[k][0] for k in found], "recent": [known[k][1] for k in found]})

    kinds = dict(runs.dtypes)
    whole = kinds[order] in ("tinyint", "smallint", "int", "bigint")  # pandas has no null among integers
    ordered = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)).cast("long")) if whole else F.col(order)
    narrow = runs.select(_bucket(key, buckets), key, ordered.alias(order), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))
    return narrow.groupBy("_bucket").applyInPandasWithState(step, f"{key} {kinds[key]}, runs long, recent double", f"keys array<{kinds[key]}>, n array<long>, recent array<double>", "update", GroupStateTimeout.NoTimeout)


def claims(events: DataFrame, token: str, kind: str, at: str, inviter: str, visitor: str, time: str, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """start makes a claim pending; complete, at least CLAIM_LEAST_S and at most CLAIM_TTL_S later, completes it once.

    `at` is in epoch seconds, `time` is the same moment as event time. Emits (token, status, started, completed) when a
    claim's status changes. A visitor cannot claim an invitation of their own; what comes again changes nothing, nor does
    what has no moment. A token goes once the watermark is CLAIM_TTL_S past its last move; a claim that is pending then is
    emitted as expired. The state is one row for each of `buckets` hash buckets of tokens, as in decayed_counters; it times
    out when the first of its tokens does.
    """

    def step(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, started, completed, due = state.get if state.exists else ([], [], [], [])
        known = dict(zip(tokens, zip(started, completed, due)))
        mark, before = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(at, kind="stable")
            of = [None] * len(rows) if bucket[0] < 0 else rows[token].tolist()
            for t, move, when, own in zip(of, rows[kind].tolist(), rows[at].tolist(), rows["_own"].tolist()):
                start, done, _ = known.get(t, (-1, -1, 0))
                before.setdefault(t, (start, done))
                if not own and move == "start" and done < 0 and (start < 0 or when - start > CLAIM_TTL_S):
                    start = int(when)
                elif not own and move == "complete" and start >= 0 and done < 0 and CLAIM_LEAST_S <= when - start <= CLAIM_TTL_S:
                    done = int(when)
                known[t] = (start, done, max((max(start, done, 0) + CLAIM_TTL_S) * 1000, mark) + 1)
        told = [(t, "completed" if known[t][1] >= 0 else "pending", *known[t][:2]) for t, was in before.items() if known[t][:2] != was]
        told += [(t, "expired", start, done) for t, (start, done, last) in known.items() if last < mark and start >= 0 and done < 0]
        known = {t: x for t, x in known.items() if x[2] >= mark}
        if known:
            state.update((list(known), *([x[i] for x in known.values()] for i in range(3))))
            state.setTimeoutTimestamp(min(x[2] for x in known.values()))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(told, columns=[token, "status", "started", "completed"])

    own = F.col(inviter).eqNullSafe(F.col(visitor)).alias("_own")
    key_kind = dict(events.dtypes)[token]
    columns = list(dict.fromkeys([token, kind, at, time]))
    moves = events.withWatermark(time, late).where(F.col(at).isNotNull()).select(_bucket(token, buckets), *columns, own)
    return moves.groupBy("_bucket").applyInPandasWithState(step, f"{token} {key_kind}, status string, started long, completed long", f"tokens array<{key_kind}>, started array<long>, completed array<long>, due array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def cooling(failures: DataFrame, source: str, at: str, hours: int) -> DataFrame:
    """Batch form of the cooldown: (source, failures, until) from landed failures."""
    return failures.groupBy(source).agg(F.count(F.lit(1)).alias("failures"), (F.max(at) + F.make_interval(hours=F.lit(hours))).alias("until"))
