"""Anchored chat windows on a stream: state per key is the open window, closed when the watermark passes its end."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..conf import CONF, EngineConf
from ..operators import chat

OUT = "key long, first_ts timestamp, last_ts timestamp, n long, chars long"
STATE = "anchor timestamp, last timestamp, n long, chars long"


def anchored_windows(messages: DataFrame, minutes: int = CONF.window_minutes, late: str = "1 hour") -> DataFrame:
    """Windows of a stream of messages (key, ts, chars): each takes messages up to ``minutes`` after its first.

    Rows of a micro-batch are taken in time order. A row older than the open window's anchor joins that window; rows beyond
    the watermark are dropped. An open window is emitted once a later message opens the next, or the watermark is past it.
    """
    span = timedelta(minutes=minutes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        now = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *now)], columns=["key", "first_ts", "last_ts", "n", "chars"])
            return
        for row in pd.concat(batches).sort_values("ts").itertuples():
            if now is None or row.ts - pd.Timestamp(now[0]) > span:
                if now is not None:
                    done.append((key[0], *now))
                now = [row.ts, row.ts, 0, 0]
            now = [now[0], max(pd.Timestamp(now[1]), row.ts), now[2] + 1, now[3] + int(row.chars)]
        state.update((pd.Timestamp(now[0]).to_pydatetime(), pd.Timestamp(now[1]).to_pydatetime(), now[2], now[3]))
        state.setTimeoutTimestamp(max(int((pd.Timestamp(now[0]) + span).tz_localize("UTC").timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["key", "first_ts", "last_ts", "n", "chars"])

    return messages.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def chat_chunks(messages: DataFrame, conf: EngineConf = CONF, late: str = "1 hour") -> DataFrame:
    """Chunks (key, label, text) of a stream of messages (key, ts, sender, content): anchored windows, merged from the left, rendered.

    State is the last merged window of each key, which later messages may still join: at most ``max_chars`` and one anchored
    window more. It is emitted once it can't grow: when a later window stands apart, or the watermark is a quiet gap past it.
    """
    quiet = timedelta(minutes=conf.quiet_minutes + conf.window_minutes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [m | {"ts": datetime.fromisoformat(m["ts"])} for m in json.loads(state.get[0])] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            done, left = chat.windows_of(held, conf), []
        else:
            rows = pd.concat(batches).sort_values("ts", kind="stable")
            held += [{"ts": ts.to_pydatetime(), "sender": s, "content": c} for ts, s, c in zip(rows["ts"], rows["sender"], rows["content"])]
            windows = chat.windows_of(held, conf)
            done, left = windows[:-1], windows[-1]
            state.update((json.dumps([m | {"ts": m["ts"].isoformat()} for m in left], ensure_ascii=False),))
            end = int(pd.Timestamp(left[-1]["ts"] + quiet).tz_localize("UTC").timestamp() * 1000)
            state.setTimeoutTimestamp(max(end + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *chat.rendered(w, n)) for n, w in enumerate(done, 1)], columns=["key", "label", "text"])

    return messages.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, "key long, label string, text string", "held string", "append", GroupStateTimeout.EventTimeTimeout)
