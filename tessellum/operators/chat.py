"""Chat windows: anchored at their first message, then merged over quiet gaps; runs of one speaker."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import CONF, EngineConf


# The format of an export (message head, picture line), what it adds to messages, and what its system sender says.
_HEAD = re.compile(r"\*\*(.+?)\*\*\s+`\[(\d{4}-\d\d-\d\d\s+\d\d:\d\d:\d\d)\]`")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]+\.(?:png|jpe?g|gif|webp|bmp)\)", re.I)
MARKERS = (("📸 `", "加密高级图片"), ("📦 `", "未知格式内建消息"))
EXPORTED, CDATA, PAYLOADS = "> 导出时间", "<![CDATA[", ("<template>", "<link_list>", "<memberlist>", "<plain>")
SYSTEM, NOTICES = "系统提示", ("撤回了一条消息", "邀请你加入了群聊", "加入了群聊", "移出了群聊", "修改群名为", "更换了群头像", "拍了拍", "开启了群待办", "结束了群待办")


def said(line: str) -> bool:
    """Whether a trimmed line of an export is something a person wrote."""
    if not line or line == "---" or line.startswith(EXPORTED) or _IMAGE.fullmatch(line):
        return False
    if any(line.startswith(start) and part in line for start, part in MARKERS):
        return False
    return not (CDATA in line and any(x in line for x in PAYLOADS))


def parse(text: str) -> list[dict]:
    """Messages (sender, ts, content, first, last) of an exported chat: a header line ``**sender** `[time]``` and what follows.

    What comes before the first header, lines nobody wrote, empty messages and notices of the system are left out. A time
    that is none is None.
    """
    out: list[dict] = []
    for no, raw in enumerate((text or "").split("\n"), 1):
        line = raw.strip()
        head = _HEAD.match(raw)
        if head:
            try:
                ts = datetime.strptime(" ".join(head[2].split()), "%Y-%m-%d %H:%M:%S")
            except ValueError:
                ts = None
            out.append({"sender": head[1], "ts": ts, "lines": [], "first": no, "last": no})
        elif out and line:
            out[-1]["last"] = no
            if said(line):
                out[-1]["lines"].append(line)
    kept = [m | {"content": "\n".join(m.pop("lines"))} for m in out]
    return [m for m in kept if m["content"] and not (m["sender"] == SYSTEM and any(n in m["content"] for n in NOTICES))]


def windows_of(messages: list[dict], conf: EngineConf = CONF) -> list[list[dict]]:
    """Anchored windows of messages in order, merged from the left: the rules of ``anchored_windows`` and ``merged_windows`` for one export.

    A message without a time joins the window before it.
    """
    wide, quiet = timedelta(minutes=conf.window_minutes), timedelta(minutes=conf.quiet_minutes)
    anchored: list[list[dict]] = []
    anchor = None
    for m in messages:
        if not anchored or (m["ts"] and anchor and m["ts"] - anchor > wide):
            anchored.append([])
            anchor = m["ts"]
        anchor = anchor or m["ts"]
        anchored[-1].append(m)
    size = lambda w: sum(len(x["content"]) for x in w)
    times = lambda w: [x["ts"] for x in w if x["ts"]]
    out: list[list[dict]] = []
    for w in anchored:
        last = out[-1] if out else None
        if last is not None:
            a, b = size(last), size(w)
            gap = times(w)[0] - times(last)[-1] > quiet if times(w) and times(last) else False
            if a + b <= conf.max_chars and not (a >= conf.min_chars and b >= conf.min_chars) and not gap:
                last += w
                continue
        out.append(list(w))
    return out


def rendered(window: list[dict], n: int) -> tuple[str, str]:
    """(label, text) of the n-th window: its first and last minute, and ``[HH:MM] sender: content`` a message."""
    times = [x["ts"] for x in window if x["ts"]]
    label = f"{times[0]:%Y-%m-%d %H:%M} ~ {times[-1]:%Y-%m-%d %H:%M}" if times else f"window {n}"
    return label, "\n".join(f"[{x['ts']:%H:%M}] {x['sender']}: {x['content']}" if x["ts"] else f"[?] {x['sender']}: {x['content']}" for x in window)


def chunk_specs(messages: list[dict], size: int, overlap: int, conf: EngineConf = CONF) -> Iterator:
    """A chunk for each window: ``[HH:MM] sender: content`` a message, labelled with its first and last minute; long ones packed by lines."""
    from .chunk import Piece, sized

    def pieces() -> Iterator[Piece]:
        for n, w in enumerate(windows_of(messages, conf), 1):
            label, text = rendered(w, n)
            yield Piece(text, w[0]["first"], w[-1]["last"], label, "chat")

    return sized(pieces(), size, overlap)


def messages(files: DataFrame) -> DataFrame:
    """(rel_path, n, sender, ts, content, line_start, line_end) of the chat exports among ``files`` (rel_path, text); map side only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, n, m["sender"], m["ts"], m["content"], m["first"], m["last"]) for path, text in zip(batch["rel_path"], batch["text"]) for n, m in enumerate(parse(text), 1)]
            yield pd.DataFrame(rows, columns=["rel_path", "n", "sender", "ts", "content", "line_start", "line_end"]).astype({"ts": "datetime64[us]"})

    return files.select("rel_path", "text").mapInPandas(run, "rel_path string, n long, sender string, ts timestamp_ntz, content string, line_start long, line_end long")


def _folded(rows: DataFrame, key: str, order: list[str], start, step) -> DataFrame:
    """Windows (key, window_no, first_ts, last_ts, n, chars) by a fold over sorted rows, stretch by stretch.

    Rows are dealt by key and stretch and sorted where they are (a sort that spills); a task streams through them with one
    window in hand, so neither a long stretch nor a busy key is ever gathered.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held = None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                at = (getattr(row, key), row.stretch)
                joined = step(held, row) if at == place else None
                if joined is None:
                    if held is not None:
                        done.append((*place, *held))
                    held = start(row)
                else:
                    held = joined
                place = at
            yield pd.DataFrame(done, columns=[key, "stretch", "first_ts", "last_ts", "n", "chars"])
        if held is not None:
            yield pd.DataFrame([(*place, *held)], columns=[key, "stretch", "first_ts", "last_ts", "n", "chars"])

    dealt = rows.repartition(key, "stretch").sortWithinPartitions(key, "stretch", *order)
    found = dealt.mapInPandas(run, f"{key} {kind}, stretch long, first_ts timestamp_ntz, last_ts timestamp_ntz, n long, chars long")
    numbered = F.row_number().over(Window.partitionBy(key).orderBy("stretch", "first_ts")).cast("long")
    return found.withColumn("window_no", numbered).select(key, "window_no", "first_ts", "last_ts", "n", "chars")


def _late(later, earlier, minutes: int):
    return later > earlier + F.expr(f"INTERVAL {minutes} MINUTES")


def anchored_windows(messages: DataFrame, key: str, minutes: int = CONF.window_minutes) -> DataFrame:
    """(key, window_no, first_ts, last_ts, n, chars): a window takes messages (key, ts, id, chars) up to ``minutes`` after its first.

    A gap of more than ``minutes`` ends a window wherever it is anchored, so rows are cut there first.
    """
    order = Window.partitionBy(key).orderBy("ts", "id")
    gap = F.coalesce(_late(F.col("ts"), F.lag("ts").over(order), minutes), F.lit(False)).cast("long")
    stretch = messages.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(order)).drop("gap")
    wide = timedelta(minutes=minutes)

    def start(row):
        return row.ts, row.ts, 1, row.chars

    def step(held, row):
        first, _, n, chars = held
        return (first, row.ts, n + 1, chars + row.chars) if row.ts - first <= wide else None

    return _folded(stretch.select(key, "stretch", "ts", "id", "chars"), key, ["ts", "id"], start, step)


def merged_windows(windows: DataFrame, key: str, conf: EngineConf = CONF) -> DataFrame:
    """Neighbouring windows joined from the left while together they are short enough, one is small, and no long quiet lies between.

    window_no is that of the first window of each.
    """
    order = Window.partitionBy(key).orderBy("window_no")
    gap = F.coalesce(_late(F.col("first_ts"), F.lag("last_ts").over(order), conf.quiet_minutes), F.lit(False)).cast("long")
    stretch = windows.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(order)).drop("gap")

    def start(row):
        return row.first_ts, row.last_ts, row.n, row.chars

    def step(held, row):
        first, _, n, chars = held
        small = not (chars >= conf.min_chars and row.chars >= conf.min_chars)
        return (first, row.last_ts, n + row.n, chars + row.chars) if chars + row.chars <= conf.max_chars and small else None

    merged = _folded(stretch.select(key, "stretch", "window_no", "first_ts", "last_ts", "n", "chars"), key, ["window_no"], start, step)
    first = windows.select(key, F.col("window_no").alias("w"), F.col("first_ts").alias("f"))
    return merged.drop("window_no").join(first.withColumnRenamed(key, "k2"), (F.col(key) == F.col("k2")) & (F.col("first_ts") == F.col("f"))).select(key, F.col("w").alias("window_no"), "first_ts", "last_ts", "n", "chars")


def speaker_runs(turns: DataFrame) -> DataFrame:
    """(conv_id, run, role, first_turn, last_turn, n): consecutive turns of one role."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce(F.col("role") != F.lag("role").over(order), F.lit(True)).cast("long")
    return turns.withColumn("new", new).withColumn("run", F.sum("new").over(order)).groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))
