"""The running ledger of calls that are still going on, from a stream of voice-activity frames.

A call's state is small: the run that is open, totals, the last ends of speech, and the frames that have come ahead of the watermark. Frames are taken in
order of their number once the watermark has passed them, so those that come late or out of order, within the watermark, do
not change the ledger; a frame that never comes is silence. A call ends when none of its frames has come for a while of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.schemas import AGENT, CALLER, OVERLAP, SILENCE, SPEECH

FRAME_MS = 32
FRAMES = "call_id string, channel int, idx long, active boolean, ts timestamp"
#: A closed run of frames [first, last), and what the call adds up to with it, in frames. waits are between the end of a side's speech and the next start of the other's;
#: final marks a call's last run.
LIVE = (
    "call_id string, event_idx int, channel int, first long, last long, type string, caller_talk long, agent_talk long, overlap long, silence long, interruptions int, "
    "caller_waits int, caller_wait long, agent_waits int, agent_wait long, late int, final boolean"
)
STATE = (
    "next long, end long, newest long, origin long, events int, type string, channel int, first long, caller_talk long, agent_talk long, overlap long, silence long, interruptions int, "
    "caller_open int, caller_ends long, agent_open int, agent_ends long, caller_waits int, caller_wait long, agent_waits int, agent_wait long, touching int, touch_at long, late int"
)
#: Frames that wait for the watermark are kept so many together, two bits each.
BLOCK = 4096
NAMES = [c.strip().split()[0] for c in STATE.split(",")]
OUT = [c.strip().split()[0] for c in LIVE.split(",")]


def rocks(spark: SparkSession) -> None:
    """State of this kind is kept by this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ledger:
    """A call's ledger so far. Ends of speech that wait for the other side are a count and a sum, not a list."""

    def __init__(self, values: dict | None = None):
        self.s = values or dict.fromkeys(NAMES, 0) | {"type": None, "channel": None, "newest": -1, "origin": 0, "end": -1}

    def take(self, bits: int, count: int) -> tuple | None:
        """Takes the next frames, which are alike: 1 in bits is the caller's speech, 2 the agent's; the run that they close, if they do."""
        s = self.s
        caller, agent = bits & 1, bits & 2
        kind = OVERLAP if caller and agent else SPEECH if caller or agent else SILENCE
        channel = (CALLER if caller else AGENT) if kind == SPEECH else None
        closed = None
        if s["type"] is None:
            s["type"], s["channel"], s["first"] = kind, channel, s["next"]
            self.opened()
        elif (kind, channel) != (s["type"], s["channel"]):
            closed = self.close()
            s["type"], s["channel"], s["first"] = kind, channel, s["next"]
            self.opened()
        s["next"] += count
        return closed

    def opened(self) -> None:
        """A run of speech answers all ends of the other side's that lie before it; one that it touches waits on."""
        s = self.s
        if s["type"] != SPEECH:
            return
        # ends of the agent's speech wait for the caller, and the other way round
        side = "agent" if s["channel"] == CALLER else "caller"
        touching = s["touching"] and s["touch_at"] == s["first"]
        ready = s[f"{side}_open"] - touching
        if ready > 0:
            s[f"{side}_waits"] += ready
            s[f"{side}_wait"] += ready * s["first"] - (s[f"{side}_ends"] - touching * s["touch_at"])
            s[f"{side}_open"], s[f"{side}_ends"] = int(touching), touching * s["touch_at"]
        s["touching"] = 0

    def close(self) -> tuple:
        """The run that ends with the frame before the next one."""
        s = self.s
        length = s["next"] - s["first"]
        if s["type"] == SPEECH:
            side = "caller" if s["channel"] == CALLER else "agent"
            s[f"{side}_talk"] += length
            s[f"{side}_open"] += 1
            s[f"{side}_ends"] += s["next"]
            s["touching"], s["touch_at"] = 1, s["next"]
        elif s["type"] == OVERLAP:
            s["overlap"] += length
            s["interruptions"] += 1
        else:
            s["silence"] += length
        s["events"] += 1
        return s["events"] - 1, s["channel"], s["first"], s["next"], s["type"]

    def row(self, call_id: str, run: tuple, final: bool = False) -> tuple:
        index, channel, first, last, kind = run
        s = self.s
        totals = [s[n] for n in ("caller_talk", "agent_talk", "overlap", "silence", "interruptions", "caller_waits", "caller_wait", "agent_waits", "agent_wait", "late")]
        return call_id, index, channel, first, last, kind, *totals, final


def packed(frames: np.ndarray) -> bytes:
    return np.packbits(np.stack([frames & 1, frames >> 1], 1)).tobytes()


def unpacked(block: bytes) -> np.ndarray:
    sides = np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, 2)
    return sides[:, 0] | sides[:, 1] << 1


class LiveCall(StatefulProcessor):
    """State of a call: its ledger and the frames that wait for the watermark, in blocks, so that state is asked for a few times a call and not a frame."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger, self.waiting = handle.getValueState("ledger", STATE), handle.getMapState("waiting", "block long", "frames binary")

    def known(self) -> Ledger:
        return Ledger(dict(zip(NAMES, self.ledger.get()))) if self.ledger.exists() else Ledger()

    def keep(self, own: Ledger) -> None:
        self.ledger.update(tuple(own.s[n] for n in NAMES))

    def block(self, number: int) -> np.ndarray:
        return unpacked(bytes(self.waiting.getValue((number,))[0])) if self.waiting.containsKey((number,)) else np.zeros(BLOCK, np.uint8)

    def advance(self, call_id: str, own: Ledger, upto: int, fresh: dict[int, np.ndarray]) -> list[tuple]:
        """Takes frames up to number upto, of fresh blocks or of those in state; the runs that they close."""
        out = []
        while own.s["next"] < upto:
            number, at = divmod(own.s["next"], BLOCK)
            last = min(BLOCK, upto - number * BLOCK)
            frames = (fresh[number] if number in fresh else self.block(number))[at:last]
            cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if run := own.take(int(frames[a]), b - a):
                    out.append(own.row(call_id, run))
            if last == BLOCK:
                fresh.pop(number, None)
                if self.waiting.containsKey((number,)):
                    self.waiting.removeKey((number,))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, fresh, mark = self.known(), {}, timerValues.getCurrentWatermarkInMs()
        s = own.s
        for part in rows:
            if not len(part):
                continue
            idx, bits = part["idx"].to_numpy(np.int64), (1 << part["channel"].to_numpy(np.int64)) & 3
            s["origin"] = int(part["ts"].iloc[-1].timestamp() * 1000) - int(idx[-1]) * FRAME_MS  # all frames of a call say the same
            s["newest"] = max(s["newest"], int(idx.max()))
            late = idx < s["next"]
            s["late"] += int(late.sum())
            active = part["active"].eq(True).to_numpy(bool) & ~late
            idx, bits = idx[active], bits[active].astype(np.uint8)
            numbers = idx // BLOCK
            for number in np.unique(numbers).tolist():
                if number not in fresh:
                    fresh[number] = self.block(number)
                np.bitwise_or.at(fresh[number], idx[numbers == number] - number * BLOCK, bits[numbers == number])
        out = self.advance(key[0], own, min(s["newest"] + 1, max(0, (mark - s["origin"]) // FRAME_MS)) if mark > 0 else 0, fresh)
        for number, frames in fresh.items():
            self.waiting.updateValue((number,), (packed(frames),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(s["origin"] + (s["newest"] + 1) * FRAME_MS + self.idle_ms, mark + 1))
        self.keep(own)
        if out:
            yield pd.DataFrame(out, columns=OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No frame has come for a while: the call is over."""
        own = self.known()
        out = self.advance(key[0], own, own.s["newest"] + 1, {})
        if own.s["type"] is not None:
            out.append(own.row(key[0], own.close(), final=True))
        self.ledger.clear()
        self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=OUT)

    def close(self) -> None:
        pass


def live_ledger(frames: DataFrame, late: str = "2 seconds", idle_ms: int = 5000) -> DataFrame:
    """LIVE rows of a stream of FRAMES: each run of a call once it has closed.

    ts is a frame's time; a call's frames lie FRAME_MS apart, so ts and idx say the same. late is how far behind the newest frame of the stream one
    may come; idle_ms how long a call is silent before it is over. A frame that comes after its place was taken is counted in late.
    """
    rocks(frames.sparkSession)
    watched = frames.where(F.col("idx") >= 0).withWatermark("ts", late)
    return watched.groupBy("call_id").transformWithStateInPandas(LiveCall(idle_ms), outputStructType=LIVE, outputMode="append", timeMode="eventTime")


def live_metrics(runs: DataFrame, frame_s: float = FRAME_MS / 1000) -> DataFrame:
    """What ledger.conversation_metrics() says of a call, from its last run, in seconds."""
    over = lambda total, n: F.coalesce(F.try_divide(F.col(total) * F.lit(frame_s), F.col(n)), F.lit(0.0))
    sizes = {"caller_talk_s": "caller_talk", "agent_talk_s": "agent_talk", "overlap_s": "overlap", "silence_s": "silence"}
    return runs.where("final").select(
        "call_id", *[(F.col(n) * F.lit(frame_s)).alias(name) for name, n in sizes.items()], F.col("interruptions").cast("long").alias("interruption_count"),
        over("agent_wait", "agent_waits").alias("mean_agent_response_latency_s"), over("caller_wait", "caller_waits").alias("mean_caller_response_latency_s"),
    )
