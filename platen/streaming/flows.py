"""Streams: intake, decision counts and the attempt ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from platen.operators.metrics import illumination, noise, sharpness, tone
from platen.operators.rules import diagnose
from platen.sources.intake import ingest_gate, split_gate


def stream_ingest(images: DataFrame, checkpoint: str, diagnoses: str, rejected: str, text_col: str = "text", extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> StreamingQuery:
    """Gates and diagnoses arriving images (gate columns and `text_col`, whose whole text is the raster), each once; Parquet sinks by batch."""
    from platen.sources.rasters import text_raster

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = split_gate(ingest_gate(batch, extensions))
        px = text_raster(good, "image_id", text_col).persist()
        m = tone(px).join(sharpness(px), "image_id").join(noise(px), "image_id").join(illumination(px), "image_id")
        diagnose(m).write.mode("overwrite").parquet(f"{diagnoses}/batch={number}")
        bad.select("image_id", "reject_code").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        px.unpersist(), batch.unpersist()

    return images.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_decision_counts(decisions: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of (ts, status) by tumbling window; rows later than the watermark are dropped."""
    return decisions.withWatermark("ts", late).groupBy(F.window("ts", window), "status").count().select("window.start", "window.end", "status", "count")


LEDGER = "image_id long, priority int, operation_id string, step_status string"


def stream_attempts(attempts: DataFrame, most_accepted: int = 1, most_attempts: int = 4, ts: str | None = None, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """Step status of arriving attempts (image_id, priority, operation_id, eligible, decision) by image: one accepted, four tried, none twice.

    The state of an image is its accepted and tried counts and the operations tried; the batch form is rules.enhancement_loop.
    With a time column `ts`, an image's state ends `keep_ms` after its last attempt, once the watermark (`late` behind the newest attempt) has passed
    that. Attempts older than the watermark are dropped; a newer one of an image whose state has ended begins a new ledger. Without it,
    state stays as long as the stream.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted, tried, seen = state.get if state.exists else (0, 0, "")
        names = set(seen.split("\n")) - {""}
        rows = pd.concat(list(batches)).sort_values(["priority", "operation_id"])
        out = []
        for r in rows.itertuples(index=False):
            if r.operation_id in names:
                status = "skipped"
            elif not r.eligible or accepted >= most_accepted or tried >= most_attempts:
                status = "deferred"
            else:
                status, tried = r.decision, tried + 1
                accepted += r.decision.startswith("accepted")
            names.add(r.operation_id)
            out.append((key[0], r.priority, r.operation_id, status))
        state.update((accepted, tried, "\n".join(sorted(names))))
        if ts:
            state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(out, columns=["image_id", "priority", "operation_id", "step_status"])

    timed = attempts.withWatermark(ts, late) if ts else attempts
    end = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return timed.groupBy("image_id").applyInPandasWithState(step, LEDGER, "accepted int, tried int, seen string", "append", end)
