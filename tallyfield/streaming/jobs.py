"""Timed jobs: the model review as Arrow batches over an injected client, and batch functions under micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[dict], dict]


def model_review(due: DataFrame, client: Client, retries: int = 2, pause_s: float = 0.5) -> DataFrame:
    """(id, created_at, verdict, delta, comment) for due proofs with their rule; each proof is judged alone.

    ``client`` maps image_url, note and rule_content to verdict, delta and comment. A proof whose calls all
    fail gives no row, so it stays pending for the next run.
    """

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for attempt in range(retries + 1):
                    try:
                        answer = client({k: row[k] for k in ("image_url", "note", "rule_content")})
                    except (OSError, TimeoutError):
                        time.sleep(pause_s * 2**attempt)
                        continue
                    out.append((row["id"], row["created_at"], bool(answer["verdict"]), f"{answer['delta']:.4f}", answer.get("comment")))
                    break
            yield pd.DataFrame(out, columns=["id", "created_at", "verdict", "delta", "comment"])

    read = due.select("id", "created_at", "image_url", "note", "rule_content")
    schema = "id long, created_at timestamp_ntz, verdict boolean, delta string, comment string"
    return read.mapInPandas(judged, schema).withColumn("delta", F.col("delta").cast("decimal(5,4)"))


def run_available(stream: DataFrame, job: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Give all new input of a stream to a batch job, in one pass that remembers how far it came."""
    query = stream.writeStream.foreachBatch(lambda frame, _: job(frame)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
