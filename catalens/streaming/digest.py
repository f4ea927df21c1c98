"""The daily digest: read the events that nobody was told of, write the message, mark them, once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.operators.log import digest, untold
from catalens.sources.keyed_table import BatchLog, KeyedTable


def send_digest(log: KeyedTable, folder: str, batch_id: int, now: str, hours: int = 24) -> DataFrame:
    """The message of ``batch_id`` (total, subject, body; no row if there was nothing), about the ``hours`` before ``now``.

    The ids are written down first, then the message, then the log's rows are marked as notified.
    A batch that is run again after any failure goes on from what is there: events that came
    since belong to the next batch, and no event is told of twice.
    """
    told = BatchLog(log.spark, f"{folder}/told", "id long")
    outbox = BatchLog(log.spark, f"{folder}/outbox", "total long, subject string, body string")
    if not told.has(batch_id):
        since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
        told.append(untold(log.read(), since).select("id"), batch_id)
    ids = told.read(batch_id)
    if not outbox.has(batch_id):
        outbox.append(digest(log.read_near(ids).join(ids, "id", "left_semi")), batch_id)
    log.update(ids, {"notified": F.lit(True)})
    return outbox.read(batch_id)
