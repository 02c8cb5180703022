"""R1 for a landing folder that fills up: a refresh for each batch of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringlog.functions.calendar import Day
from ringlog.plans.tables import refresh_table
from ringlog.sources.landing import ENVELOPE, unwrap

#: How long a record is remembered, from when it came.
REMEMBERED = "30 days"


def new_records(records: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """Of a stream of records those that have not come before, equal in every field.

    The stream's state holds a digest of each record, no number in plain, and forgets it
    after some time. That time runs from when a record comes and not from when the call
    was, so a file of late calls is never taken for old. A record that was corrected
    differs from the former and passes.
    """
    columns = records.columns
    return (
        records.withColumn("record", F.sha2(F.to_json(F.struct(*columns)), 256))
        .withColumn("came", F.current_timestamp())
        .withWatermark("came", remembered)
        .dropDuplicatesWithinWatermark(["record"])
        .select(*columns)
    )


def follow_landing(
    spark: SparkSession,
    landing: str,
    path: str,
    areas: DataFrame,
    as_of: Day,
    checkpoint: str,
    on_bad: str = "error",
    salt: str | None = None,
    remembered: str = REMEMBERED,
) -> StreamingQuery:
    """Take up the response files that came since the last run, then stop.

    A batch may hold any part of any days: its calls are put in call by call, those
    that are stored already by their id, and no stored call goes. So files may come
    one by one or all at once. Records that came before, in this batch or in one of the
    last `remembered`, are passed over by the stream's state, and a batch of nothing
    else rewrites nothing. The refresh of a batch can be repeated without harm, so one
    that is run again after a failure is no problem. The checkpoint, which has the
    state, belongs in a shared folder; its number of partitions is fixed by the first run.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        # Kept while the batch is used, so that the state is asked once; a part that is
        # lost is worked out again from the state before the batch.
        records = batch.persist()
        try:
            if records.count():
                refresh_table(batch.sparkSession, path, records, areas, as_of, None, on_bad, salt)
        finally:
            records.unpersist()

    stream = spark.readStream.schema(ENVELOPE).option("mode", "FAILFAST").json(landing)
    return (
        new_records(unwrap(stream), remembered)
        .writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
