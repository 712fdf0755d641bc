"""Live queries: settlement over deliveries, streams of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.sources.tables import table
from deuceframe.streaming.settlement import daily_activity_stream, released_stream, run_available, settle_batch


def settled_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results over the deliveries: kinds of ledger records that each batch adds."""
    r = table(spark, folder, "records").where("a_won is not null and match_id is not null and player_a is not null and player_b is not null")
    winner = F.when(F.col("a_won"), F.col("player_a")).otherwise(F.col("player_b"))
    captures = r.select(F.col("match_id").alias("subject"), F.col("batch_no").cast("bigint").alias("revision"), F.concat_ws("|", winner.cast("string"), "status").alias("content"))
    return settle_batch(captures).groupBy("revision", "kind").agg(F.count(F.lit(1)).alias("n"))


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    return run_available(daily_activity_stream(spark, f"{folder}/events.parquet"), f"event_days_{uuid.uuid4().hex}", "complete")


def released_events(spark: SparkSession, folder: str) -> DataFrame:
    """Per user, the events of the stream that are usable at its end: those of two days before its newest and earlier."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet").select(F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("at"), "value")
    out = run_available(released_stream(events), f"released_{uuid.uuid4().hex}")
    return out.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {"sm1_released_events": released_events, "sm5_settled_results": settled_results, "sm1_event_days": event_days}
SQL = {
    "sm1_released_events": """select user_id::varchar subject, count(*) n, round(sum(value), 4) total from events
      where epoch_ms(ts) <= (select max(epoch_ms(ts)) from events) - 2 * 86400000 and user_id is not null and value is not null group by 1""",
    "sm1_event_days": """select ts::date "day", event_type, count(*) n, round(sum(value), 4) total from events group by all""",
    "sm5_settled_results": """with recursive c as (select distinct match_id s, batch_no r, (case when a_won then player_a else player_b end) || '|' || status v from records
        where a_won is not null and match_id is not null and player_a is not null and player_b is not null),
      o as (select *, row_number() over (partition by s order by r, v) k from c),
      w as (select s, k, r, v, null::varchar fin, null::int fr, [struct_pack(v := v, r := r)] seen, 'result_provisional' kind from o where k = 1
        union all select o.s, o.k, o.r, o.v,
          case when w.fin is not null then case when o.v <> w.fin and o.r <> w.fr then o.v else w.fin end
            when len(list_filter(w.seen, lambda x: x.v = o.v and x.r <> o.r)) > 0 and len(list_filter(w.seen, lambda x: x.v = o.v and x.r = o.r)) = 0 then o.v end,
          case when w.fin is not null then case when o.v <> w.fin and o.r <> w.fr then o.r else w.fr end
            when len(list_filter(w.seen, lambda x: x.v = o.v and x.r <> o.r)) > 0 and len(list_filter(w.seen, lambda x: x.v = o.v and x.r = o.r)) = 0 then o.r end,
          case when w.fin is null and len(list_filter(w.seen, lambda x: x.v = o.v)) = 0 then list_append(w.seen, struct_pack(v := o.v, r := o.r)) else w.seen end,
          case when w.fin is not null then case when o.v <> w.fin and o.r <> w.fr then 'result_corrected' end
            when len(list_filter(w.seen, lambda x: x.v = o.v)) = 0 then 'result_provisional'
            when len(list_filter(w.seen, lambda x: x.v = o.v and x.r = o.r)) = 0 then 'result_final' end
        from w join o on o.s = w.s and o.k = w.k + 1)
      select r::bigint revision, kind, count(*) n from w where kind is not null group by all""",
}
