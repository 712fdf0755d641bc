"""Versions of results over deliveries: settlement, the ledger's rules, and streams of both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deuceframe.operators.lagged import LAG
from deuceframe.session import Scratch

#: Kinds of ledger records that must, and must not, exist for a subject before a kind (fixed values).
REQUIRES = {
    "fixture_proposed": (), "fixture_qualified": ("fixture_proposed",), "fixture_excluded": ("fixture_proposed",),
    "forecast_issued": ("fixture_qualified",), "forecast_unavailable": ("fixture_qualified",), "proof_requested": ("forecast_issued",),
    "proof_verified": ("proof_requested",), "proof_failed": ("proof_requested",), "start_verified": ("fixture_qualified",),
    "result_provisional": ("fixture_qualified",), "result_final": ("result_provisional",), "result_corrected": ("result_final",),
    "score_reported": ("result_final", "result_corrected"),
}
FORBIDS = {
    "fixture_qualified": ("fixture_qualified", "fixture_excluded"), "fixture_excluded": ("fixture_qualified", "fixture_excluded"),
    "forecast_issued": ("fixture_excluded",), "forecast_unavailable": ("fixture_excluded",), "result_final": ("result_final",),
}


def settle(captures: list[tuple[int, str]], state: tuple[str | None, int | None, list[tuple[str, int]]] | None = None):
    """Ledger kinds for captures (revision, content) in order, and the state after them.

    The first sight of a content is provisional; a second revision that agrees makes it final; a later revision that
    disagrees with the final content corrects it.
    """
    final, final_revision, seen = state or (None, None, [])
    out = []
    for revision, content in captures:
        if final is not None:
            if content != final and revision != final_revision:
                final, final_revision = content, revision
                out.append((revision, content, "result_corrected"))
            continue
        agreeing = {r for c, r in seen if c == content}
        if agreeing and revision not in agreeing:
            final, final_revision = content, revision
            out.append((revision, content, "result_final"))
        elif revision not in agreeing:
            seen = [*seen, (content, revision)]
            out.append((revision, content, "result_provisional"))
    return out, (final, final_revision, seen)


SETTLED = "subject string, revision long, content string, kind string"


def settle_batch(captures: DataFrame) -> DataFrame:
    """(subject, revision, content, kind) from captures (subject, revision, content); equal captures count once."""
    once = captures.where("subject is not null and revision is not null and content is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current = None, None
        for pdf in batches:
            rows = []
            for subject, revision, content in zip(pdf.subject, pdf.revision, pdf.content, strict=True):
                if subject != current:
                    held, current = None, subject
                out, held = settle([(revision, content)], held)
                rows += [(subject, *r) for r in out]
            yield pd.DataFrame(rows, columns=["subject", "revision", "content", "kind"])

    # a task's subjects lie one after another, each in its order, so the state of one subject is all that is held
    lined = once.repartition("subject").sortWithinPartitions("subject", "revision", "content")
    return lined.select("subject", "revision", "content").mapInPandas(run, SETTLED)


def settle_stream(captures: DataFrame) -> DataFrame:
    """The same over a stream, with the state of each subject kept between batches (revisions must arrive in order)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            final, revision, contents, revisions = state.get
            held = (final, revision, list(zip(contents, revisions, strict=True)))
        pdf = pd.concat(list(batches)).drop_duplicates().sort_values(["revision", "content"])
        out, (final, revision, seen) = settle(list(zip(pdf.revision, pdf.content, strict=True)), held)
        state.update((final, revision, [c for c, _ in seen], [int(r) for _, r in seen]))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["subject", "revision", "content", "kind"])

    return captures.groupBy("subject").applyInPandasWithState(
        run, SETTLED, "final string, revision long, contents array<string>, revisions array<long>", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result, a table in the shared folder, where its checkpoint is too.

    Appended rows are written as they come; in the other modes each batch's result replaces the one before.
    """
    scratch = Scratch(stream.sparkSession, name)
    out, state = scratch.path("rows"), scratch.path("checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    scratch.drop("checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def released_stream(rows: DataFrame, lag: int = LAG) -> DataFrame:
    """(subject, day, value) of a stream of rows once they are usable: when the stream has got `lag` days beyond their day.

    rows: subject, at (timestamp), value, of which nothing later than the newest day is withheld for good: the rows wait in
    the state of their subject, and a timer of event time sets them free. Rows of the last days stay withheld, as they must.
    """
    span = lag * 86_400_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held += [(int(t.timestamp() * 1000), float(v)) for t, v in zip(pdf["at"], pdf["value"], strict=True)]
        now = state.getCurrentWatermarkMs()
        free = sorted(x for x in held if x[0] + span <= now)
        held = sorted(x for x in held if x[0] + span > now)
        if held:
            state.update(([t for t, _ in held], [v for _, v in held]))
            state.setTimeoutTimestamp(max(held[0][0] + span - 1, now + 1))  # a timer fires once the watermark is beyond it
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"subject": [key[0]] * len(free), "at": pd.to_datetime([t for t, _ in free], unit="ms"), "value": [v for _, v in free]})

    clean = rows.where("subject is not null and at is not null and value is not null").withWatermark("at", "0 seconds")
    return clean.groupBy("subject").applyInPandasWithState(
        run, "subject string, at timestamp, value double", "times array<long>, amounts array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def decayed_stream(rows: DataFrame, half_life: float = 180.0) -> DataFrame:
    """(subject, at, before) of a stream: each row with the decayed sum of its subject's earlier values, halved every
    half_life days. The state is one number and its time; rows that come in out of order count from when they came."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last = state.get if state.exists else (0.0, None)
        pdf = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for t, v in zip(pdf["at"], pdf["value"], strict=True):
            now = int(t.timestamp() * 1000)
            if last is not None and now > last:
                total *= 2.0 ** (-(now - last) / 86_400_000 / half_life)
            out.append((key[0], t, total))
            total, last = total + float(v), max(now, last if last is not None else now)
        state.update((total, last))
        yield pd.DataFrame(out, columns=["subject", "at", "before"])

    clean = rows.where("subject is not null and at is not null and value is not null")
    return clean.groupBy("subject").applyInPandasWithState(
        run, "subject string, at timestamp, before double", "total double, last long", "append", GroupStateTimeout.NoTimeout
    )


def chained(records: DataFrame, genesis: str) -> DataFrame:
    """Ledger records (seq, kind, subject, payload) with content and record digests that chain to the one before.

    The digest of a record covers its predecessor's, so chaining is serial: records are grouped by ledger, and one ledger
    is one task, as an append-only log of one writer is.
    """
    import hashlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        previous, rows = hashlib.sha256(genesis.encode()).hexdigest(), []
        for r in pdf.sort_values("seq").itertuples(index=False):
            content = hashlib.sha256(f"{r.kind}|{r.subject}|{r.payload}".encode()).hexdigest()
            record = hashlib.sha256(f"{r.seq}|{content}|{previous}".encode()).hexdigest()
            rows.append((r.ledger, r.seq, r.kind, r.subject, r.payload, content, previous, record))
            previous = record
        return pd.DataFrame(rows, columns=["ledger", "seq", "kind", "subject", "payload", "content", "previous", "record"])

    return records.groupBy("ledger").applyInPandas(
        run, "ledger string, seq long, kind string, subject string, payload string, content string, previous string, record string"
    )


def ledger_faults(ledger: DataFrame, genesis: str) -> DataFrame:
    """(ledger, seq, fault) of records whose digest, chain, number or kind breaks the rules. All checks are windows over
    the records before, so a ledger is verified without replaying it in one process."""
    line = Window.partitionBy("ledger").orderBy("seq")
    history = F.collect_set("kind").over(Window.partitionBy("ledger", "subject").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    start = F.sha2(F.lit(genesis), 256)
    content = F.sha2(F.concat_ws("|", "kind", "subject", "payload"), 256)
    record = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "content", "previous"), 256)

    def rule(table: dict, wanted: bool) -> Column:
        out = F.lit(True) if wanted else F.lit(False)
        for kind, kinds in table.items():
            if kinds:
                out = F.when(F.col("kind") == kind, F.arrays_overlap(history, F.array(*[F.lit(k) for k in kinds]))).otherwise(out)
        return out

    checks = {
        "sequence": F.col("seq") != F.row_number().over(line),
        "content_digest": F.col("content") != content,
        "record_digest": F.col("record") != record,
        "chain": F.col("previous") != F.coalesce(F.lag("record").over(line), start),
        "unknown_kind": ~F.col("kind").isin(*REQUIRES),
        "missing_prerequisite": ~rule(REQUIRES, True),
        "forbidden": rule(FORBIDS, False),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return ledger.select("ledger", "seq", found.alias("f")).select("ledger", "seq", F.explode("f").alias("fault"))


def scoring_barrier(records: DataFrame) -> DataFrame:
    """Subjects that may be scored: forecast issued before its proof, proof before the start, and the result final.

    records: subject, kind, at (timestamp); the newest record of a kind counts.
    """
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    last = records.groupBy("subject").agg(
        at("forecast_issued").alias("issued"), at("proof_verified").alias("proof"), at("start_verified").alias("start"),
        F.max_by("kind", F.when(F.col("kind").isin("result_provisional", "result_final", "result_corrected"), F.col("at"))).alias("result"),
    )
    ready = (F.col("issued") < F.col("proof")) & (F.col("proof") < F.col("start")) & F.col("result").isin("result_final", "result_corrected")
    return last.select("subject", F.coalesce(ready, F.lit(False)).alias("may_score"))


def daily_activity_stream(spark: SparkSession, path: str) -> DataFrame:
    """Counts and sums per day and event type of an event stream, with late rows accepted for two days."""
    schema = spark.read.parquet(path).schema
    glob = path if path.endswith("*") else path.rsplit("/", 1)[0] + "/" + path.rsplit("/", 1)[1].replace(".parquet", "*.parquet")
    events = spark.readStream.schema(schema).parquet(glob)
    at = F.col("ts").cast("timestamp")
    return (
        events.select(at.alias("at"), "event_type", "value").withWatermark("at", "2 days")
        .groupBy(F.window("at", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    )
