"""Settlement, ledger, streams, readers and sinks."""

import io
import tarfile
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deuceframe.sources import files
from deuceframe.streaming import settlement as S


def test_settlement_batch_and_stream_agree(spark, tmp_path):
    rows = [("m1", 0, "a"), ("m1", 1, "a"), ("m1", 2, "b"), ("m2", 0, "a"), ("m2", 0, "a"), ("m3", 0, "a"), ("m3", 1, "b"), ("m3", 3, "b"), (None, 0, "a"), ("m4", 1, None)]
    df = spark.createDataFrame(rows, "subject string, revision long, content string")
    want = sorted([("m1", 0, "result_provisional"), ("m1", 1, "result_final"), ("m1", 2, "result_corrected"), ("m2", 0, "result_provisional"),
                   ("m3", 0, "result_provisional"), ("m3", 1, "result_provisional"), ("m3", 3, "result_final")])
    assert sorted((r.subject, r.revision, r.kind) for r in S.settle_batch(df).collect()) == want
    for i in range(4):
        df.where(f"revision = {i} and subject is not null and content is not null").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = S.run_available(S.settle_stream(stream), f"settled_{uuid.uuid4().hex}")
    assert sorted((r.subject, r.revision, r.kind) for r in got.collect()) == want
    assert S.settle_batch(df.where("false")).count() == 0


def _daily_files(spark, folder, rows):
    df = spark.createDataFrame(rows, "subject string, day int, value double").withColumn("at", F.timestamp_seconds(F.col("day") * 86400))
    days = sorted({r[1] for r in rows})
    for i, d in enumerate(days):
        df.where(f"day = {d}").drop("day").coalesce(1).write.parquet(f"{folder}/in/{i:02d}")
    return spark.readStream.schema(df.drop("day").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_rows_are_released_two_days_later(spark, tmp_path):
    rows = [("p", d, float(d)) for d in range(10, 20)] + [("q", 12, 1.0), ("q", 18, 2.0), (None, 13, 1.0)]
    out = S.run_available(S.released_stream(_daily_files(spark, tmp_path, rows)), f"released_{uuid.uuid4().hex}")
    got = sorted((r.subject, r.value) for r in out.collect())
    newest = max(d for _, d, _ in rows)
    assert got == sorted((s, v) for s, d, v in rows if s and d <= newest - 2)


def test_decayed_state(spark, tmp_path):
    rows = [("p", 0, 8.0), ("p", 10, 2.0), ("p", 20, 1.0), ("q", 10, 5.0)]
    out = S.run_available(S.decayed_stream(_daily_files(spark, tmp_path, rows), half_life=10.0), f"decayed_{uuid.uuid4().hex}")
    got = sorted((r.subject, int(r["at"].timestamp() // 86400), round(r.before, 9)) for r in out.collect())
    assert got == [("p", 0, 0.0), ("p", 10, 4.0), ("p", 20, 3.0), ("q", 10, 0.0)]


def test_ledger(spark):
    kinds = ["fixture_proposed", "fixture_qualified", "forecast_issued", "result_provisional", "result_final"]
    df = spark.createDataFrame([("L", i + 1, k, "s", str(i)) for i, k in enumerate(kinds)], "ledger string, seq long, kind string, subject string, payload string")
    ledger = S.chained(df, "genesis")
    assert S.ledger_faults(ledger, "genesis").count() == 0
    tampered = ledger.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    assert {(r.seq, r.fault) for r in S.ledger_faults(tampered, "genesis").collect()} == {(3, "content_digest")}
    assert {r.fault for r in S.ledger_faults(ledger.where("seq <> 2"), "genesis").collect()} >= {"chain", "sequence", "missing_prerequisite"}
    twice = S.chained(df.union(df.where("seq = 5").withColumn("seq", F.lit(6))), "genesis")
    assert [(r.seq, r.fault) for r in S.ledger_faults(twice, "genesis").collect()] == [(6, "forbidden")]
    times = [("s", "forecast_issued", 1), ("s", "proof_verified", 2), ("s", "start_verified", 3), ("s", "result_final", 4), ("t", "forecast_issued", 5), ("t", "proof_verified", 2)]
    rec = spark.createDataFrame(times, "subject string, kind string, n int").withColumn("at", F.timestamp_seconds("n"))
    assert {r.subject: r.may_score for r in S.scoring_barrier(rec).collect()} == {"s": True, "t": False}


def test_csv_header_drift_fails(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.csv").write_text("a,c\n1,2\n")
    assert files.with_line_numbers(files.read_csv(spark, str(tmp_path / "ok.csv"), schema)).first().b == "2"
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_archives_and_workbooks(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name, body in (("d/one.csv", b"a,b\n"), ("d/skip.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    members = files.tar_members(spark, str(tmp_path / "x.tar"))
    assert [r.member for r in members.collect()] == ["d/one.csv"]
    pins = spark.createDataFrame([("d/one.csv", "0"), ("d/two.csv", "0")], "member string, expected string")
    assert {r.member: r.state for r in files.verify_inventory(members, pins).collect()} == {"d/one.csv": "changed", "d/two.csv": "missing"}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>W</t></is></c></row><row r="2"><c r="A2"><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si></sst>")
    assert files.read_workbooks(spark, str(tmp_path / "x.xlsx")).first().cells == {"Date": "3", "W": ""}


def test_pages_and_draws(spark):
    html = "<table><tr><th>Date</th><td>10 &ndash; 16 January 2022</td></tr></table>"
    df = spark.createDataFrame([(html,), ("<p>none</p>",), (None,)], "h string")
    assert [r[0] for r in df.select(files.infobox_date(F.col("h"))).collect()] == ["2022-01-16", None, None]
    text = "{{8TeamBracket\n| RD1-team01 = '''[[Ana Ríos|A Ríos]]'''\n| RD1-seed01 = 1\n| RD1-score01-1 = '''6'''\n| RD1-score01-2 = 7<sup>7</sup>\n| RD1-team02 = B Novak\n| RD1-score02-1 = 4\n| RD1-score02-2 = 6<sup>3</sup>\n| RD1-team03 = C\n| RD1-team04 = Bye\n}}"
    spark.udtf.register("draw_matches", files.DrawMatches)
    spark.createDataFrame([(text,), (None,)], "t string").createOrReplaceTempView("draws")
    got = spark.sql("select d.* from draws, lateral draw_matches(t) d").collect()
    assert [(r.team_a, r.team_b, r.seed_a, r.winner, r.score, r.status) for r in got] == [("A Ríos", "B Novak", "1", "a", "6-4 7-6", "completed")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.0, True), (1, 2.0, None)], "k int, x double, a_won boolean")
    files.write_with_labels_apart(df, str(tmp_path / "out"), ["k"], ["a_won"])
    assert "a_won" not in spark.read.parquet(str(tmp_path / "out/features")).columns
    assert files.without_outcome(df, ["k"]).columns == ["k", "outcome_known"]
    with pytest.raises(ValueError):
        files.without_outcome(df, ["a_won"])
    h = lambda d: files.membership_hash(d, ["k"]).first()
    assert h(df) == h(df.orderBy("k").union(df)) and h(df) != h(df.limit(1))
