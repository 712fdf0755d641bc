"""Readers of delivered files: typed CSV, archives, workbooks, pages and draws; and sinks."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A CSV (or .csv.gz) with exactly this header; any drift of the header or a malformed row fails. All cells are text
    until the caller casts them; only selected columns are parsed, and filters reach the scan."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(texts).csv(path)


def with_line_numbers(rows: DataFrame) -> DataFrame:
    """The file and a number that rises with the line, for rules such as "the first row of a key wins"."""
    return rows.select("*", F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("line"))


def without_outcome(rows: DataFrame, allowed: list[str], outcome: str = "a_won") -> DataFrame:
    """A closed list of columns, and whether the outcome is known, but never the outcome."""
    if outcome in allowed:
        raise ValueError(f"{outcome} may not pass")
    return rows.select(*allowed, F.col(outcome).isNotNull().alias("outcome_known"))


def tar_members(spark: SparkSession, path: str, pattern: str = r".*\.csv$") -> DataFrame:
    """(archive, member, sha256, content) of the members of tar archives whose name matches."""
    wanted = re.compile(pattern)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf.path, pdf.content, strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and wanted.match(m.name):
                            yield pd.DataFrame({"archive": [archive], "member": [m.name], "content": [tar.extractfile(m).read()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(unpack, "archive string, member string, content binary")
    return out.select("archive", "member", F.sha2("content", 256).alias("sha256"), "content")


def verify_inventory(members: DataFrame, inventory: DataFrame) -> DataFrame:
    """(member, state): intact, changed, missing or unlisted against pinned digests (member, expected)."""
    both = members.select("member", "sha256").join(inventory, "member", "full")
    state = (
        F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unlisted")
        .when(F.col("sha256") == F.col("expected"), "intact").otherwise("changed")
    )
    return both.select("member", state.alias("state"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _sheet_rows(content: bytes) -> list[dict[str, str]]:
    """The first sheet's rows by header; formulas and repeated headers are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        sheet = ElementTree.fromstring(book.read(sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells: dict[str, str] = {}
        for cell in row.findall("m:c", _NS):
            if cell.find("m:f", _NS) is not None:
                raise ValueError("a workbook cell holds a formula")
            value = cell.find("m:v", _NS)
            inline = cell.find("m:is", _NS)
            text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else (value.text or "" if value is not None else "")
            if cell.get("t") == "s" and text:
                text = shared[int(text)]
            cells[re.match("[A-Z]+", cell.get("r")).group()] = text
        rows.append(cells)
    if not rows:
        return []
    header = rows[0]
    if len(set(header.values())) != len(header):
        raise ValueError("a workbook header is repeated")
    return [{name: r.get(column, "") for column, name in header.items()} for r in rows[1:]]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells map<string,string>) of .xlsx files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                rows = _sheet_rows(content)
                yield pd.DataFrame({"path": [p] * len(rows), "row": list(range(2, len(rows) + 2)), "cells": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row int, cells map<string,string>")


def infobox_date(html: Column) -> Column:
    """The last day of the date range in a page's info box, as yyyy-MM-dd text; null without one."""
    cell = F.regexp_extract(html, r"(?is)<th[^>]*>\s*Dates?\s*</th>\s*<td[^>]*>(.*?)</td>", 1)
    plain = F.regexp_replace(F.regexp_replace(cell, r"<[^>]+>", ""), r"&[a-z]+;|&#\d+;", " ")
    day = F.regexp_extract(plain, r"(\d{1,2})\s+([A-Za-z]+)\s*,?\s*(\d{4})\s*$", 1)
    month = F.regexp_extract(plain, r"(\d{1,2})\s+([A-Za-z]+)\s*,?\s*(\d{4})\s*$", 2)
    year = F.regexp_extract(plain, r"(\d{1,2})\s+([A-Za-z]+)\s*,?\s*(\d{4})\s*$", 3)
    text = F.concat_ws(" ", day, month, year)
    return F.when(day != "", F.date_format(F.try_to_timestamp(text, F.lit("d MMMM yyyy")), "yyyy-MM-dd"))


_PARAMETER = re.compile(r"\|\s*RD(\d+)-(team|seed|score)(\d+)(?:-(\d+))?\s*=\s*((?:\[\[[^\]]*\]\]|[^\n|])*)")


def _plain_cell(text: str) -> str:
    text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    return re.sub(r"<[^>]+>.*?</[^>]+>|'{2,}", "", text).strip()


@F.udtf(returnType="rd int, pair int, team_a string, team_b string, seed_a string, seed_b string, winner string, score string, status string")
class DrawMatches:
    """The matches of a draw in wikitext: neighbouring slots play, the bold team won, small marks end a match early."""

    def eval(self, text: str):
        slots: dict[tuple[int, int], dict] = {}
        for rd, kind, slot, part, value in _PARAMETER.findall(text or ""):
            cell = slots.setdefault((int(rd), int(slot)), {"sets": {}})
            if kind == "score":
                cell["sets"][int(part or 1)] = value
            else:
                cell[kind] = value
        for (rd, slot), a in sorted(slots.items()):
            b = slots.get((rd, slot + 1))
            if slot % 2 == 0 or b is None:
                continue
            names = [_plain_cell(x.get("team", "")) for x in (a, b)]
            if not all(names) or "bye" in (n.lower() for n in names):
                continue
            bold = ["'''" in x.get("team", "") for x in (a, b)]
            winner = "a" if bold[0] and not bold[1] else "b" if bold[1] and not bold[0] else None
            sets, status = [], "completed"
            for k in sorted(set(a["sets"]) | set(b["sets"])):
                raw = [x["sets"].get(k, "") for x in (a, b)]
                joined = " ".join(raw).lower()
                if "w/o" in joined:
                    status = "walkover"
                elif re.search(r"\br\b|ret", _plain_cell(joined)) or "sup>r" in joined.replace(" ", ""):
                    status = "retired"
                games = [re.match(r"\d+", _plain_cell(re.sub(r"<sup>.*?</sup>", "", x))) for x in raw]
                if all(games):
                    sets.append("-".join(g.group() for g in games))
            yield (
                rd, (slot + 1) // 2, names[0], names[1], _plain_cell(a.get("seed", "")), _plain_cell(b.get("seed", "")), winner, " ".join(sets), status,
            )


def write_sorted(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet whose files are sorted by key, so that equal input gives equal files."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_with_labels_apart(rows: DataFrame, path: str, key: list[str], labels: list[str]) -> None:
    """Features and labels in folders of their own, so that a reader of features cannot see an outcome."""
    write_sorted(rows.drop(*labels), f"{path}/features", key)
    write_sorted(rows.select(*key, *labels), f"{path}/labels", key)


def membership_hash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(n, digest) of a set of keys, whatever their order and partitions: sums of digests, not a list of keys."""
    h = F.sha2(F.to_json(F.struct(*keys)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = rows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))
