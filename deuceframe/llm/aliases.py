"""Problem 3: hand-typed event titles and places mapped to the event catalogue."""

from __future__ import annotations


from unicodedata import combining, normalize

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deuceframe.llm.bktree import within_distance
from deuceframe.sources.tables import table

#: A word in so many titles of the catalogue, or this share of them, names no event ("open", "cup").
GENERIC_TITLES, GENERIC_SHARE = 3, 0.02
#: Edits allowed by the length of the text, and the letters from which a word of a title names an event by itself (whole
#: titles and cities do at any length).
LIMITS = ((12, 3), (7, 2), (5, 1), (1, 0))
WORD_LETTERS = 4
#: Points of an exact find, and what an edit takes off: a name of the event itself, and its city.
NAME_POINTS, CITY_POINTS = (10, 3), (6, 2)
#: Copies of the finds for joining them to the values, so that a common value does not go to one task.
SALTS = 16

_SPLIT = regex.compile(r"[|/]")
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def fold(text: str) -> str:
    """Lower case, without accents and apostrophes, words apart by single spaces."""
    plain = "".join(c for c in normalize("NFKD", text) if not combining(c)).lower().replace("'", "").replace("’", "")
    return _NOT_WORD.sub(" ", plain).strip()


@F.pandas_udf(T.StringType())
def folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else fold(v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def variants(values: pd.Series) -> pd.Series:
    """What a typed value may name: its words, neighbours run together (a blank may be in the wrong place), and the
    whole of each of its parts without blanks."""

    def of(value: str | None) -> list[str]:
        out: dict[str, None] = {}
        for part in _SPLIT.split(value or ""):
            words = fold(part).split()
            out.update(dict.fromkeys(words))
            out.update(dict.fromkeys(a + b for a, b in zip(words, words[1:], strict=False)))
            out[("".join(words))] = None
        return [v for v in out if v]

    return values.map(of)


def edit_limit(text: Column) -> Column:
    out = F.lit(None).cast("int")
    for length, edits in reversed(LIMITS):
        out = F.when(F.length(text) >= length, F.lit(edits)).otherwise(out)
    return out


def catalogue_entries(catalogue: DataFrame) -> DataFrame:
    """(entry, event_id, is_name, is_base): the texts by which each event can be found.

    Names are the words of the titles that are neither generic nor short nor the city, and whole titles run together; a
    title that consists of its city and such words is a name only as a whole. is_base: not a second event of its city.
    """
    events = catalogue.select(
        "event_id",
        folded("event_city").alias("city"),
        folded("event_title").alias("title"),
        folded("event_past_title").alias("past"),
        (~F.coalesce(folded("mirror_tourney_name_norm"), F.lit("")).rlike(r" \d+$")).alias("is_base"),
    )
    titles = events.select(
        "event_id", "city", "is_base", F.explode(F.array_compact(F.array("title", "past"))).alias("title")
    )
    words = titles.select("event_id", "city", "is_base", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    enough = F.greatest(F.lit(float(GENERIC_TITLES)), GENERIC_SHARE * F.lit(float(events.count())))
    generic = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select("word")
    # a word is generic by a share of all titles, so there are at most words-per-title / GENERIC_SHARE of them
    own = words.join(F.broadcast(generic), "word", "left_anti").where(
        f"length(word) >= {WORD_LETTERS} and (city is null or not array_contains(split(city, ' '), word))"
    )
    no, yes = F.lit(False), F.lit(True)
    return (
        own.select(F.col("word").alias("entry"), "event_id", yes.alias("is_name"), "is_base")
        .unionByName(
            titles.select(F.regexp_replace("title", " ", "").alias("entry"), "event_id", yes.alias("is_name"), "is_base")
        )
        .unionByName(
            events.select(F.regexp_replace("city", " ", "").alias("entry"), "event_id", no.alias("is_name"), "is_base")
        )
        .where("length(entry) > 0")
        .distinct()
    )


def map_values(rows: DataFrame, key: str, fields: list[str], catalogue: DataFrame) -> DataFrame:
    """(key, event_id, points): for each row the catalogue's event that its typed fields name, or null if none.

    Points come from the nearest name and the nearest city of an event in any of the fields. Of equal events of a city
    the one a number in the values points at is taken (a value ending in "2" means the second), else the base event,
    else the smaller event_id. Null and empty fields say nothing; repeated keys are judged together; an empty catalogue
    matches nothing. Values of any length are compared whole.
    """
    typed = rows.select(F.col(key).alias("_key"), *[F.col(f).cast("string").alias(f) for f in fields])
    values = typed.select("_key", F.explode(F.array_compact(F.array(*fields))).alias("value"))
    asked = values.select("_key", F.explode(variants("value")).alias("text"))
    # words, in the sense of the catalogue, that name nothing need no search, and would be the longest lists
    entries = catalogue_entries(catalogue)
    finds = within_distance(
        asked.select("text", edit_limit(F.col("text")).alias("max_distance")), entries.select("entry")
    )
    salt = F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")
    spread = finds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = asked.withColumn("salt", salt).join(spread, ["text", "salt"]).join(entries, "entry")
    points = lambda p: F.lit(p[0]) - p[1] * F.col("distance")
    per_event = near.groupBy("_key", "event_id", "is_base").agg(
        F.max(F.when(F.col("is_name"), points(NAME_POINTS))).alias("name"),
        F.max(F.when(~F.col("is_name"), points(CITY_POINTS))).alias("city"),
    )
    second = values.groupBy("_key").agg(F.max(F.regexp_like(folded("value"), F.lit(r"\b2\b"))).alias("second"))
    scored = per_event.join(second, "_key").select(
        "_key",
        F.struct(
            (F.coalesce("name", F.lit(0)) + F.coalesce("city", F.lit(0))).alias("points"),
            (F.col("second") != F.col("is_base")).cast("int").alias("fits"),
            F.col("is_base").cast("int").alias("base"),
            (-F.col("event_id")).alias("minus_id"),
        ).alias("s"),
    )
    best = scored.groupBy("_key").agg(F.max("s").alias("s"))
    keys = rows.select(F.col(key).alias("_key")).distinct()
    return keys.join(best, "_key", "left").select(
        F.col("_key").alias(key), (-F.col("s.minus_id")).alias("event_id"), F.col("s.points").alias("points")
    )


FIELDS = ["td_location_values", "td_tournament_values"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "wta_event_alias_table").where("mirror_tourney_name_norm is null")
    mapped = map_values(rows, "alias_id", FIELDS, table(spark, folder, "event_catalog"))
    return mapped.select("alias_id", F.coalesce("event_id", F.lit(0)).cast("bigint").alias("event_id"))


def p3_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that somebody has resolved: how many of them the operator maps to the same event, to another, to none."""
    catalogue = table(spark, folder, "event_catalog")
    rows = table(spark, folder, "wta_event_alias_table").where("mirror_tourney_name_norm is not null")
    true = catalogue.select("mirror_tourney_name_norm", F.col("event_id").alias("true_id"))
    mapped = map_values(rows, "alias_id", FIELDS, catalogue)
    both = rows.select("alias_id", "mirror_tourney_name_norm").join(true, "mirror_tourney_name_norm").join(mapped, "alias_id")
    verdict = (
        F.when(F.col("event_id").isNull(), "none").when(F.col("event_id") == F.col("true_id"), "same").otherwise("other")
    )
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values of rows that belong to no event of the catalogue, and in how many such rows each occurs."""
    rows = table(spark, folder, "wta_event_alias_table")
    mapped = map_values(rows, "alias_id", FIELDS, table(spark, folder, "event_catalog"))
    none = rows.join(mapped.where("event_id is null").select("alias_id"), "alias_id")
    named = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]
    values = none.select(F.explode(F.array(*named)).alias("v")).select("v.*").where("value is not null")
    return values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {"p3_found": p3_found, "p3_agreement": p3_agreement, "p3_unmatched": p3_unmatched}
SQL: dict[str, str] = {}
