"""Expressions on score texts, rounds and result status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders of the rounds: for sorting, and as a depth (fixed values).
ROUND_SORT = {"Q1": 0, "Q2": 1, "Q3": 2, "Q4": 3, "ER": 4, "RR": 5, "R128": 6, "R64": 7, "R32": 8, "R16": 9, "QF": 10, "SF": 11, "BR": 12, "F": 13}
ROUND_DEPTH = {"Q1": -4, "Q2": -3, "Q3": -2, "Q4": -1, "ER": -1, "R128": 0, "R64": 1, "R32": 2, "R16": 3, "RR": 3, "QF": 4, "SF": 5, "BR": 6, "F": 6}
#: Words of the rounds counted from the start of the draw (fixed values).
EARLY_WORDS = ("1st Round", "2nd Round", "3rd Round", "4th Round")
LATE_WORDS = {"QF": "Quarterfinals", "SF": "Semifinals", "F": "The Final", "RR": "Round Robin"}
SET_TOKEN = r"^\[?[0-9]+-[0-9]+\]?(\([0-9]+\))?[?]?$"


def lookup(value: Column, table: dict, default=None) -> Column:
    """A literal map as an expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def score_status(score: Column) -> Column:
    """walkover, retired, defaulted, abandoned or completed, by the marks in the text; unknown without any set."""
    score = F.regexp_replace(score, "&nbsp;", " ")
    words = F.transform(F.split(F.upper(F.trim(score)), r"\s+"), lambda w: F.rtrim(w, F.lit(".")))
    has = lambda *marks: F.arrays_overlap(words, F.array(*[F.lit(m) for m in marks]))
    sets = F.size(F.filter(F.split(F.trim(score), r"\s+"), lambda t: F.regexp_like(t, F.lit(SET_TOKEN))))
    return (
        F.when(score.isNull(), None)
        .when(has("W/O", "WALKOVER"), "walkover")
        .when(has("RET", "RE"), "retired")
        .when(has("DEF", "DEFAULT"), "defaulted")
        .when(has("PLAYED", "ABANDONED", "ABD", "UNFINISHED"), "abandoned")
        .when(sets == 0, "unknown")
        .otherwise("completed")
    )


def archive_status(score: Column) -> Column:
    """The archive's own labels; a text with other letters, or without any, is unknown."""
    text = F.upper(F.trim(score))
    return (
        F.when((text == "WALKOVER") | text.contains("W/O"), "walkover")
        .when(F.regexp_like(text, F.lit(r"\bRET\b")), "retired")
        .when(F.regexp_like(text, F.lit(r"\bDEF(AULT)?\b")), "default")
        .when(F.regexp_like(text, F.lit(r"\b(ABN|ABD|ABANDONED)\b")), "abandoned")
        .when(F.coalesce(text, F.lit("")).eqNullSafe("") | F.regexp_like(text, F.lit("[A-Z]")), "unknown")
        .otherwise("completed")
    )


def score_sets(score: Column) -> Column:
    """array<struct<bracket, x, y, tiebreak>> of the set tokens, in order."""
    tokens = F.filter(F.split(F.trim(score), r"\s+"), lambda t: F.regexp_like(t, F.lit(SET_TOKEN)))
    number = lambda t, g: F.regexp_extract(t, r"^\[?([0-9]+)-([0-9]+)", g).cast("int")
    return F.transform(
        tokens,
        lambda t: F.struct(
            t.startswith("[").alias("bracket"),
            number(t, 1).alias("x"),
            number(t, 2).alias("y"),
            t.contains("(").alias("tiebreak"),
        ),
    )


def score_totals(score: Column) -> Column:
    """struct<games_won, games_lost, sets_won, sets_lost> from the winner's side.

    A match tiebreak in brackets is one game and one set. Unless the match was completed, its last set counts as a set
    only if it was finished. A walkover counts nothing.
    """
    status = score_status(score)
    sets = score_sets(score)
    zero = F.lit(0)

    def part(s: Column, i: Column, kind: str) -> Column:
        won, lost = s.x > s.y, s.x < s.y
        high, low = F.greatest(s.x, s.y), F.least(s.x, s.y)
        last = i == F.size(sets) - 1
        finished = ((high >= 6) & (high - low >= 2)) | ((high == 7) & (low == 6)) | s.tiebreak
        complete = s.bracket | (status == "completed") | ~last | finished
        return {
            "games_won": F.when(s.bracket, won.cast("int")).otherwise(s.x),
            "games_lost": F.when(s.bracket, lost.cast("int")).otherwise(s.y),
            "sets_won": (complete & won).cast("int"),
            "sets_lost": (complete & lost).cast("int"),
        }[kind]

    def total(kind: str) -> Column:
        parts = F.transform(sets, lambda s, i: part(s, i, kind))
        summed = F.aggregate(parts, zero, lambda acc, v: acc + v)
        return F.when(status == "walkover", zero).otherwise(summed)

    return F.struct(*[total(k).alias(k) for k in ("games_won", "games_lost", "sets_won", "sets_lost")])


def winner_game_share(score: Column) -> Column:
    """The winner's share of the games, match tiebreaks left out; null without games."""
    plain = F.filter(score_sets(score), lambda s: ~s.bracket)
    won = F.aggregate(F.transform(plain, lambda s: s.x), F.lit(0), lambda a, v: a + v)
    lost = F.aggregate(F.transform(plain, lambda s: s.y), F.lit(0), lambda a, v: a + v)
    return F.when(won + lost > 0, won / (won + lost))


def round_word(round_code: Column, draw_size: Column) -> Column:
    """The word of a round counted from the start of the draw, whose first round has a power of two of places, byes
    included: R16 of a draw of 28 or 32 is the 2nd Round."""
    size = F.regexp_extract(round_code, "^R([0-9]+)$", 1)
    n = F.when(size != "", size.cast("int"))
    full = F.when(draw_size < 1, None)
    for places in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        full = full.when(draw_size <= places, places)
    early = [F.when(F.shiftright(full, i) == n, word) for i, word in enumerate(EARLY_WORDS)]
    return F.coalesce(lookup(round_code, LATE_WORDS), *early)


def sets_text(score: Column) -> Column:
    """The games of the sets as x-y, in order: what two sources must agree on, tiebreaks and marks left out."""
    return F.array_join(F.transform(score_sets(score), lambda s: F.concat_ws("-", s.x, s.y)), " ")


def normal_score(text: Column) -> Column:
    """An archive's form of a score in free text: plain hyphens, one blank between sets, tiebreaks in round brackets, no
    sets without games, RET and W/O for the words of a retirement or walkover; an empty text is null."""
    plain = F.regexp_replace(F.translate(F.regexp_replace(text, "&nbsp;|\u00a0", " "), "\u2010\u2011\u2012\u2013\u2014\u2212", "------"), r"\s*-\s*", "-")
    low = F.regexp_replace(plain, r"(?i)\b(retired|ret'd|ret)\b\.?", "RET")
    low = F.regexp_replace(low, r"(?i)\b(walkover|w/o|wo)\b\.?", "W/O")
    low = F.regexp_replace(low, r"[,;]", " ")
    low = F.regexp_replace(low, r"(^|\s)0-0(?=\s|$)", " ")
    out = F.trim(F.regexp_replace(low, r"\s+", " "))
    return F.when(out != "", out)


def entry_code(value: Column) -> Column:
    return F.upper(F.trim(value))
