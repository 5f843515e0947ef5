"""Scalar column expressions of the reference."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values (must equal the reference's for equal results)
BEST_OF_SENTINEL = "o"                 # best_of text meaning "unknown"
SCORE_PER_KILL, SCORE_PER_DEATH = 10, 5
SLUG_PATTERN = r"[^A-Za-z0-9._-]+"     # replaced by "_", then "_" stripped at both ends
NO_TEAM = "—"                         # shown for a missing team in "player (team)"
EVENT_FALLBACK = "Event "              # name prefix when the event has no name


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def year_range(col, year: int) -> Column:
    """EXTRACT(YEAR FROM d) = year as a half-open range the Parquet reader can use."""
    c = _c(col)
    return (c >= F.lit(_dt.date(year, 1, 1))) & (c < F.lit(_dt.date(year + 1, 1, 1)))


def side_winner(flag, team_1="team_1", team_2="team_2") -> Column:
    """CASE WHEN flag = 1 THEN team_1 WHEN flag = 2 THEN team_2 END (no ELSE -> null)."""
    f = _c(flag)
    return F.when(f == 1, _c(team_1)).when(f == 2, _c(team_2))


def clean_best_of(col) -> Column:
    """NULLIF(best_of, 'o')::int; any other non-digit text fails the job (ANSI cast)."""
    return F.nullif(_c(col), F.lit(BEST_OF_SENTINEL)).cast("int")


def derive_winner(result_1="result_1", result_2="result_2") -> Column:
    """1 if the first side scored more rounds, else 2."""
    return F.when(_c(result_1) > _c(result_2), F.lit(1)).otherwise(F.lit(2))


def player_score(kills="kills", deaths="deaths") -> Column:
    """score = kills * 10 - deaths * 5 (value stored on insert)."""
    return _c(kills) * SCORE_PER_KILL - _c(deaths) * SCORE_PER_DEATH


def strip_blank(col) -> Column:
    """Remove leading and trailing white space (tabs and line breaks included)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def slug(col) -> Column:
    """Runs of characters outside [A-Za-z0-9._-] become '_', then '_' is stripped at both ends."""
    return F.btrim(F.regexp_replace(_c(col), SLUG_PATTERN, "_"), F.lit("_"))


def player_label(player="player_name", team="team") -> Column:
    """'player (team)'; the team shows as an em dash when null; null when the player is null."""
    return F.concat(_c(player), F.lit(" ("), F.coalesce(_c(team), F.lit(NO_TEAM)), F.lit(")"))


def event_name(event_id="event_id", name="event_name") -> Column:
    """Display name: stripped name, or 'Event <id>' when the name is missing or empty."""
    n = _c(name)
    fallback = F.concat(F.lit(EVENT_FALLBACK), _c(event_id).cast("string"))
    return F.when(n.isNull() | (n == ""), fallback).otherwise(strip_blank(n))
