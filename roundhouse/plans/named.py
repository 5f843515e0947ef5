"""The named questions over any set of reference-shaped tables.

``tables`` is ``catalog.Tables`` (the test tables) or ``load.FinalTables`` (what
the ETL wrote); with the latter, questions on results and matches read the
pre-joined ``results_wide`` table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import params as P
from . import queries as Q


@dataclass(frozen=True)
class Choice:
    """What the questions are asked about."""

    event: int = P.EVENT_A
    player_event: int = P.EVENT_B
    year: int = P.YEAR_BEST
    matches_year: int = P.YEAR_MATCHES
    team: str = P.TEAM
    min_maps: int = P.MIN_MAPS
    forced_team: str = P.FORCED_TEAM


def named_questions(t, c: Choice = Choice()) -> dict[str, Callable[[], DataFrame]]:
    """Name -> builder of the lazy answer."""
    if hasattr(t, "rw"):
        r, m = (lambda: t.rw), (lambda: None)
    else:
        r, m = (lambda: t.r), (lambda: t.m)
    return {
        "most_matches_in_year": lambda: Q.most_matches_in_year(t.m, c.matches_year),
        "pistol_rounds": lambda: Q.pistol_rounds(t.e, c.event),
        "pistol_rounds_all": lambda: Q.pistol_rounds(t.e),
        "popular_map_in_event": lambda: Q.popular_map(t.r, c.event, exclude=Q.PLACEHOLDER_MAPS),
        "popular_map_overall": lambda: Q.popular_map(t.r),
        "best_player_by_rating": lambda: Q.best_player_by_rating(t.p, c.player_event),
        "winrate_on_map": lambda: Q.winrate_on_map(r(), m(), c.event),
        "avg_winrate": lambda: Q.avg_winrate(r(), m(), c.event),
        "matches_per_event": lambda: Q.matches_per_event(t.m, k=10),
        "best_team_of_year": lambda: Q.best_team_of_year(r(), m(), c.year),
        "overtime_teams": lambda: Q.overtime_teams(r(), m()),
        "kd_ratio": lambda: Q.kd_ratio(t.p),
        "map_distribution": lambda: Q.map_distribution(r(), m(), c.event),
        "match_wins": lambda: Q.match_wins(r(), m(), c.player_event),
        "players_min_maps": lambda: Q.players_min_maps(t.p, r(), m(), c.player_event, c.min_maps),
        "team_rounds_by_day": lambda: Q.team_rounds_by_day(r(), m(), c.team, c.year),
        "total_rounds": lambda: Q.total_rounds(r(), m(), c.event),
        "rating_vs_rounds": lambda: Q.rating_vs_rounds(r(), m(), t.p, c.event),
        "rounds_per_team_day": lambda: Q.rounds_per_team_day(r(), m(), c.event),
        "team_pool": lambda: Q.team_pool(t.m, t.ps, t.p, c.forced_team),
    }
