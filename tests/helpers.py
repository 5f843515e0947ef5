"""Builders of small reference-shaped frames for hand-made cases."""

import datetime as dt
from decimal import Decimal

M_SCHEMA = "match_id long, event_id int, match_date date, team_1 string, team_2 string, best_of int"
R_SCHEMA = ("match_id long, event_id int, map string, result_1 int, result_2 int, "
            "map_winner int, match_winner int")
P_SCHEMA = ("match_id long, event_id int, match_date date, player_name string, team string, "
            "kills int, deaths int, kddiff int, rating decimal(4,2)")


def d(s):
    return dt.date.fromisoformat(s)


def matches(spark, rows):
    """rows: (match_id, event_id, 'yyyy-mm-dd', team_1, team_2)."""
    return spark.createDataFrame([(a, b, d(c), t1, t2, 3) for a, b, c, t1, t2 in rows], M_SCHEMA)


def results(spark, rows):
    """rows: (match_id, event_id, map, result_1, result_2, match_winner)."""
    out = [(a, b, mp, r1, r2, 1 if (r1 or 0) > (r2 or 0) else 2, w) for a, b, mp, r1, r2, w in rows]
    return spark.createDataFrame(out, R_SCHEMA)


def players(spark, rows):
    """rows: (match_id, event_id, player, team, kills, deaths, rating as str or None)."""
    out = [(a, b, d("2016-04-10"), pl, tm, k, de, (k or 0) - (de or 0),
            Decimal(rt) if rt is not None else None) for a, b, pl, tm, k, de, rt in rows]
    return spark.createDataFrame(out, P_SCHEMA)
