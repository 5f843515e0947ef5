"""Schemas of the reference's tables (types inferred from their use)."""

from pyspark.sql import types as T

_I, _L, _S, _D = T.IntegerType(), T.LongType(), T.StringType(), T.DateType()


def _f(name, typ):
    return T.StructField(name, typ, True)


ECONOMY_STAGE = T.StructType([
    _f("match_id", _L), _f("event_id", _I), _f("date", _D), _f("team_1", _S),
    _f("team_2", _S), _f("best_of", _S), _f("1_winner", _I), _f("16_winner", _I),
])

PICKS_STAGE = T.StructType(
    [_f("match_id", _L), _f("event_id", _I), _f("inverted_teams", _I), _f("system", _S)]
    + [_f(c, _S) for c in (
        "t1_removed_1", "t1_removed_2", "t1_removed_3",
        "t2_removed_1", "t2_removed_2", "t2_removed_3",
        "t1_picked_1", "t2_picked_1", "left_over")]
)

PLAYERS_STAGE = T.StructType([
    _f("match_id", _L), _f("event_id", _I), _f("date", _D), _f("player_name", _S),
    _f("team", _S), _f("opponent", _S), _f("country", _S), _f("kills", _I),
    _f("deaths", _I), _f("adr", T.DecimalType(6, 2)), _f("kast", T.DecimalType(6, 2)),
    _f("kddiff", _I), _f("rating", T.DecimalType(4, 2)),
])

RESULTS_STAGE = T.StructType(
    [_f("match_id", _L), _f("event_id", _I), _f("map", _S)]
    + [_f(c, _I) for c in (
        "result_1", "result_2", "map_winner", "match_winner", "starting_ct",
        "ct_1", "t_1", "ct_2", "t_2", "rank_1", "rank_2", "map_wins_1", "map_wins_2")]
)

MATCHES = T.StructType([
    _f("match_id", _L), _f("event_id", _I), _f("match_date", _D),
    _f("team_1", _S), _f("team_2", _S), _f("best_of", _I),
])

EVENTS = T.StructType([_f("event_id", _I), _f("event_name", _S)])

PLAYER_STATS = T.StructType([
    _f("id", _L), _f("player_name", _S), _f("kills", _I), _f("deaths", _I), _f("score", _I),
])

# long form of the polled gauges: one row per (time, metric)
SAMPLES = T.StructType([
    _f("ts", T.TimestampType()), _f("metric", _S), _f("value", T.DoubleType()),
    _f("ok", T.BooleanType()),
])
