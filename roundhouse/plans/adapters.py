"""Reference-shaped tables derived from the driver's TPC-H-like tables.

The reference reads match data (matches, results, players, economy, picks,
events). The test data is a TPC-H star, so each reference table is defined
here as a plain relational derivation over it; the DuckDB oracle in
``plans.oracle`` spells the same definitions in SQL. Every adapter is a lazy
plan: Catalyst prunes the columns a query does not use and pushes its
filters (event, date range) into these joins and the Parquet scans.

Mapping (fixed values of the derivation):
  match      = order;  match_id = o_orderkey; event_id = 2200 + o_custkey % 40
  match_date = o_orderdate as date; team_1 = customer nation name;
  team_2     = nation (c_nationkey + 1 + o_orderkey % 24) % 25
  match_winner: status F -> 1, O -> 2, P -> null
  best_of (text): 'o' for priority 5, else the priority's first digit
  result row = lineitem; map by l_partkey % 23: 0 'Default', 1 'Unknown',
               2 '', 3 null, else p_type; result_1 = quantity % 20,
               result_2 = l_partkey % 20
  player row = lineitem; player = supplier name, team = supplier nation,
               kills = quantity, deaths = l_partkey % 30,
               rating = (l_partkey % 200) / 100
  economy:   1_winner by o_orderkey % 3, 16_winner by (o_orderkey div 3) % 3:
             0 -> 1, 1 -> 2, 2 -> null
  events:    name null for id % 5 = 0, '' for 1, else '  Cup: <id>!! '
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_best_of, derive_winner
from ..sources.tables import TableSource

# fixed values of the derivation
EVENT_BASE = 2200
EVENT_COUNT = 40
MAP_NAMES = {0: "Default", 1: "Unknown", 2: ""}  # 3 -> NULL, other -> p_type
POOL_SIZE = 7


def event_of(custkey: Column) -> Column:
    return (F.lit(EVENT_BASE) + custkey % EVENT_COUNT).cast("int")


def _winner_of_status(status: Column) -> Column:
    return F.when(status == "F", F.lit(1)).when(status == "O", F.lit(2))


def _best_of_text(priority: Column) -> Column:
    digit = F.substring(priority, 1, 1)
    return F.when(digit == "5", F.lit("o")).otherwise(digit)


def _round_flag(x: Column) -> Column:
    return F.when(x == 0, F.lit(1)).when(x == 1, F.lit(2))


def _whole(x: str) -> Column:
    return F.floor(F.col(x)).cast("long")


def order_facts(src: TableSource) -> DataFrame:
    """Match-level columns that need only ``orders`` (no customer lookup)."""
    o = src.orders
    return o.select(
        F.col("o_orderkey").alias("match_id"),
        event_of(F.col("o_custkey")).alias("event_id"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        _winner_of_status(F.col("o_orderstatus")).alias("match_winner"),
    )


def match_lines(src: TableSource, orders: DataFrame | None = None) -> DataFrame:
    """What matches and economy rows are made of (see ``with_teams``), as narrow as they travel."""
    o = (src.orders if orders is None else orders).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = src.customer.select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("match_id"),
        event_of(F.col("o_custkey")).alias("event_id"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        _best_of_text(F.col("o_orderpriority")).alias("best_of_text"), "c_nationkey")


def with_teams(lines: DataFrame, src: TableSource) -> DataFrame:
    """The two teams of ``match_lines``."""
    n1 = src.nation.select(F.col("n_nationkey").alias("_n1"), F.col("n_name").alias("team_1"))
    n2 = src.nation.select(F.col("n_nationkey").alias("_n2"), F.col("n_name").alias("team_2"))
    # nation has a fixed 25 rows: AQE broadcasts it from its measured size
    j = lines.join(n1, F.col("c_nationkey") == F.col("_n1"))
    j = j.join(n2, ((F.col("c_nationkey") + 1 + F.col("match_id") % 24) % 25) == F.col("_n2"))
    return j.drop("c_nationkey", "_n1", "_n2")


def _match_base(src: TableSource, orders: DataFrame | None = None) -> DataFrame:
    return with_teams(match_lines(src, orders), src)


def matches(src: TableSource, orders: DataFrame | None = None) -> DataFrame:
    """matches(match_id, event_id, match_date, team_1, team_2, best_of); ``orders``
    may be a stream (customers and nations joined static)."""
    b = _match_base(src, orders)
    return b.select("match_id", "event_id", "match_date", "team_1", "team_2",
                    clean_best_of("best_of_text").alias("best_of"))


def economy(src: TableSource) -> DataFrame:
    """economy / economy_stage: one row per match with the two pistol-round winners."""
    return economy_columns(match_lines(src), src)


def economy_columns(lines: DataFrame, src: TableSource) -> DataFrame:
    """economy from ``match_lines``."""
    k = F.col("match_id")
    return with_teams(lines, src).select(
        "match_id", "event_id", F.col("match_date").alias("date"), "team_1", "team_2",
        F.col("best_of_text").alias("best_of"),
        _round_flag(k % 3).alias("1_winner"),
        _round_flag(F.call_function("div", k, F.lit(3)) % 3).alias("16_winner"),
    )


def results_of_lines(lines: DataFrame, src: TableSource) -> DataFrame:
    """Map-free result rows for any lineitem frame, batch or streaming (orders joined static)."""
    o = src.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    j = lines.select("l_orderkey", "l_partkey", "l_quantity").join(o, F.col("l_orderkey") == o.o_orderkey)
    r1 = (_whole("l_quantity") % 20).cast("int")
    r2 = (F.col("l_partkey") % 20).cast("int")
    return j.select(F.col("l_orderkey").alias("match_id"), event_of(F.col("o_custkey")).alias("event_id"),
                    r1.alias("result_1"), r2.alias("result_2"), derive_winner(r1, r2).alias("map_winner"),
                    _winner_of_status(F.col("o_orderstatus")).alias("match_winner"))


def results(src: TableSource, with_map: bool = True, detail: bool = False) -> DataFrame:
    """results(match_id, event_id, map, result_1, result_2, map_winner, match_winner), with
    ``detail`` also the nine columns no question reads (sides, ranks, map wins).

    ``map`` is the only column that needs ``part``; it is joined with a LEFT
    join (every lineitem stays a result row), so ``with_map=False`` returns
    exactly the same rows without the lineitem-sized join for questions that
    never look at the map.
    """
    return result_columns(result_lines(src, with_map, detail), detail)


def result_lines(src: TableSource, with_map: bool = True, detail: bool = False) -> DataFrame:
    """What results are made of (see ``result_columns``), as narrow as they travel."""
    li = src.lineitem.select("l_orderkey", "l_partkey", "l_quantity", *["l_suppkey"] * detail)
    o = src.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    j = li
    if with_map:
        p = src.part.select("p_partkey", "p_type")
        j = j.join(p, li.l_partkey == p.p_partkey, "left")
    # orders last: the output stays partitioned by the order key, which is the
    # key every later join with matches uses
    j = j.join(o, F.col("l_orderkey") == o.o_orderkey)
    cols = [F.col("l_orderkey").alias("match_id"), event_of(F.col("o_custkey")).alias("event_id")]
    if with_map:
        bucket = F.col("l_partkey") % 23
        map_col = (F.when(bucket == 0, F.lit(MAP_NAMES[0])).when(bucket == 1, F.lit(MAP_NAMES[1]))
                   .when(bucket == 2, F.lit(MAP_NAMES[2])).when(bucket == 3, F.lit(None).cast("string"))
                   .otherwise(F.col("p_type")))
        cols.append(map_col.alias("map"))
    return j.select(*cols, (_whole("l_quantity") % 20).cast("int").alias("result_1"),
                    _winner_of_status(F.col("o_orderstatus")).alias("match_winner"),
                    "l_partkey", *["l_suppkey"] * detail)


def result_columns(lines: DataFrame, detail: bool = False, keep: tuple = ()) -> DataFrame:
    """results from ``result_lines``; the columns named in ``keep`` are passed through."""
    r1, r2 = F.col("result_1"), (F.col("l_partkey") % 20).cast("int")
    cols = ["match_id", "event_id", *["map"] * ("map" in lines.columns), "result_1", r2.alias("result_2"),
            derive_winner(r1, r2).alias("map_winner"), "match_winner"]
    if detail:
        supplier, part = F.col("l_suppkey"), F.col("l_partkey")
        more = {"starting_ct": supplier % 2 + 1, "ct_1": F.floor(r1 / 2), "t_1": r1 - F.floor(r1 / 2),
                "ct_2": F.floor(r2 / 2), "t_2": r2 - F.floor(r2 / 2), "rank_1": supplier % 100 + 1,
                "rank_2": part % 100 + 1, "map_wins_1": supplier % 3, "map_wins_2": part % 3}
        cols += [x.cast("int").alias(name) for name, x in more.items()]
    return lines.select(*cols, *keep)


def players_stage(src: TableSource, detail: bool = False) -> DataFrame:
    """players_stage: one player line per lineitem, the date column still named ``date``;
    with ``detail`` also opponent, country, adr and kast, which no question reads."""
    return player_columns(player_lines(src), src, detail)


def player_lines(src: TableSource) -> DataFrame:
    """What player rows are made of (see ``player_columns``), as narrow as they travel."""
    li = src.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    o = src.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    s = src.supplier.select("s_suppkey", "s_name", "s_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, F.col("l_orderkey") == o.o_orderkey)
    return j.select(F.col("l_orderkey").alias("match_id"), event_of(F.col("o_custkey")).alias("event_id"),
                    F.col("o_orderdate").cast("date").alias("date"), F.col("s_name").alias("player_name"),
                    "s_nationkey", "l_partkey", _whole("l_quantity").cast("int").alias("kills"))


def player_columns(lines: DataFrame, src: TableSource, detail: bool = False) -> DataFrame:
    """players_stage from ``player_lines``: only region (5 rows) and nation (25) are joined."""
    n = src.nation.select("n_nationkey", "n_name", *["n_regionkey"] * detail)
    j = lines.join(n, F.col("s_nationkey") == n.n_nationkey)
    kills, deaths = F.col("kills"), (F.col("l_partkey") % 30).cast("int")
    rating = ((F.col("l_partkey") % 200).cast("decimal(4,0)") / 100).cast("decimal(4,2)")
    more = []
    if detail:
        other = src.nation.select(F.col("n_nationkey").alias("_other"), F.col("n_name").alias("opponent"))
        region = src.region.select("r_regionkey", F.col("r_name").alias("country"))
        j = (j.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
             .join(other, (F.col("s_nationkey") + 1 + F.col("match_id") % 24) % 25 == F.col("_other")))
        tenths = {"adr": 1500, "kast": 1000}
        more = ["opponent", "country", *[
            ((F.col("l_partkey") % top).cast("decimal(5,0)") / 10).cast("decimal(6,2)").alias(name)
            for name, top in tenths.items()]]
    return j.select(
        "match_id", "event_id", "date", "player_name",
        F.col("n_name").alias("team"),
        kills.alias("kills"), deaths.alias("deaths"),
        (kills - deaths).alias("kddiff"),
        rating.alias("rating"),
        *more,
    )


def players(src: TableSource, detail: bool = False) -> DataFrame:
    """players_raw: players_stage with ``date`` renamed to ``match_date``."""
    return players_stage(src, detail).withColumnRenamed("date", "match_date")


def event_table(src: TableSource) -> DataFrame:
    """events(event_id, event_name) with missing, empty and padded names."""
    ids = src.orders.select(event_of(F.col("o_custkey")).alias("event_id")).distinct()
    k = F.col("event_id") % 5
    name = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit(""))
            .otherwise(F.concat(F.lit("  Cup: "), F.col("event_id").cast("string"), F.lit("!! "))))
    return ids.select("event_id", name.alias("event_name"))


def picks_stage(src: TableSource) -> DataFrame:
    """picks: veto columns cycle through 'pool map 1' .. 'pool map 7' by o_orderkey."""
    return pick_columns(pick_lines(src))


def pick_lines(src: TableSource) -> DataFrame:
    """What picks are made of: rows of one match are in the order of their picks."""
    o = src.orders
    return o.select(F.col("o_orderkey").alias("match_id"), event_of(F.col("o_custkey")).alias("event_id"),
                    F.col("o_orderpriority").alias("system"))


def pick_columns(lines: DataFrame) -> DataFrame:
    """picks from ``pick_lines``."""
    cols = ["t1_removed_1", "t1_removed_2", "t1_removed_3", "t2_removed_1", "t2_removed_2",
            "t2_removed_3", "t1_picked_1", "t2_picked_1", "left_over"]
    out = ["match_id", "event_id", (F.col("match_id") % 2).cast("int").alias("inverted_teams"), "system"]
    for i, c in enumerate(cols):
        number = (F.col("match_id") + i) % POOL_SIZE + 1
        out.append(F.concat(F.lit("pool map "), number.cast("string")).alias(c))
    return lines.select(*out)


# --- the live parts, over the driver's ``events`` table -------------------
# events(event_id, ts, user_id, event_type, value, props '{"k": n}')

def _k(col: str = "props") -> Column:
    return F.from_json(F.col(col), "k INT").getField("k")


def samples(src: TableSource) -> DataFrame:
    """Gauge samples (ts, metric, value, ok) with the event id as tie-breaker."""
    ev = src.events
    return ev.select("event_id", "ts", F.col("event_type").alias("metric"), "value",
                     (_k() >= 10).alias("ok"))


# fixed values: change-log operation of each event type
CHANGE_OPS = {"signup": "insert", "view": "update", "error": "delete"}


def change_log(src: TableSource) -> DataFrame:
    """Change log (id, ts, seq, op, v): signup inserts k, view adds k, error deletes."""
    return change_log_rows(src.events)


def change_log_rows(ev: DataFrame, extra: tuple = ()) -> DataFrame:
    """The change-log mapping for any events frame, batch or streaming;
    ``extra`` columns of ``ev`` are passed through."""
    op = F.when(F.col("event_type") == "signup", F.lit("insert")) \
        .when(F.col("event_type") == "view", F.lit("update")) \
        .when(F.col("event_type") == "error", F.lit("delete"))
    return (ev.filter(F.col("event_type").isin(*CHANGE_OPS))
            .select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"),
                    op.alias("op"), F.when(op != "delete", _k()).alias("v"), *extra))


# fixed values: source priority of each event type (first source wins)
SOURCE_PRIORITY = {"click": 1, "purchase": 2, "view": 3}


def reading_rows(ev: DataFrame) -> DataFrame:
    """Readings (poll, priority, usd, eur, ts, event_id) of any events frame, batch or streaming."""
    ev = ev.filter(F.col("event_type").isin(*SOURCE_PRIORITY))
    pr = F.when(F.col("event_type") == "click", F.lit(1)) \
        .when(F.col("event_type") == "purchase", F.lit(2)).otherwise(F.lit(3))
    k = _k()
    return ev.select(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("poll"), pr.alias("priority"),
                     F.col("value").alias("usd"),
                     F.when(k >= 10, k.cast("double")).alias("eur"), "ts", "event_id")


def source_readings(src: TableSource) -> DataFrame:
    """One reading (usd, eur) per (hourly poll, source): the source's first event of the hour."""
    first = reading_rows(src.events).groupBy("poll", "priority").agg(
        F.min_by(F.struct("usd", "eur"), F.struct("ts", "event_id")).alias("_r"))
    return first.select("poll", "priority", "_r.usd", "_r.eur")


def account_log(src: TableSource) -> DataFrame:
    """The change log with what its insert stores besides the counter: the
    event's time and value (``opened_at``, ``opened_value``)."""
    log = change_log_rows(src.events, extra=("value",))
    ins = F.col("op") == "insert"
    return log.select("id", "ts", "seq", "op", "v", F.when(ins, F.col("ts")).alias("opened_at"),
                      F.when(ins, F.col("value")).alias("opened_value"))
