"""Registry of driver queries: name -> (spark, sf_dir) -> DataFrame.

Each entry reads the test tables through ``plans.adapters`` and calls one
operator or named query with the parameters of ``plans.params``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_best_of, derive_winner, event_name, player_score, slug
from ..operators import changes as C
from ..operators import etl as E
from ..operators import quantiles as QT
from ..operators import report as R
from ..operators import samples as W
from ..operators.shape import two_sided
from ..operators.topk import random_pick
from ..sources import sinks as S
from ..sources.dated import read_retained, retain_stored, write_dated
from ..sources.files import payload_fields, payload_variant, read_csv_quarantined
from ..sources.tables import TableSource
from ..streaming import streams as ST
from . import adapters as A
from . import params as P
from . import queries as Q


class Tables:
    """Reference-shaped tables of one data folder (lazy plans, nothing cached)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.src = TableSource(spark, sf_dir)

    @property
    def m(self) -> DataFrame:
        return A.matches(self.src)

    @property
    def r(self) -> DataFrame:
        return A.results(self.src)

    @property
    def rc(self) -> DataFrame:
        """results without the map column (no join with part)."""
        return A.results(self.src, with_map=False)

    @property
    def p(self) -> DataFrame:
        return A.players(self.src)

    @property
    def ps(self) -> DataFrame:
        return A.players_stage(self.src)

    @property
    def e(self) -> DataFrame:
        return A.economy(self.src)

    @property
    def ev(self) -> DataFrame:
        return A.event_table(self.src)


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Callable[[Tables], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        REGISTRY[name].__doc__ = fn.__doc__
        return fn
    return deco


# --- numbered SQL queries --------------------------------------------------

@register("most_matches_in_year")
def _(t: Tables):
    return Q.most_matches_in_year(t.m, P.YEAR_MATCHES)


@register("most_matches_in_year_groups")
def _(t: Tables):
    return Q.most_matches_in_year(t.m, P.YEAR_MATCHES, k=None)


@register("pistol_rounds")
def _(t: Tables):
    return Q.pistol_rounds(t.e, P.EVENT_A)


@register("pistol_rounds_all")
def _(t: Tables):
    return Q.pistol_rounds(t.e, None)


@register("pistol_rounds_groups")
def _(t: Tables):
    return Q.pistol_rounds(t.e, None, k=None)


@register("popular_map_in_event")
def _(t: Tables):
    return Q.popular_map(t.r, P.EVENT_A, exclude=Q.PLACEHOLDER_MAPS)


@register("popular_map_overall")
def _(t: Tables):
    return Q.popular_map(t.r)


@register("map_counts_overall")
def _(t: Tables):
    return Q.popular_map(t.r, k=None)


@register("best_player_by_rating")
def _(t: Tables):
    return Q.best_player_by_rating(t.p, P.EVENT_B)


@register("best_player_by_rating_groups")
def _(t: Tables):
    return Q.best_player_by_rating(t.p, None, k=None)


@register("winrate_on_map")
def _(t: Tables):
    return Q.winrate_on_map(t.r, t.m, P.EVENT_A)


@register("winrate_on_map_groups")
def _(t: Tables):
    return Q.winrate_on_map(t.r, t.m, None, k=None)


@register("avg_winrate")
def _(t: Tables):
    return Q.avg_winrate(t.rc, t.m, P.EVENT_A)


@register("avg_winrate_groups")
def _(t: Tables):
    return Q.avg_winrate(t.rc, t.m, None, k=None)


@register("matches_per_event_all")
def _(t: Tables):
    return Q.matches_per_event(t.m)


@register("matches_per_event")
def _(t: Tables):
    return Q.matches_per_event(t.m, k=10)


@register("best_team_of_year")
def _(t: Tables):
    return Q.best_team_of_year(t.rc, t.m, P.YEAR_BEST)


@register("best_team_of_year_groups")
def _(t: Tables):
    return Q.best_team_of_year(t.rc, t.m, P.YEAR_BEST, k=None)


@register("overtime_teams")
def _(t: Tables):
    return Q.overtime_teams(t.rc, t.m)


@register("overtime_teams_groups")
def _(t: Tables):
    return Q.overtime_teams(t.rc, t.m, k=None)


@register("kd_ratio")
def _(t: Tables):
    return Q.kd_ratio(t.p)


@register("kd_ratio_groups")
def _(t: Tables):
    return Q.kd_ratio(t.p, k=None)


# --- report queries ---------------------------------------------------------

@register("map_distribution")
def _(t: Tables):
    return Q.map_distribution(t.r, t.m, P.EVENT_A)


@register("map_share")
def _(t: Tables):
    return R.share_of_total(Q.map_distribution(t.r, t.m, P.EVENT_A), "maps_played")


@register("match_wins")
def _(t: Tables):
    return Q.match_wins(t.rc, t.m, P.EVENT_B)


@register("match_wins_groups")
def _(t: Tables):
    return Q.match_wins(t.rc, t.m, P.EVENT_B, k=None)


@register("players_min_maps")
def _(t: Tables):
    return Q.players_min_maps(t.p, t.rc, t.m, P.EVENT_B, P.MIN_MAPS)


@register("players_min_maps_groups")
def _(t: Tables):
    return Q.players_min_maps(t.p, t.rc, t.m, P.EVENT_B, P.MIN_MAPS, k=None)


@register("player_labels")
def _(t: Tables):
    return Q.player_labels(Q.players_min_maps(t.p, t.rc, t.m, P.EVENT_B, P.MIN_MAPS))


@register("team_rounds_by_day")
def _(t: Tables):
    return Q.team_rounds_by_day(t.rc, t.m, P.TEAM, P.YEAR_BEST)


@register("total_rounds")
def _(t: Tables):
    return Q.total_rounds(t.rc, t.m, P.EVENT_A)


@register("rounds_histogram")
def _(t: Tables):
    return R.equal_width_histogram(Q.total_rounds(t.rc, t.m, P.EVENT_A), "total_rounds", P.HIST_BINS, digits=6)


@register("rounds_by_bin_width")
def _(t: Tables):
    return R.fixed_width_bins(Q.total_rounds(t.rc, t.m, P.EVENT_A), "total_rounds", P.BIN_WIDTH)


@register("rounds_auto_bins")
def _(t: Tables):
    return R.nice_width_bins(Q.total_rounds(t.rc, t.m, P.EVENT_A), "total_rounds", P.MAX_BINS)


@register("rating_vs_rounds_left")
def _(t: Tables):
    return Q.rating_vs_rounds(t.rc, t.m, t.p, P.EVENT_A, drop_null=False)


@register("rating_vs_rounds")
def _(t: Tables):
    return Q.rating_vs_rounds(t.rc, t.m, t.p, P.EVENT_A)


@register("rounds_per_team_day")
def _(t: Tables):
    return Q.rounds_per_team_day(t.rc, t.m, P.EVENT_A)


@register("rounds_pivot")
def _(t: Tables):
    return Q.rounds_pivot(Q.rounds_per_team_day(t.rc, t.m, P.EVENT_A), P.TEAM_LABELS)


@register("team_labels")
def _(t: Tables):
    return Q.team_labels(Q.rounds_per_team_day(t.rc, t.m, P.EVENT_A))


@register("team_pool")
def _(t: Tables):
    return Q.team_pool(t.m, t.ps, t.p, P.FORCED_TEAM)


def _rating_sheet(t: Tables):
    return Q.players_min_maps(t.p, t.rc, t.m, P.EVENT_B, P.MIN_MAPS, k=None)


@register("column_anchors")
def _(t: Tables):
    return R.column_anchors(_rating_sheet(t))  # numeric columns detected as the workbook does


@register("colour_position")
def _(t: Tables):
    return R.colour_position(_rating_sheet(t), "avg_rating", digits=6)


def report_sheets(t, event_a: int = P.EVENT_A, event_b: int = P.EVENT_B, min_maps: int = P.MIN_MAPS) -> dict:
    """The workbook's three sheets, named after the slugged event names."""
    ids = t.spark.createDataFrame([(event_a,), (event_b,)], "event_id int").distinct()
    named = Q.event_names(ids, t.ev).select("event_id", slug("event_name").alias("s"))
    slugs = {r["event_id"]: r["s"] for r in named.collect()}  # two names
    return {
        f"maps_{slugs[event_a]}": Q.map_distribution(t.r, t.m, event_a),
        f"team_wins_{slugs[event_b]}": Q.match_wins(t.rc, t.m, event_b),
        f"players_rating_{slugs[event_b]}": Q.players_min_maps(t.p, t.rc, t.m, event_b, min_maps),
    }


@register("report_row_counts")
def _(t: Tables):
    return S.report_row_counts(report_sheets(t))


@register("two_sided")
def _(t: Tables):
    j = t.r.join(t.m.select("match_id", "team_1", "team_2"), "match_id")
    return two_sided(j, [{"team": "team_1", "rounds_won": "result_1"},
                         {"team": "team_2", "rounds_won": "result_2"}], keep=["match_id", "map"])


# --- ETL -----------------------------------------------------------------------

@register("etl_events")
def _(t: Tables):
    named = t.ev.filter(F.col("event_name").isNotNull() & (F.col("event_name") != ""))
    new = t.rc.select("event_id").distinct().withColumn("event_name", F.lit(None).cast("string"))
    return E.insert_ignore(new, named, ["event_id"])


@register("etl_matches")
def _(t: Tables):
    e = t.e
    # SELECT DISTINCT ... ON CONFLICT (match_id): the per-key minimum already removes
    # duplicate rows, so no separate DISTINCT shuffle is needed
    new = e.select("match_id", "event_id", F.col("date").alias("match_date"), "team_1", "team_2",
                   clean_best_of("best_of").alias("best_of"))
    return E.insert_ignore(new, None, ["match_id"])


@register("etl_best_of")
def _(t: Tables):
    return t.e.select("match_id", clean_best_of("best_of").alias("best_of"))


@register("etl_players")
def _(t: Tables):
    p = A.players(t.src, detail=True)
    return p.withColumns({c: F.col(c).cast("double") for c in ("adr", "kast", "rating")})


@register("etl_results")
def _(t: Tables):
    return E.insert_ignore(A.results(t.src, detail=True), None, None)


@register("etl_picks")
def _(t: Tables):
    return E.insert_ignore(A.picks_stage(t.src), None, ["match_id"])


def _results_before(t: Tables, year: int):
    dates = A.order_facts(t.src).select("match_id", "match_date")
    return t.r.join(dates.filter(F.col("match_date") < F.lit(f"{year}-01-01").cast("date")),
                    "match_id", "left_semi")


@register("insert_ignore")
def _(t: Tables):
    keys = ["match_id", "map"]
    # the prior load (in production the stored target table)
    existing = E.insert_ignore(_results_before(t, P.YEAR_MATCHES), None, keys)
    return E.insert_ignore(t.r, existing, keys)


@register("append_results")
def _(t: Tables):
    old = _results_before(t, P.YEAR_MATCHES)
    new = t.r.join(old.select("match_id"), "match_id", "left_anti")
    return E.append(old, new)


@register("assign_match_ids")
def _(t: Tables):
    facts = A.order_facts(t.src).select("match_id", "match_winner")
    m = t.m.join(facts, "match_id")
    existing = m.filter(F.col("match_winner").isNotNull())
    new = (m.filter(F.col("match_winner").isNull())
           .select(F.col("match_id").alias("source_id"), "event_id", "match_date", "team_1", "team_2"))
    start = existing.select(F.coalesce(F.max("match_id"), F.lit(0))).scalar()
    return E.assign_ids(new, start, ["match_date", "source_id"], id_col="match_id")


@register("derive_winner")
def _(t: Tables):
    return t.r.select("match_id", "map", "result_1", "result_2",
                      derive_winner().alias("map_winner"))


# --- scalar functions over tables ---------------------------------------------

@register("player_score")
def _(t: Tables):
    return t.p.select("match_id", "player_name", "team", "kills", "deaths",
                      player_score().alias("score"))


@register("event_names")
def _(t: Tables):
    return Q.event_names(t.rc.select("event_id").distinct(), t.ev)


@register("slug_names")
def _(t: Tables):
    return t.ev.select("event_id", slug(event_name()).alias("slug"))


@register("json_payload_fields")
def _(t: Tables):
    ev = t.src.events.select("event_id", "props")
    return payload_fields(ev, "props", "k INT", defaults={"k": 0})


@register("json_payload_variant")
def _(t: Tables):
    """Payloads kept as variants, every fiftieth of them cut off."""
    cut = F.when(F.col("event_id") % 50 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    ev = t.src.events.select("event_id", cut.alias("props"))
    return payload_variant(ev, "props", {"k": "int", "other": "string"}, defaults={"k": 0}, required=("k",)).drop("payload")


@register("csv_quarantine")
def _(t: Tables):
    """Line items as CSV, some of them broken, through the load that sets bad lines aside."""
    import uuid

    from ..session import scratch_path
    key = F.col("l_orderkey") + F.col("l_linenumber")
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_returnflag")])
    broken = (F.when(key % 97 == 0, F.concat(row, F.lit(",left over"))).when(key % 97 == 1, F.lit("7"))
              .when(key % 97 == 2, F.concat(F.lit("x"), row))
              .when(key % 97 == 3, F.concat(F.lit('1,2,"'), F.col("l_returnflag"))).otherwise(row))
    path = scratch_path(t.spark, "csv", uuid.uuid4().hex)
    # one column whose values are whole lines: no separator or quote of its own
    t.src.lineitem.select(broken.alias("order_key,line,mode")).write.option("header", True).options(
        sep="\x01", quote="\x02", escape="\x03").csv(path)
    good, bad = read_csv_quarantined(t.spark, path, T.StructType.fromDDL("order_key long, line int, mode string"),
                                     max_bad_share=0.2)
    one = good.agg(F.count(F.lit(1)).alias("lines"), F.sum("order_key").alias("key_sum"))
    return one.select(F.lit("good").alias("reason"), "lines", "key_sum").unionByName(
        bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.lit(None).cast("long").alias("key_sum")))


@register("event_anchors")
def _(t: Tables):
    """Colour-scale anchors of every column of every event's player sheet, together."""
    return QT.group_anchors(t.p, ["kills", "deaths", "kddiff", "rating"], ["event_id"])


# --- live parts (batch forms) -----------------------------------------------------

@register("apply_changes")
def _(t: Tables):
    return C.apply_changes(A.change_log(t.src), key="id", seq=("ts", "seq"), out="kills")


@register("player_stats")
def _(t: Tables):
    """Accounts after their change log, with the columns that only the creating insert sets."""
    return C.apply_changes(A.account_log(t.src), key="id", seq=("ts", "seq"), out="kills",
                           carry=("opened_at", "opened_value"))


@register("latest_gauge")
def _(t: Tables):
    return W.latest_value(A.samples(t.src), seq=("ts", "event_id"))


@register("tumbling_last")
def _(t: Tables):
    return W.tumbling_last(A.samples(t.src), "1 day", seq=("ts", "event_id"))


@register("tumbling_scrape")
def _(t: Tables):
    """Last value and sample count per gauge and 15 s scrape window."""
    return W.tumbling_last(A.samples(t.src), f"{P.SCRAPE_SECONDS} seconds", seq=("ts", "event_id"))


@register("availability")
def _(t: Tables):
    return W.availability(A.samples(t.src), "1 day")


@register("retain_recent")
def _(t: Tables):
    return W.retain_recent(A.samples(t.src).select("event_id", "ts", "metric", "value"), "7 days")


@register("source_fallback")
def _(t: Tables):
    return W.source_fallback(A.source_readings(t.src), last_priority=3)


@register("asof_sample")
def _(t: Tables):
    return W.asof_sample(A.samples(t.src), 86400, seq=("ts", "event_id"))


@register("asof_scrape")
def _(t: Tables):
    """The scraper's view: every gauge read every 15 s (sample and hold)."""
    return W.asof_sample(A.samples(t.src), P.SCRAPE_SECONDS, seq=("ts", "event_id"))


@register("random_pick")
def _(t: Tables):
    state = C.apply_changes(A.change_log(t.src), key="id", seq=("ts", "seq"), out="kills")
    return random_pick(state, "id", 1, P.SEED)


@register("load_then_query")
def _(t: Tables):
    """ETL of all tables into final tables, then a counting question on them.

    The keyed tables are loaded twice: the second load must add nothing.
    """
    f = _loaded(t)
    from .load import load_final_tables
    load_final_tables(t.spark, t.src.root, f.folder, 1, tables=["events", "matches", "picks"])
    return Q.overtime_teams(f.rw, None, k=None)  # the pre-joined results_wide table


def _loaded(t: Tables, tables: list[str] | None = None):
    """Final tables of one load, below the shared folder."""
    import uuid

    from ..session import scratch_path
    from .load import FinalTables, load_final_tables
    folder = scratch_path(t.spark, "final", uuid.uuid4().hex)
    load_final_tables(t.spark, t.src.root, folder, 0, tables=tables)
    return FinalTables(t.spark, folder)


@register("pistol_rounds_final")
def _(t: Tables):
    """Pistol rounds of every event and team from the loaded economy table."""
    return Q.pistol_rounds(_loaded(t, ["economy"]).e, k=None)


@register("team_pool_final")
def _(t: Tables):
    """The team pool from the loaded matches and players."""
    f = _loaded(t, ["matches", "players_raw"])
    return Q.team_pool(f.m, f.ps, f.p, P.FORCED_TEAM)


def _by_match(t: Tables):
    """Loaded tables laid out by match."""
    from .layout import MatchTables, cluster_by_match
    f = _loaded(t, ["matches", "results", "players_raw"])
    cluster_by_match(t.spark, f.folder, 8)
    return MatchTables(t.spark, f.folder)


@register("players_min_maps_by_match")
def _(t: Tables):
    """Mean ratings over results joined bucket by bucket."""
    f = _by_match(t)
    return Q.players_min_maps(f.p, f.r, f.m, P.EVENT_B, P.MIN_MAPS)


@register("rating_vs_rounds_by_match")
def _(t: Tables):
    f = _by_match(t)
    return Q.rating_vs_rounds(f.r, f.m, f.p, P.EVENT_A)


# --- SQL text with bound parameters (S4) --------------------------------------------

@register("sql_named_params")
def _(t: Tables):
    from .sql import run_sql
    return run_sql(t.spark, """
        SELECT m.match_date, m.best_of, count(*) AS results, sum(r.result_1 + r.result_2) AS rounds
        FROM {results} r JOIN {matches} m ON m.match_id = r.match_id
        WHERE r.event_id = :event_id AND array_contains(:series, m.best_of)
        GROUP BY m.match_date, m.best_of""",
                   frames={"results": t.rc, "matches": t.m},
                   event_id=P.EVENT_A, series=F.array(*[F.lit(n) for n in P.SERIES_LENGTHS]))


# --- live parts (streaming forms) ---------------------------------------------------

@register("stream_insert_ignore")
def _(t: Tables):
    spark = t.spark
    target, ckpt = ST.fresh_paths(spark, "insert_ignore")
    cols = ["user_id", "event_type", "ts", "event_id", "value"]
    ST.stream_insert_ignore(ST.event_stream(spark, t.src.root), ["user_id", "event_type"], cols,
                            target, ckpt)
    return ST.latest_versions(spark, target, ["user_id", "event_type"]).select(*cols)


@register("stream_window_counts")
def _(t: Tables):
    spark = t.spark
    target, ckpt = ST.fresh_paths(spark, "window_counts")
    stream = ST.event_stream(spark, t.src.root).withColumnRenamed("event_type", "metric")
    ST.stream_window_counts(stream, "1 day", ["metric"], "ts", ["ts", "event_id"], "value",
                            target, ckpt)
    return ST.latest_versions(spark, target, ["metric", "window_start"])


@register("stream_standings")
def _(t: Tables):
    spark = t.spark
    target, ckpt = ST.fresh_paths(spark, "standings")
    lines = ST.event_stream(spark, t.src.root, table="lineitem")
    ST.stream_standings(A.results_of_lines(lines, t.src), t.m, target, ckpt)
    return ST.latest_versions(spark, target, ["team"])


@register("stream_standings_live")
def _(t: Tables):
    """Standings with matches and results both live."""
    spark = t.spark
    target, ckpt = ST.fresh_paths(spark, "standings_live")
    lines = ST.event_stream(spark, t.src.root, table="lineitem")
    orders = ST.event_stream(spark, t.src.root, table="orders")
    ST.stream_standings_live(A.results_of_lines(lines, t.src), A.matches(t.src, orders), target, ckpt)
    return ST.standings(spark, target)


@register("stream_apply_changes")
def _(t: Tables):
    spark = t.spark
    target, ckpt = ST.fresh_paths(spark, "change_state")
    stream = A.change_log_rows(ST.event_stream(spark, t.src.root))
    ST.stream_apply_changes(stream, "id", ("ts", "seq"), "op", "v", target, ckpt, out="kills")
    return ST.latest_versions(spark, target, ["id"]).filter("present").select("id", "kills")


@register("stream_asof")
def _(t: Tables):
    """The scraper's view as a stream: every tick up to the watermark."""
    target, ckpt = ST.fresh_paths(t.spark, "asof")
    stream = ST.event_stream(t.spark, t.src.root).withColumnRenamed("event_type", "metric")
    ST.stream_asof(stream, P.SCRAPE_SECONDS, target, ckpt, seq=("event_id",))
    return ST.held_ticks(t.spark, target)


@register("stream_fallback")
def _(t: Tables):
    target, ckpt = ST.fresh_paths(t.spark, "fallback")
    ST.stream_fallback(A.reading_rows(ST.event_stream(t.spark, t.src.root)), target, ckpt, "1 hour",
                       seq=("ts", "event_id"), last_priority=3)
    return ST.read_batches(t.spark, target).drop("batch_id")


@register("retain_stored")
def _(t: Tables):
    """Samples stored by day, expired days removed, then read."""
    target, _ = ST.fresh_paths(t.spark, "retained")
    write_dated(A.samples(t.src).select("event_id", "ts", "metric", "value"), target)
    retain_stored(t.spark, target, "7 days")
    return read_retained(t.spark, target, "7 days")


@register("stream_retained")
def _(t: Tables):
    target, ckpt = ST.fresh_paths(t.spark, "retained")
    stream = ST.event_stream(t.spark, t.src.root).select(
        "event_id", "ts", F.col("event_type").alias("metric"), "value")
    ST.stream_retained(stream, target, ckpt, "7 days")
    return read_retained(t.spark, target, "7 days").drop("batch_id")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    from .oracle import build
    sql = build()
    return {k: v for k, v in sql.items() if k in REGISTRY}
