"""Parameters of the registered queries.

The reference's defaults (years 2018/2019, events 2208/2335/2340/2345) point
at its own data; the test tables hold events 2200-2239 and dates 1995-2001,
so the registered queries use values that exist there.
"""

YEAR_MATCHES = 1998      # most_matches_in_year (reference default 2018)
YEAR_BEST = 1999         # best_team_of_year, team_rounds_by_day (reference 2019)
EVENT_A = 2208           # pistol rounds, popular map, win rates, charts (reference 2208/2340/2345)
EVENT_B = 2235           # player rating, team wins (reference 2335)
MIN_MAPS = 8
TEAM = "NATION_3"        # team of the per-day line (reference 'Natus Vincere')
FORCED_TEAM = "FURIA"    # member forced into the team pool
HIST_BINS = 15
BIN_WIDTH = 5
TEAM_LABELS = [f"NATION_{i}" for i in range(25)]  # the 25 nation names of the test data
SEED = 42             # repeatable random pick
MAX_BINS = 20          # "at most N bins" histogram (the browser-binned chart)
SCRAPE_SECONDS = 15    # scrape interval of the metrics store
SERIES_LENGTHS = [1, 3]   # best-of values of the parameterised SQL statement
