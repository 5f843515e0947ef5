from .rounding import ratio_units, round_ratio, round_mean, to_units, units_to_double  # noqa: F401
from .scalars import (  # noqa: F401
    slug, player_label, event_name, clean_best_of, derive_winner, player_score,
    year_range, side_winner, strip_blank,
)
