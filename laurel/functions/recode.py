"""Labels, groups and null handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of the series categories and of model terms.
CATEGORY_LABELS = {"Show Drama": "TV Drama", "Show Comedy": "TV Comedy"}
TERM_LABELS = {
    "one_prev_win": "has_one_previous_win",
    "later_season": "per_season",
    "won_external": "won_other_award_previous_year",
    "won_last_period": "won_previous_year",
    "alph_pos_1or5": "first_or_last_name_alphabetically",
    "prev_wins": "per_number_of_previous_wins",
    "prev_noms": "per_number_of_previous_noms",
    "av_rating": "per_average_rating",
    "av_num_votes": "per_thousand_votes",
    "name_length_pos_1or5": "longest_or_shortest_name",
}
TERM_SCALES = {"av_num_votes": 1000}  # effects are told for so many units


def recode(column: str | Column, labels: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    c = F.col(column) if isinstance(column, str) else column
    out = c
    for old, new in labels.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def won_label(column: str = "won") -> Column:
    return F.when(F.col(column) == 1, "Won").otherwise("Lost")


def relative_effect(coef: Column, base_logit: float = -1.38) -> Column:
    """Change of the win probability when a term moves the base logit by its coefficient."""
    base = F.lit(base_logit)
    return 1 / (1 + F.exp(-(base + coef))) - 1 / (1 + F.exp(-base))
