"""Priority, staleness and complexity scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bonus per content type and per path part.
TYPE_BONUS = {"guide": -500, "detailed_guide": -400, "service": -300, "transaction": -300}
PATH_BONUS = {"/services/": -100, "/guidance/": -50}


def url_priority(path: Column, content_type: Column, depth: Column) -> Column:
    """Fetch priority, 1 is first."""
    score = depth * 10
    bonus = F.lit(0)
    for kind, points in TYPE_BONUS.items():
        bonus = F.when(content_type == kind, F.lit(points)).otherwise(bonus)
    score = score + bonus
    for part, points in PATH_BONUS.items():
        score = score + F.when(path.contains(part), F.lit(points)).otherwise(F.lit(0))
    return F.greatest(F.lit(1), score)


def section_priority(title: Column, preferred: Sequence[str]) -> Column:
    """1 for the preferred sections, 10 for the rest."""
    named = F.coalesce(title.isin(*preferred), F.lit(False)) if preferred else F.lit(False)
    return F.when(named, F.lit(1)).otherwise(F.lit(10))


def staleness_score(newest_age_days: Column) -> Column:
    """Age of the newest update on a one-year scale; 1.0 without any date."""
    return F.coalesce(F.least(F.lit(1.0), newest_age_days / F.lit(365.0)), F.lit(1.0))


def complexity_score(max_depth: Column, average_depth: Column) -> Column:
    """Mean of the deepest level on a scale of 10 and the mean level on a scale of 5."""
    deepest = F.least(F.lit(1.0), max_depth / F.lit(10.0))
    mean = F.least(F.lit(1.0), average_depth / F.lit(5.0))
    return (deepest + mean) / F.lit(2.0)
