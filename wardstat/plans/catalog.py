"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the DuckDB
oracle SQL for each name that has an exact SQL form."""

from __future__ import annotations

from ..operators import stats
from . import oracle_sql as O
from .pipeline import cleaned

from .registry import ORACLE, QUERIES, register  # noqa: F401


# flagship: readmission rate by ICD group of the primary diagnosis
@register("rate_by_diag_1_category", O.CLEANED + """
SELECT diag_1_category, count(*) AS n, round(avg(readmitted_binary) * 100, 6) AS rate
FROM cleaned GROUP BY diag_1_category""")
def q_rate_by_diag(spark, sf):
    return stats.rate_by(cleaned(spark, sf, ["diag_1_category", "readmitted_binary"]), "diag_1_category")

from . import queries_base  # noqa: E402,F401
from . import queries_profile  # noqa: E402,F401
from . import queries_eval  # noqa: E402,F401
from . import queries_neighbours  # noqa: E402,F401
from . import queries_models  # noqa: E402,F401
from . import queries_reports  # noqa: E402,F401
from . import queries_sources  # noqa: E402,F401
