"""All registered queries of the library."""

from .operators import blocks, bundles, chainlog, columns, evidence, graph, ledger, market, mentions, models, moderation, news, newsrules, pages, predict, rollups, scores, scoring, search, setjoin, textsig, verification, weighing, windows  # noqa: F401  (each registers its own)
from .functions import registry as user_functions  # noqa: F401
from .registry import ORACLE_SQL, QUERIES
from .sources import labels  # noqa: F401
from .streaming import narratives, reorg, streams  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
