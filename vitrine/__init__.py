"""vitrine — listing analytics, drift reports and batch scoring as Spark jobs.

Every operator takes DataFrames and returns DataFrames; column names come from
configuration (:mod:`vitrine.config`), so the same jobs run on any table with the
right shape.
"""

from vitrine.config import DamageRules, ListingConfig
from vitrine.session import ensure_checkpoint_dir, get_session

__all__ = ["DamageRules", "ListingConfig", "ensure_checkpoint_dir", "get_session"]
