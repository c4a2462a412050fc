"""eventlens: clean, profile and analyse business-event tables with Spark.

Every operator is a lazy DataFrame function built from Spark's own
expressions; column roles (`Roles`) and thresholds are parameters.
"""

from .roles import DEFAULT, Roles  # noqa: F401
from .session import checkpoint_dir, get_session, scratch_path  # noqa: F401
