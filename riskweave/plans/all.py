"""Registers every query by importing its module."""

from . import column_queries  # noqa: F401
from . import finding_queries  # noqa: F401
from . import text_queries  # noqa: F401
from . import planning_queries  # noqa: F401
from . import source_queries  # noqa: F401
from . import fact_queries  # noqa: F401
from . import read_queries  # noqa: F401
from . import advisory_queries  # noqa: F401
from . import report_queries  # noqa: F401
from . import tree_queries  # noqa: F401
from . import state_queries  # noqa: F401
from . import patch_queries  # noqa: F401
from . import reply_queries  # noqa: F401
from . import scope_queries  # noqa: F401
from . import rule_queries  # noqa: F401
from . import feed_queries  # noqa: F401
