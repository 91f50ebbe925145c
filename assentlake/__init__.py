"""Measures how often coding assistants give in to their users, on Spark."""

from assentlake.operators.detect import detect  # noqa: F401
from assentlake.plans.leaderboard import apply_submissions  # noqa: F401
from assentlake.plans.report import build_report, report_summary  # noqa: F401
from assentlake.plans.scan import load_messages  # noqa: F401
from assentlake.session import configure  # noqa: F401
from assentlake.sources.lexicon import Matcher, lexicon_lines, load_lexicon  # noqa: F401
