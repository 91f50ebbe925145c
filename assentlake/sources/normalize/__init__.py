"""One function per log format: raw rows to the common messages table.

Every function takes DataFrames, not paths, and returns
(msg_id, harness, session_id, ts, model, text).
"""

from assentlake.sources.normalize.databases import normalize_cursor, normalize_opencode  # noqa: F401
from assentlake.sources.normalize.documents import (  # noqa: F401
    normalize_cline,
    normalize_hermes,
    normalize_openclaw_docs,
    normalize_pi_workflow,
)
from assentlake.sources.normalize.lines import (  # noqa: F401
    normalize_claude,
    normalize_codebuddy,
    normalize_openclaw_lines,
)
from assentlake.sources.normalize.running import (  # noqa: F401
    normalize_codex,
    normalize_omp,
    normalize_pi,
)
