from assentlake.functions.scores import (  # noqa: F401
    classify_level,
    level_struct,
    per_hundred,
    per_thousand,
    reconcile_mdi,
    shrunk_score,
)
from assentlake.functions.text import (  # noqa: F401
    normalize_model,
    snippet_in,
    strip_fences,
    trim_all,
)
from assentlake.functions.variants import (  # noqa: F401
    flatten_content,
    parse_ts,
    string_at,
    text_at,
)
