"""All registered queries of the transcript toolkit and their SQL."""

from __future__ import annotations

from . import queries as _queries
from . import flow_queries as _flows  # noqa: F401  registers itself
from . import job_queries as _jobs  # noqa: F401  registers itself
from . import more_queries as _rest  # noqa: F401  registers itself
from . import text_queries as _more  # noqa: F401  registers itself


#: Queries that are known under two names.
NAMES = {
    "s1_offset_scan": "s1_text_scan",
    "p3_cursors": "p3_text_cursors",
    "j8_restore_boundaries": "j8_text_boundaries",
    "b4_manifest": "b4_whole_manifest",
    "b6_stored": "b6_whole_stored",
    "q5_attachment": "q5_whole_attachment",
    "b8_pending_detail": "b8_whole_pending",
    "b9_put_back": "b9_whole_put_back",
    "f24_bounded": "f24_whole_bounded",
    "t13_code_blocks": "t13_whole_blocks",
    "t10_envelope": "t10_whole_envelope",
    "a4_title_fold": "a4_whole_fold",
    "f12_percent": "f12_whole_percent",
    "f15_sniffed": "f15_whole_sniffed",
    "f23_attachment_at": "f23_whole_attachment",
    "t12_human_text": "t12_whole_text",
    "t14_pipe_tables": "t14_whole_tables",
    "q3_list_messages": "q3_message_previews",
}


def queries() -> dict:
    return _queries.QUERIES | {name: _queries.QUERIES[job] for name, job in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return _queries.ORACLE | {name: _queries.ORACLE[job] for name, job in NAMES.items()}
