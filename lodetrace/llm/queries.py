"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from . import advisory_groups, leakage, licences, mixing, secrets, truncation

QUERIES = {
    "p1_found": secrets.p1_found,
    "p1_redacted_files": secrets.p1_redacted_files,
    "p1_redacted_previews": secrets.p1_redacted_previews,
    "p1_left_readable": secrets.p1_left_readable,
    "p2_found": advisory_groups.p2_found,
    "p6_found": licences.p6_found,
    "p7_found": leakage.p7_found,
    "p7_leaked_items": leakage.p7_leaked_items,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": truncation.p9_found,
    "p9_share_by_source": truncation.p9_share_by_source,
}

SQL = {"p2_found": advisory_groups.P2_SQL, "p6_found": licences.P6_SQL}
