"""Scalar functions as column expressions; all of them run in the JVM."""

from supplylens.functions.keys import (
    fnv_bucket,
    image_ref,
    is_skipped_tag,
    platform_key,
    short_id,
    split_key,
    truncate_period,
)
from supplylens.functions.text import (
    append_unique,
    cpe_parts,
    cve_for_enrichment,
    cwe_list,
    ecosystem_from_url,
    icontains,
    json_field,
    name_variants,
    parse_source_rpm,
    parse_time,
    reference_type,
    severity_rank,
    truncate_ellipsis,
)
from supplylens.functions.version import compare_versions, is_comparable, suspicious_jump, version_key
from supplylens.functions.work import backoff_seconds, is_valid_transition

__all__ = [name for name in dir() if not name.startswith("_")]
