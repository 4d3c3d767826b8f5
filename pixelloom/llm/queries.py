"""The registered queries of this subpackage and the SQL that must agree with them."""

from . import decontaminate, exact_dedup, license_scan, line_dedup, near_dup, packing, quality, sharding, token_output, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_ids": token_output.op3_token_ids,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_packing": packing.op5_packing,
    "op6_sharding": sharding.op6_sharding,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_near_duplicates": near_dup.op8_near_duplicates,
    "op9_quality": quality.op9_quality,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLE_SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_near_duplicates": near_dup.OP8_SQL,
}
