"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from . import chat_format, decontamination, lexical_search, license_scan, packing, quality_rules, secret_scan, sharding, simhash, substring_dedup, url_filter, vector_codes, warc

QUERIES = {
    "op1_suffix_dedup": substring_dedup.op1_suffix_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op9_chat_format": chat_format.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
