"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, byte_bpe, collocations, decontaminate, exact_dedup, filter_audit, license_scan, line_dedup, sharding, simhash, sstable, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_line_dedup": line_dedup.query,
        "op3_simhash": simhash.query,
        "op4_license_scan": license_scan.query,
        "op5_bpe": bpe.query,
        "op6_sharding": sharding.query,
        "op7_token_shards": sstable.query,
        "op8_url_filter": url_filter.query,
        "op9_toxicity": toxicity.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_byte_bpe": byte_bpe.query,
        "op12_collocations": collocations.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op8_url_filter": url_filter.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
        "op12_collocations": collocations.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
