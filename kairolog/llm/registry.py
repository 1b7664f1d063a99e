"""Queries of this folder and the SQL to hold them against."""

from __future__ import annotations

from kairolog.llm import exactdedup, fingerprint, htmltext, langid, mixing, ngramjoin, packing, suffix, tokenfile, urlfilter


def queries() -> dict:
    found = (langid.op1_language_id, htmltext.op2_html_text, tokenfile.op3_token_files, mixing.op4_mixing, packing.op5_packing, suffix.op6_suffix_dedup, exactdedup.op7_exact_dedup, ngramjoin.op8_ngram_join, fingerprint.op9_fingerprints, urlfilter.op10_url_filter)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.sql(), "op7_exact_dedup": exactdedup.SQL, "op10_url_filter": urlfilter.SQL}
