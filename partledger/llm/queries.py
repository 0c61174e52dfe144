"""The queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from partledger.llm import chat, decontam, licenses, linededup, minhash, mixing, periodic, quality, secrets, toxicity, urlfilter, vectorcodes, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_licenses": licenses.op2_licenses,
    "op3_warc": warc.op3_warc,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_near_duplicates": minhash.op8_near_duplicates,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_format_chat": chat.op11_format_chat,
    "op12_vector_codes": vectorcodes.op12_vector_codes,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_secrets": secrets.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_decontaminate": decontam.OP4_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op8_near_duplicates": minhash.OP8_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_format_chat": chat.OP11_SQL,
    "op12_vector_codes": vectorcodes.OP12_SQL,
    "op13_periodic_runs": periodic.OP13_SQL,
}
