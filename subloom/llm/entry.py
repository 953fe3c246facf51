"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from subloom.llm import decontaminate, knlm, pieces, pii, quality_rules, secrets, sharding, simhash, suffix_dedup, warc

QUERIES = {
    "op1_secrets": secrets.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_warc": warc.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_sharding": sharding.op5,
    "op6_pieces": pieces.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_knlm": knlm.op8,
    "op9_pii": pii.op9,
    "op10_simhash": simhash.op10,
}
ORACLES = {"op3_warc": warc.OP3_SQL, "op4_suffix_dedup": suffix_dedup.OP4_SQL}
