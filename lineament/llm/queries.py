"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontam, pfor, pii, pu_quality, quality, quotes, secrets, simhash, urls

QUERIES = {
    "op1_quotation_linking": quotes.op1,
    "op2_golay_simhash": simhash.op2,
    "op3_rule_ledger": quality.op3,
    "op4_feistel_pseudonyms": pii.op4,
    "op5_pu_quality": pu_quality.op5,
    "op6_forced_boundary_bpe": bpe.op6,
    "op7_crf_secrets": secrets.op7,
    "op8_url_ngrams": urls.op8,
    "op9_spaced_seeds": decontam.op9,
    "op10_patched_blocks": pfor.op10,
    "quoted_conversations": quotes.quoted_conversations,
    "rule_policies": quality.rule_policies,
    "rule_ablations": quality.rule_ablations,
}

#: The others cannot be expressed in SQL (hash functions, models, encoders) and
#: are tested against brute force, the library or held-out rows.
ORACLES = {
    "op1_quotation_linking": quotes.SQL,
    "op3_rule_ledger": quality.SQL,
    "op8_url_ngrams": urls.sql(),
    "op9_spaced_seeds": decontam.SQL,
    "quoted_conversations": quotes.QUOTED_SQL,
    "rule_policies": quality.POLICIES_SQL,
    "rule_ablations": quality.ABLATIONS_SQL,
}
