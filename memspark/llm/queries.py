"""The named queries of this folder and their SQL twins."""

from __future__ import annotations

from memspark.llm import adscan, bpe, hardneg, packing, periodic, quality, secrets, sharding, simhash, spotsigs, suffixes, urlrules, warc

QUERIES = {
    "op1_warc_transactions": warc.op1_warc_transactions,
    "op2_rendezvous_shards": sharding.op2_rendezvous_shards,
    "op3_quality": quality.op3_quality,
    "op4_prefix_bpe": bpe.op4_prefix_bpe,
    "op5_secret_forest": secrets.op5_secret_forest,
    "op6_pack_sequences": packing.op6_pack_sequences,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_simhash_bktree": simhash.op8_simhash_bktree,
    "op9_adaptive_scan": adscan.op9_adaptive_scan,
    "op10_url_rules": urlrules.op10_url_rules,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_suffix_dedup": suffixes.op12_suffix_dedup,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}
ORACLES = {
    "op1_warc_transactions": warc.OP1_SQL,
    "op10_url_rules": urlrules.OP10_SQL,
    "op13_hard_negatives": hardneg.OP13_SQL,
}
