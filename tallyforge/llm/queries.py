"""The registered training-data queries and their SQL."""

from __future__ import annotations

from tallyforge.llm import chat, exact, html, lines, minhash, mixing, phrases, pieces, pii, quality, secrets, toxicity, whitening

QUERIES = {
    "op2_template_text": html.query,
    "op9_gumbel_pieces": pieces.query,
    "op4_bag_minhash": minhash.query,
    "op8_hierarchical_mix": mixing.query,
    "op6_line_windows": lines.query,
    "op10_feistel_pseudonyms": pii.query,
    "op3_secret_worklist": secrets.query,
    "op1_chat_round_trip": chat.query,
    "op5_cuckoo_exact_dedup": exact.query,
    "op7_quality_ledger": quality.query,
    "quality_ablation": quality.ablation_query,
    "op11_kneser_ney_toxicity": toxicity.query,
    "op12_whitened_components": whitening.query,
    "op13_phrase_collocations": phrases.query,
}
ORACLE_SQL = {
    "op8_hierarchical_mix": mixing.SQL,
    "op6_line_windows": lines.SQL,
    "op1_chat_round_trip": chat.SQL,
    "op5_cuckoo_exact_dedup": exact.SQL,
    "op7_quality_ledger": quality.SQL,
    "quality_ablation": quality.ABLATION_SQL,
    "op13_phrase_collocations": phrases.SQL,
}
