"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import chat_format, decontaminate, exact_dedup, language_id, minhash, mixing, sharding, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_sharding": sharding.op5_sharding,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_language_id": language_id.op7_language_id,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash": minhash.op10_minhash,
}

SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_chat_format": chat_format.SQL,
}
