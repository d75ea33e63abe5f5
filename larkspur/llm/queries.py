"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, chat, decontam, exact_dedup, licenses, lm_score, mixing, near_vectors, secrets, simhash, substring_dedup, toxicity, whitening


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_mixing": mixing.op6_mixing,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_chat_format": chat.op8_chat_format,
        "op9_decontaminate": decontam.op9_decontaminate,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_embedding_near_dedup": near_vectors.op13_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op2_secret_scan": secrets.OP2_SQL, "op6_mixing": mixing.OP6_SQL, "op8_chat_format": chat.OP8_SQL}
