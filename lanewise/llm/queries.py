"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lanewise.llm import bpe, chat, decontamination, neardup, packing, pii, quality, secrets, sharding, urls

QUERIES = {
    "op2_secrets": secrets.op2_secrets,
    "op4_packing": packing.op4_packing,
    "op8_urls": urls.op8_urls,
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op6_chat": chat.op6_chat,
    "op3_sharding": sharding.op3_sharding,
    "op10_quality": quality.op10_quality,
    "op5_bpe": bpe.op5_bpe,
    "op7_decontamination": decontamination.op7_decontamination,
    "op9_personal_data": pii.op9_personal_data,
}
ORACLES = {
    "op8_urls": urls.oracle(),
    "op6_chat": chat.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
}
