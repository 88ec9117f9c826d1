"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, sharding, url_rules, warc


def queries() -> dict:
    found = [near_dedup.op1_order_minhash, exact_dedup.op2_exact_dedup, url_rules.op3_url_rules, quality.op4_co_training, decontaminate.op5_decontaminate, sharding.op6_stratified_shards, line_dedup.op7_line_dedup, warc.op8_warc_chunks, chat.op9_chat_format, mixing.op10_temperature_mix]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op5_decontaminate": decontaminate.SQL, "op7_line_dedup": line_dedup.SQL, "op8_warc_chunks": warc.SQL, "op9_chat_format": chat.SQL}
