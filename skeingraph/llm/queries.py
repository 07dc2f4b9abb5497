"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeingraph.llm.chat import OP6_SQL, op6_chat_format
from skeingraph.llm.decontaminate import op9_decontamination
from skeingraph.llm.langid import op7_language
from skeingraph.llm.media import MEDIA_PAYLOADS_SQL, media_payloads, op10_media
from skeingraph.llm.mixing import OP4_SQL, op4_mixing
from skeingraph.llm.neardup import OP3_SQL, op3_near_duplicates
from skeingraph.llm.quality import op2_quality
from skeingraph.llm.secrets import OP1_SQL, op1_secret_scan
from skeingraph.llm.toxicity import op5_toxicity
from skeingraph.llm.urls import URL_RULES_SQL, op8_url_filter, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_language": op7_language,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_media": op10_media,
    # what SQL can say of op8 and op10
    "llm_url_rules": url_rules,
    "llm_media_payloads": media_payloads,
}
ORACLES: dict[str, str] = {
    "op1_secret_scan": OP1_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "llm_url_rules": URL_RULES_SQL,
    "llm_media_payloads": MEDIA_PAYLOADS_SQL,
}
