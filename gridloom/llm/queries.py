"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe
from .conversation_repair import op12_conversation_repair
from .decontaminate import OP5_SQL, op5_decontaminate
from .filter_audit import OP13_SQL, op13_filter_audit
from .language import op8_language
from .license_scan import op11_licenses
from .metric_tree import OP6_SQL, op6_top_k
from .quality import op3_quality
from .secret_scan import op10_secrets
from .simhash import op9_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op1_toxicity
from .url_filter import OP4_SQL, op4_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_substring_dedup": op2_substring_dedup, "op3_quality": op3_quality, "op4_url_filter": op4_url_filter, "op5_decontaminate": op5_decontaminate, "op6_top_k": op6_top_k, "op7_bpe": op7_bpe, "op8_language": op8_language, "op9_simhash": op9_simhash, "op10_secrets": op10_secrets, "op11_licenses": op11_licenses, "op12_conversation_repair": op12_conversation_repair, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op4_url_filter": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_top_k": OP6_SQL, "op13_filter_audit": OP13_SQL}
