"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .archives import ORACLE as OP10_ORACLE
from .archives import op10_archives
from .decontaminate import op9_decontamination
from .lexical import ORACLE as OP11_ORACLE
from .lexical import op11_ranked_search
from .packing import op1_best_fit_packing
from .sharding import op13_shards
from .simhash import op4_simhash
from .substrings import op6_substring_dedup
from .suffixes import op7_suffix_dedup
from .token_files import op2_token_files
from .tool_calls import ORACLE as OP3_ORACLE
from .tool_calls import op3_tool_calls
from .toxicity import op5_toxicity
from .transport import op8_transport_streams
from .vector_codes import ORACLE as OP12_ORACLE
from .vector_codes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_tool_calls": op3_tool_calls,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_transport_streams": op8_transport_streams,
    "op9_decontamination": op9_decontamination,
    "op10_archives": op10_archives,
    "op11_ranked_search": op11_ranked_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_shards": op13_shards,
}
ORACLES: dict[str, str] = {"op3_tool_calls": OP3_ORACLE, "op10_archives": OP10_ORACLE, "op11_ranked_search": OP11_ORACLE, "op12_vector_codes": OP12_ORACLE}
