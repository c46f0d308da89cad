"""The operators' registered queries and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statweave.llm.chat import OP8_SQL, op8_prefix_target_expansion
from statweave.llm.decontaminate import op7_cgk_decontamination
from statweave.llm.extract import OP13_SQL, op13_crf_main_text
from statweave.llm.lm import op4_brown_class_bigrams
from statweave.llm.neardup import op6_odd_sketch_near_duplicates
from statweave.llm.packing import op1_order_preserving_packing
from statweave.llm.pii import op9_weak_supervision_pii
from statweave.llm.runs import op12_cover_runs
from statweave.llm.search import OP11_SQL, op11_max_sketch_search
from statweave.llm.sharding import op5_lpt_sharding
from statweave.llm.topk import OP3_SQL, op3_exact_top_k
from statweave.llm.toxicity import op2_weak_supervision_toxicity
from statweave.llm.warc import OP10_SQL, op10_transaction_assembly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_preserving_packing": op1_order_preserving_packing,
    "op2_weak_supervision_toxicity": op2_weak_supervision_toxicity,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_brown_class_bigrams": op4_brown_class_bigrams,
    "op5_lpt_sharding": op5_lpt_sharding,
    "op6_odd_sketch_near_duplicates": op6_odd_sketch_near_duplicates,
    "op7_cgk_decontamination": op7_cgk_decontamination,
    "op8_prefix_target_expansion": op8_prefix_target_expansion,
    "op9_weak_supervision_pii": op9_weak_supervision_pii,
    "op10_transaction_assembly": op10_transaction_assembly,
    "op11_max_sketch_search": op11_max_sketch_search,
    "op12_cover_runs": op12_cover_runs,
    "op13_crf_main_text": op13_crf_main_text,
}
SQL: dict[str, str] = {"op3_exact_top_k": OP3_SQL, "op8_prefix_target_expansion": OP8_SQL, "op10_transaction_assembly": OP10_SQL,
                      "op11_max_sketch_search": OP11_SQL, "op13_crf_main_text": OP13_SQL}
