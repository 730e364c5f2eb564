"""The queries and SQL that this package registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from territory.llm.bpe import op5_bpe
from territory.llm.elkan import OP13_SQL, op13_elkan
from territory.llm.heaplloyd import OP11_SQL, op11_heap_lloyd
from territory.llm.html import op2_html
from territory.llm.language import op8_language
from territory.llm.minhash import OP1_SQL, op1_minhash
from territory.llm.mtree import OP4_SQL, op4_mtree
from territory.llm.packing import op12_packing
from territory.llm.quality import op7_quality
from territory.llm.substrings import OP9_SQL, op9_substrings
from territory.llm.suffixlm import op10_suffixlm
from territory.llm.tiling import op6_decontaminate
from territory.llm.toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_html": op2_html,
        "op3_toxicity": op3_toxicity,
        "op4_mtree": op4_mtree,
        "op5_bpe": op5_bpe,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op9_substrings": op9_substrings,
        "op10_suffixlm": op10_suffixlm,
        "op11_heap_lloyd": op11_heap_lloyd,
        "op12_packing": op12_packing,
        "op13_elkan": op13_elkan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op4_mtree": OP4_SQL, "op9_substrings": OP9_SQL, "op11_heap_lloyd": OP11_SQL, "op13_elkan": OP13_SQL}
