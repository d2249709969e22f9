"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.alignment import op12_query
from fathomline.llm.bytepair import op5_query
from fathomline.llm.fixity import OP9_SQL, op9_query
from fathomline.llm.language import op4_query
from fathomline.llm.lmscore import OP2_SQL, op2_query
from fathomline.llm.mixing import OP13_SQL, op13_query
from fathomline.llm.neardup import OP1_SQL, op1_query
from fathomline.llm.neighbours import op3_query
from fathomline.llm.packing import op6_query
from fathomline.llm.quality import op8_query
from fathomline.llm.sharding import op7_query
from fathomline.llm.spelling import op11_query
from fathomline.llm.urls import op10_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_query,
    "op2_lmscore": op2_query,
    "op3_neighbours": op3_query,
    "op4_language": op4_query,
    "op5_bytepair": op5_query,
    "op6_packing": op6_query,
    "op7_sharding": op7_query,
    "op8_quality": op8_query,
    "op9_fixity": op9_query,
    "op10_urls": op10_query,
    "op11_spelling": op11_query,
    "op12_alignment": op12_query,
    "op13_mixing": op13_query,
}

ORACLES: dict[str, str] = {
    "op1_neardup": OP1_SQL,
    "op2_lmscore": OP2_SQL,
    "op9_fixity": OP9_SQL,
    "op13_mixing": OP13_SQL,
}
