"""The queries of this subpackage, and SQL for those that SQL can express."""

from tidewater.llm.chat import op3_chat
from tidewater.llm.decontaminate import OP7_SQL, op7_decontamination
from tidewater.llm.language import op2_language
from tidewater.llm.lm import op10_lm
from tidewater.llm.mixing import op4_mixing
from tidewater.llm.quality import OP6_SQL, op6_quality
from tidewater.llm.sharding import op5_sharding
from tidewater.llm.simhash import op8_simhash
from tidewater.llm.suffix_dedup import op1_suffix_dedup
from tidewater.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language": op2_language,
    "op3_chat": op3_chat,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_lm": op10_lm,
}

SQL = {
    "op6_quality": OP6_SQL,
    "op7_decontamination": OP7_SQL,
}
