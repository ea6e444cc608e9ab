"""The corpus queries: name -> callable, and name -> SQL where SQL can say the same."""

from __future__ import annotations

from loomframe.llm.conversations import op13_conversations
from loomframe.llm.decontamination import op6_decontamination
from loomframe.llm.langid import op4_language_id
from loomframe.llm.lexical import OP12_SQL, op12_lexical
from loomframe.llm.mixing import op1_mixing
from loomframe.llm.quality import op5_quality
from loomframe.llm.secret_scan import OP2_SQL, op2_secrets
from loomframe.llm.sharding import op9_sharding
from loomframe.llm.simhash import op8_simhash
from loomframe.llm.substrings import op10_suffix_dedup
from loomframe.llm.token_counts import op3_token_counts
from loomframe.llm.topk import OP7_SQL, op7_topk
from loomframe.llm.toxicity import op11_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_topk": op7_topk,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_lexical": op12_lexical,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op2_secrets": OP2_SQL,
    "op7_topk": OP7_SQL,
    "op12_lexical": OP12_SQL,
}
