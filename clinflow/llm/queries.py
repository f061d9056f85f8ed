"""The registered queries of this package."""

from __future__ import annotations

import corpus_pipeline
from clinflow.llm.conversations import CONVERSATION_REPAIR_SQL, op13_conversation_repair
from clinflow.llm.decontam import op4_decontamination
from clinflow.llm.html import op10_html_text
from clinflow.llm.licenses import op12_license_scan
from clinflow.llm.lines import op7_line_dedup
from clinflow.llm.mixing import op6_mixing
from clinflow.llm.near_dups import op9_near_dups
from clinflow.llm.pii import op5_pii
from clinflow.llm.quality import op3_quality
from clinflow.llm.sharding import op1_sharding
from clinflow.llm.tokens import op2_token_ids
from clinflow.llm.toxicity import op8_toxicity
from clinflow.llm.whitening import op11_embedding_whitening

OPERATORS = [op1_sharding, op2_token_ids, op3_quality, op4_decontamination, op5_pii, op6_mixing, op7_line_dedup, op8_toxicity,
             op9_near_dups, op10_html_text, op11_embedding_whitening, op12_license_scan, op13_conversation_repair]
QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {"op13_conversation_repair": CONVERSATION_REPAIR_SQL}
