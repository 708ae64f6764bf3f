"""The corpus operators as registered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from veldt.llm.decontaminate import OP7_SQL, op7_decontamination
from veldt.llm.line_dedup import op4_line_dedup
from veldt.llm.lm_score import op3_lm_score
from veldt.llm.mixing import op10_mixing
from veldt.llm.ngram_join import OP2_SQL, op2_ngram_join
from veldt.llm.pii import op5_pii
from veldt.llm.quality_rules import op1_quality_rules
from veldt.llm.toxicity import op6_toxicity
from veldt.llm.token_store import op9_token_store
from veldt.llm.warc import OP8_SQL, op8_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_lm_score, op4_line_dedup, op5_pii, op6_toxicity, op7_decontamination, op8_warc, op9_token_store, op10_mixing)}

ORACLES: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op7_decontamination": OP7_SQL, "op8_warc": OP8_SQL}
