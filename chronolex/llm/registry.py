"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from chronolex.llm import chat_formatting, conversation_trie, decontamination, fill_in_middle
from chronolex.llm.chat_formatting import op5_chat_formatting
from chronolex.llm.conversation_trie import op11_conversation_trie
from chronolex.llm.decontamination import op10_decontamination
from chronolex.llm.fill_in_middle import op12_fill_in_middle
from chronolex.llm.jaccard_join import op3_jaccard_join
from chronolex.llm.language_id import op2_language_id
from chronolex.llm.license_scan import op6_license_scan
from chronolex.llm.packing import op9_best_fit_packing
from chronolex.llm.pii import op4_pii
from chronolex.llm.quality_rules import op7_quality_rules
from chronolex.llm.token_counts import op13_token_counts
from chronolex.llm.toxicity import op1_toxicity
from chronolex.llm.training_order import op8_training_order

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_jaccard_join, op4_pii, op5_chat_formatting, op6_license_scan, op7_quality_rules, op8_training_order, op9_best_fit_packing, op10_decontamination, op11_conversation_trie, op12_fill_in_middle, op13_token_counts)}
ORACLES: dict[str, str] = {"op5_chat_formatting": chat_formatting.ORACLE_SQL, "op10_decontamination": decontamination.ORACLE_SQL, "op11_conversation_trie": conversation_trie.ORACLE_SQL, "op12_fill_in_middle": fill_in_middle.ORACLE_SQL}
