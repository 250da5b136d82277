"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.html_text import op9_html_text
from tidemark.llm.language import op5_language_id
from tidemark.llm.nn_descent import OP3_SQL, op3_nn_descent
from tidemark.llm.packing import op2_best_fit_packing
from tidemark.llm.simhash import op4_simhash
from tidemark.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from tidemark.llm.token_codec import op8_bpe_codec
from tidemark.llm.token_counts import op7_token_counts
from tidemark.llm.topk import OP6_SQL, op6_exact_topk
from tidemark.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_nn_descent, op4_simhash, op5_language_id, op6_exact_topk, op7_token_counts, op8_bpe_codec, op9_html_text, op10_suffix_dedup)}

#: Where SQL can express an operator.
SQL: dict[str, str] = {"op3_nn_descent": OP3_SQL, "op6_exact_topk": OP6_SQL, "op10_suffix_dedup": OP10_SQL}
