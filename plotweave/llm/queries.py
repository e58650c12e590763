"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from plotweave.llm.decontaminate import op2_benchmark_decontamination
from plotweave.llm.fingerprints import op5_document_fingerprints
from plotweave.llm.jaccard import op12_jaccard_join
from plotweave.llm.packing import op7_best_fit_packing
from plotweave.llm.periodic import op11_periodic_runs
from plotweave.llm.resampling import op13_importance_resampling
from plotweave.llm.simhash import op3_simhash_near_dedup
from plotweave.llm.substrings import op1_substring_dedup
from plotweave.llm.suffixes import op4_suffix_array_dedup
from plotweave.llm.templates import op10_line_dedup
from plotweave.llm.tokens import op6_token_counts
from plotweave.llm.toxicity import op9_toxicity
from plotweave.llm.urls import OP8_SQL, op8_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_benchmark_decontamination, op3_simhash_near_dedup, op4_suffix_array_dedup,
        op5_document_fingerprints, op6_token_counts, op7_best_fit_packing, op8_url_filters, op9_toxicity, op10_line_dedup,
        op11_periodic_runs, op12_jaccard_join, op13_importance_resampling,
    )
}
ORACLES = {"op8_url_filters": OP8_SQL}
