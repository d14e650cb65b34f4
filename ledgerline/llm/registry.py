"""The queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from .conversation_trie import OP11_SQL, op11_conversation_trie
from .decontaminate import OP7_SQL, op7_benchmark_decontamination
from .filter_audit import OP12_SQL, op12_filter_audit
from .language_id import op1_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import op6_mix_sources
from .near_dedup import op5_minhash_near_dedup
from .perplexity import op4_quality_rules
from .private_data import op3_private_data
from .quality import op2_quality_classifier
from .secrets import op10_secrets
from .toxicity import op8_toxicity
from .url_rules import OP13_SQL, op13_url_rules

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_classifier,
        op3_private_data,
        op4_quality_rules,
        op5_minhash_near_dedup,
        op6_mix_sources,
        op7_benchmark_decontamination,
        op8_toxicity,
        op9_line_dedup,
        op10_secrets,
        op11_conversation_trie,
        op12_filter_audit,
        op13_url_rules,
    )
}
ORACLE_SQL = {
    "op7_benchmark_decontamination": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_url_rules": OP13_SQL,
}
