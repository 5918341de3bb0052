"""Registered queries of this subpackage, with DuckDB SQL where SQL can express a result."""

from __future__ import annotations

from .brown_lm import op1_brown_lm
from .embedding_dedup import op6_embedding_dedup
from .kneser_ney import op2_quality_classifier
from .lexical_search import OP13_SQL, op13_lexical_search
from .merkle import op12_merkle_manifest, oracle
from .ngram_join import op10_ngram_join
from .packing import op3_best_fit_packing
from .passages import op7_repeated_passages
from .quality_rules import op5_quality_rules
from .secrets import op8_secret_scan
from .sentencepiece_codec import op4_sentencepiece
from .sharding import OP11_SQL, op11_sharding
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_quality_classifier, op3_best_fit_packing, op4_sentencepiece, op5_quality_rules, op6_embedding_dedup,
                                   op7_repeated_passages, op8_secret_scan, op9_toxicity, op10_ngram_join, op11_sharding,
                                   op12_merkle_manifest, op13_lexical_search)}
ORACLES: dict[str, str] = {"op11_sharding": OP11_SQL, "op12_merkle_manifest": oracle(), "op13_lexical_search": OP13_SQL}
