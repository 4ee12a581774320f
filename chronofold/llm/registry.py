"""The ``opN_<name>`` queries of this subpackage and their SQL."""

from __future__ import annotations

from .additive_ann import op4_additive_ann
from .language import op8_language_crf
from .mixing import OP5_SQL, op5_temperature_mixing
from .packing import op10_packing
from .quality import OP7_SQL, op7_quality_rules
from .simhash import op6_simhash_gray
from .token_counts import op1_token_counts
from .token_shards import op3_token_shards
from .toxicity import op9_toxicity_knn
from .warc import OP2_SQL, op2_warc_bundles

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_token_shards": op3_token_shards,
    "op4_additive_ann": op4_additive_ann,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_simhash_gray": op6_simhash_gray,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_crf": op8_language_crf,
    "op9_toxicity_knn": op9_toxicity_knn,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_bundles": OP2_SQL,
    "op5_temperature_mixing": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
}
