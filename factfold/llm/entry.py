"""Queries of this subpackage and their SQL, for the registry at the top of the repository."""

from __future__ import annotations

from factfold.llm.centroids import OP13_SQL, op13_centroid_clusters
from factfold.llm.chat import OP2_SQL, op2_chat_format
from factfold.llm.decontam import op7_decontaminate
from factfold.llm.embeddings import op5_embedding_dedup
from factfold.llm.langid import op3_language_id
from factfold.llm.lines import OP11_SQL, op11_line_dedup
from factfold.llm.mixing import op8_mixing
from factfold.llm.pii import op10_pii_pseudonyms
from factfold.llm.quality import op6_quality
from factfold.llm.sharding import op1_sharding
from factfold.llm.simhash import op9_simhash_dedup
from factfold.llm.spelling import op12_spelling_variants
from factfold.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_chat_format": op2_chat_format,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_mixing": op8_mixing,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_pii_pseudonyms": op10_pii_pseudonyms,
    "op11_line_dedup": op11_line_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroid_clusters": op13_centroid_clusters,
}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op11_line_dedup": OP11_SQL, "op13_centroid_clusters": OP13_SQL}
