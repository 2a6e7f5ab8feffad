"""The queries of this subpackage and the SQL that answers them."""

from tessitura.llm.decontamination import op3_decontamination
from tessitura.llm.hidden_markov import op8_language_model
from tessitura.llm.jaccard_join import OP1_SQL, op1_jaccard_join
from tessitura.llm.language_id import op5_language_id
from tessitura.llm.mixing import OP10_SQL, op10_mix_sources
from tessitura.llm.pii import op7_personal_data
from tessitura.llm.quality import op4_quality_rules
from tessitura.llm.sharding import OP9_SQL, op9_shard
from tessitura.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from tessitura.llm.token_files import op6_token_files

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_personal_data": op7_personal_data,
    "op8_language_model": op8_language_model,
    "op9_shard": op9_shard,
    "op10_mix_sources": op10_mix_sources,
}
ORACLE_SQL = {
    "op1_jaccard_join": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op9_shard": OP9_SQL,
    "op10_mix_sources": OP10_SQL,
}
