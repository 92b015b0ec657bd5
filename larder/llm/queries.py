"""The queries of this subpackage, by name, and SQL twins where SQL can express them."""

from __future__ import annotations

from larder.llm.conversation_repair import op11_conversation_repair
from larder.llm.conversation_trie import op13_conversation_trie
from larder.llm.decontaminate import op3_decontamination
from larder.llm.feistel_shards import op5_feistel_shards
from larder.llm.language_id import op7_language_id
from larder.llm.license_scan import op8_license_scan
from larder.llm.near_duplicates import op9_minhash_near_dedup
from larder.llm.repeated_bytes import op6_suffix_dedup
from larder.llm.repeated_passages import op12_passage_dedup
from larder.llm.repetition import op4_quality_rules
from larder.llm.secret_scan import op2_secret_scan
from larder.llm.sentencepiece_codec import op10_sentencepiece
from larder.llm.token_lengths import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_feistel_shards": op5_feistel_shards,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_passage_dedup": op12_passage_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE_SQL: dict[str, str] = {}
