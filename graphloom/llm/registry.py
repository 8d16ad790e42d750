"""The queries of the training-data operators."""

from __future__ import annotations

from graphloom.llm.byte_bpe import op4_byte_bpe
from graphloom.llm.chat import op5_chat_format
from graphloom.llm.decontamination import op1_decontamination
from graphloom.llm.jaccard_join import op6_jaccard_join
from graphloom.llm.language_id import op7_language_id
from graphloom.llm.license_scan import op9_license_scan
from graphloom.llm.merkle import OP12_SQL, op12_merkle_manifest
from graphloom.llm.pitman_yor import op2_pitman_yor
from graphloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from graphloom.llm.suffix_dedup import op8_suffix_dedup
from graphloom.llm.token_counts import op10_token_counts
from graphloom.llm.topk import OP3_SQL, op3_exact_topk
from graphloom.llm.warc import OP13_SQL, op13_warc

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_pitman_yor, op3_exact_topk, op4_byte_bpe, op5_chat_format, op6_jaccard_join, op7_language_id, op8_suffix_dedup, op9_license_scan, op10_token_counts, op11_prefix_trie, op12_merkle_manifest, op13_warc)}
ORACLE: dict[str, str] = {"op3_exact_topk": OP3_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc": OP13_SQL}
