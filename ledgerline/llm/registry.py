"""The queries of this subpackage and their SQL, by the names that __spark_entry__.py registers."""

from ledgerline.llm.chat import OP4_SQL, op4_chat_format
from ledgerline.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from ledgerline.llm.fingerprint import op3_cws_fingerprints
from ledgerline.llm.langid import op9_language_id
from ledgerline.llm.mixing import op8_pfair_mix
from ledgerline.llm.ngram_join import op10_ngram_jaccard_join
from ledgerline.llm.pii import op6_pii
from ledgerline.llm.quality import op5_ordinal_quality
from ledgerline.llm.sentencepiece_bpe import op7_sentencepiece
from ledgerline.llm.sharding import op1_feistel_shards

QUERIES = {
    "op1_feistel_shards": op1_feistel_shards,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_cws_fingerprints": op3_cws_fingerprints,
    "op4_chat_format": op4_chat_format,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_language_id": op9_language_id,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}
SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op4_chat_format": OP4_SQL,
}
