"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from luxtrace.llm.bpe import op1_byte_bpe
from luxtrace.llm.decontaminate import op4_decontaminate
from luxtrace.llm.fingerprints import op13_fingerprints
from luxtrace.llm.language import op3_language_id
from luxtrace.llm.line_dedup import OP10_SQL, op10_line_dedup
from luxtrace.llm.media import op5_media_columns
from luxtrace.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from luxtrace.llm.near_dedup import op8_order_minhash
from luxtrace.llm.passages import op9_repeated_passages
from luxtrace.llm.pii import op2_pii
from luxtrace.llm.secrets import op6_secrets
from luxtrace.llm.token_alignment import op11_token_alignment
from luxtrace.llm.token_files import op7_token_files

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_pii, op3_language_id, op4_decontaminate, op5_media_columns, op6_secrets, op7_token_files, op8_order_minhash, op9_repeated_passages, op10_line_dedup, op11_token_alignment, op12_merkle_manifest, op13_fingerprints)}
ORACLES: dict[str, str] = {"op10_line_dedup": OP10_SQL, "op12_merkle_manifest": OP12_SQL}
