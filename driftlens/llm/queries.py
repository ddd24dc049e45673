"""Queries of this subpackage and the SQL that gives the same rows, where there is such SQL."""

from __future__ import annotations

from .bpe import op2_byte_bpe
from .chat import op8_chat_repair
from .conversation import ORACLE_SQL as CONVERSATION_SQL
from .conversation import op12_conversation_repair
from .fingerprint import op6_iblt_fingerprint
from .language_id import op9_language_id
from .license_scan import op4_license_scan
from .mixing import ORACLE_SQL as MIXING_SQL
from .mixing import op7_mixing
from .near_dup import op3_minhash_near_dup
from .quality_model import op1_quality_classifier
from .quality_rules import ORACLE_SQL as RULES_SQL
from .quality_rules import op5_quality_rules
from .secret_ledger import ORACLE_SQL as SECRETS_SQL
from .secret_ledger import op13_secret_scan
from .sharding import op10_sharding
from .whitening import op11_embedding_whitening


def queries() -> dict:
    made = [
        op1_quality_classifier, op2_byte_bpe, op3_minhash_near_dup, op4_license_scan, op5_quality_rules,
        op6_iblt_fingerprint, op7_mixing, op8_chat_repair, op9_language_id, op10_sharding, op11_embedding_whitening, op12_conversation_repair, op13_secret_scan,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": RULES_SQL, "op7_mixing": MIXING_SQL, "op12_conversation_repair": CONVERSATION_SQL, "op13_secret_scan": SECRETS_SQL}
