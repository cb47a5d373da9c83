"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import chat, maxscore, merkle
from .chat import op3
from .decontaminate import op5
from .embeddings import op7
from .licenses import op1
from .lm import op8
from .maxscore import op12
from .merkle import op13
from .mixing import op9
from .quality import op6
from .secrets import op2
from .simhash import op4
from .toxicity import op10
from .whitening import op11

QUERIES = {
    "op1_license_scan": op1,
    "op2_secret_scan": op2,
    "op3_chat_format": op3,
    "op4_simhash": op4,
    "op5_decontaminate": op5,
    "op6_quality": op6,
    "op7_embedding_neardup": op7,
    "op8_lm_score": op8,
    "op9_entropy_mix": op9,
    "op10_toxicity": op10,
    "op11_whitening": op11,
    "op12_maxscore_top_k": op12,
    "op13_merkle_manifest": op13,
}

#: The other queries go beyond SQL (hash functions, models, copies) and are
#: tested against brute-force versions.
ORACLE = {
    "op3_chat_format": chat.ORACLE,
    "op12_maxscore_top_k": maxscore.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
