"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from .conversations import OP11_SQL, op11_conversation_repair
from .decontaminate import op5_string_tiling
from .language import op4_language
from .lines import OP10_SQL, op10_line_chunks
from .minhash import op6_dartminhash
from .mixing import OP3_SQL, op3_mixing
from .personal import op13_crf
from .quality import op1_cotraining
from .sstable import op9_sstable
from .substrings import op8_longest_factors
from .vectors import op7_pstable
from .warc import OP2_SQL, op2_merkle_fixity
from .whitening import op12_whitening

QUERIES = {
    "op1_cotraining": op1_cotraining,
    "op2_merkle_fixity": op2_merkle_fixity,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_string_tiling": op5_string_tiling,
    "op6_dartminhash": op6_dartminhash,
    "op7_pstable": op7_pstable,
    "op8_longest_factors": op8_longest_factors,
    "op9_sstable": op9_sstable,
    "op10_line_chunks": op10_line_chunks,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_crf": op13_crf,
}
ORACLES: dict[str, str] = {"op2_merkle_fixity": OP2_SQL, "op3_mixing": OP3_SQL, "op10_line_chunks": OP10_SQL, "op11_conversation_repair": OP11_SQL}
