"""Queries of this subpackage, by the names the entry module registers."""

from __future__ import annotations

from tessera.llm.bpe import op11_bpe
from tessera.llm.chat import ORACLE_OP5, op5_chat_format
from tessera.llm.decontamination import ORACLE_OP10, op10_decontamination
from tessera.llm.fim import ORACLE_OP12, op12_fill_in_middle
from tessera.llm.media import op8_media
from tessera.llm.packing import op3_packing
from tessera.llm.pii import op4_pii
from tessera.llm.quality import op7_quality
from tessera.llm.repeats import ORACLE_OP9, op9_substring_dedup
from tessera.llm.search import ORACLE_OP13, op13_ranked_search
from tessera.llm.secrets import op1_secret_scan
from tessera.llm.simhash import op2_simhash
from tessera.llm.token_files import op6_token_files

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_simhash": op2_simhash, "op3_packing": op3_packing, "op4_pii": op4_pii, "op5_chat_format": op5_chat_format, "op6_token_files": op6_token_files, "op7_quality": op7_quality, "op8_media": op8_media, "op9_substring_dedup": op9_substring_dedup, "op10_decontamination": op10_decontamination, "op11_bpe": op11_bpe, "op12_fill_in_middle": op12_fill_in_middle, "op13_ranked_search": op13_ranked_search}
ORACLES: dict[str, str] = {"op5_chat_format": ORACLE_OP5, "op9_substring_dedup": ORACLE_OP9, "op10_decontamination": ORACLE_OP10, "op12_fill_in_middle": ORACLE_OP12, "op13_ranked_search": ORACLE_OP13}
