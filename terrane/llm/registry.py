"""The text operators' queries and, where SQL can express them, their SQL."""

from . import oracles
from .bpe import op12_bpe
from .centroids import op13_centroids
from .decontaminate import op4_decontamination
from .extraction import op10_extraction
from .lines import op2_lines
from .mixing import op3_mixing
from .quality import op8_quality
from .ranking import op11_search
from .sharding import op9_sharding
from .simhash import op6_simhash
from .substrings import op5_substrings
from .tokencount import op7_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lines": op2_lines,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_substrings": op5_substrings,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_extraction": op10_extraction,
    "op11_search": op11_search,
    "op12_bpe": op12_bpe,
    "op13_centroids": op13_centroids,
}
ORACLES = {"op3_mixing": oracles.OP3, "op4_decontamination": oracles.OP4, "op5_substrings": oracles.OP5, "op8_quality": oracles.OP8, "op11_search": oracles.OP11, "op13_centroids": oracles.OP13}
