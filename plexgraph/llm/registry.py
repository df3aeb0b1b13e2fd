"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, importance, turns, url_filter
from .decontaminate import op8_decontaminate
from .importance import op12_importance
from .language import op13_language
from .packing import op10_packing
from .permutation_index import op2_permutation_index
from .sharding import op1_sharding
from .simhash import op7_simhash
from .substrings import op9_substrings
from .token_output import op3_token_output
from .toxicity import op5_toxicity
from .turns import op11_turns
from .url_filter import op6_url_filter
from .wrapper import op4_wrapper

QUERIES = {f.__name__: f for f in (op1_sharding, op2_permutation_index, op3_token_output, op4_wrapper, op5_toxicity, op6_url_filter, op7_simhash, op8_decontaminate, op9_substrings, op10_packing, op11_turns, op12_importance, op13_language)}
ORACLES = {"op6_url_filter": url_filter.ORACLE_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL, "op11_turns": turns.ORACLE_SQL, "op12_importance": importance.ORACLE_SQL}
