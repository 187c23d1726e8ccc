"""The queries of this subpackage, by name, and SQL for those that it can express."""

from .bitplanes import op1_bitplane_tokens
from .bloom_dedup import OP10_SQL, op10_bloom_dedup
from .bpe_automaton import op8_bpe_automaton
from .chosen_path import op5_chosen_path
from .mixing import op2_sainte_lague_mix
from .quality import op4_knn_quality
from .secrets import op7_secret_scan
from .sketches import op6_threshold_sketch
from .token_counts import op9_token_counts
from .url_lists import OP3_SQL, op3_url_temporal

QUERIES = {f.__name__: f for f in (op1_bitplane_tokens, op2_sainte_lague_mix, op3_url_temporal, op4_knn_quality, op5_chosen_path, op6_threshold_sketch, op7_secret_scan, op8_bpe_automaton, op9_token_counts, op10_bloom_dedup)}

SQL: dict[str, str] = {"op3_url_temporal": OP3_SQL, "op10_bloom_dedup": OP10_SQL}
