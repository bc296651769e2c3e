"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontamination import OP7_SQL, op7_decontaminate
from .embedding_dedup import op5_embedding_dedup
from .jaccard_join import OP2_SQL, op2_jaccard_join
from .language_id import op1_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP8_SQL, op8_mix
from .quality import op4_quality
from .secret_scan import op12_secret_scan
from .substring_dedup import op3_substring_dedup
from .toxicity import op10_toxicity
from .url_filter import OP9_SQL, op9_url_filter

QUERIES = {"op3_substring_dedup": op3_substring_dedup, "op4_quality": op4_quality, "op9_url_filter": op9_url_filter, "op1_language_id": op1_language_id, "op10_toxicity": op10_toxicity, "op2_jaccard_join": op2_jaccard_join, "op5_embedding_dedup": op5_embedding_dedup, "op6_line_dedup": op6_line_dedup, "op7_decontaminate": op7_decontaminate, "op8_mix": op8_mix, "op11_lexical_search": op11_lexical_search, "op12_secret_scan": op12_secret_scan, "op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL = {"op9_url_filter": OP9_SQL, "op2_jaccard_join": OP2_SQL, "op6_line_dedup": OP6_SQL, "op7_decontaminate": OP7_SQL, "op8_mix": OP8_SQL, "op11_lexical_search": OP11_SQL, "op13_conversation_repair": OP13_SQL}
