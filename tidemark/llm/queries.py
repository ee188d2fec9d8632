"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from tidemark.llm.chat_format import OP3_SQL, op3_chat_format
from tidemark.llm.decontaminate import op8_decontaminate
from tidemark.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from tidemark.llm.jaccard_join import op7_jaccard_join
from tidemark.llm.language import op6_language_id
from tidemark.llm.mixing import op4_mix_sources
from tidemark.llm.phrases import OP13_SQL, op13_phrases
from tidemark.llm.quality import op1_quality_classifier
from tidemark.llm.repeats import op10_remove_repeats
from tidemark.llm.token_counts import op11_token_counts
from tidemark.llm.token_output import op2_token_output
from tidemark.llm.turn_repair import OP12_SQL, op12_turn_repair
from tidemark.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_token_output, op3_chat_format, op4_mix_sources, op5_url_filter, op6_language_id, op7_jaccard_join, op8_decontaminate, op9_exact_dedup, op10_remove_repeats, op11_token_counts, op12_turn_repair, op13_phrases)
}
SQL = {"op3_chat_format": OP3_SQL, "op5_url_filter": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op12_turn_repair": OP12_SQL, "op13_phrases": OP13_SQL}
