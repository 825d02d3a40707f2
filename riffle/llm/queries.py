"""The registered queries of these operators, and the SQL that checks those which SQL can express."""

from riffle.llm.chat_format import SQL as CHAT_SQL
from riffle.llm.chat_format import op1_chat_format
from riffle.llm.decontaminate import SQL as OVERLAP_SQL
from riffle.llm.decontaminate import op5_decontaminate
from riffle.llm.hard_negatives import SQL as NEGATIVES_SQL
from riffle.llm.hard_negatives import op11_hard_negatives
from riffle.llm.language_id import op9_language_id
from riffle.llm.line_dedup import op2_line_dedup
from riffle.llm.near_duplicates import op6_near_duplicates
from riffle.llm.packing import op8_packing
from riffle.llm.periodic_runs import op12_periodic_runs
from riffle.llm.quality_model import op10_quality_classifier
from riffle.llm.quality_rules import SQL as RULES_SQL
from riffle.llm.quality_rules import op4_quality_rules
from riffle.llm.secret_scan import op13_secret_scan
from riffle.llm.suffix_dedup import SQL as REPEATS_SQL
from riffle.llm.suffix_dedup import op3_suffix_dedup
from riffle.llm.token_files import op7_token_files

QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_line_dedup, op3_suffix_dedup, op4_quality_rules, op5_decontaminate, op6_near_duplicates,
    op7_token_files, op8_packing, op9_language_id, op10_quality_classifier, op11_hard_negatives, op12_periodic_runs, op13_secret_scan)}
ORACLES = {"op1_chat_format": CHAT_SQL, "op3_suffix_dedup": REPEATS_SQL, "op4_quality_rules": RULES_SQL, "op5_decontaminate": OVERLAP_SQL,
           "op11_hard_negatives": NEGATIVES_SQL}
