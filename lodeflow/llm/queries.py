"""The queries of this subpackage, and SQL for those that SQL can express."""

from .chat import OP11_SQL, op11_template_chat
from .fingerprints import op2_weighted_sampling
from .hosts import OP3_SQL, op3_host_reputation
from .language_model import op9_log_frequency_bloom
from .mixing import op6_golden_ratio_mix
from .near_dedup import OP8_SQL, op8_minmax_near_dedup
from .personal_data import op7_bilstm_crf_personal_data
from .quality import op1_zstd_quality
from .runs import op12_suffix_automaton_runs
from .search import OP13_SQL, op13_two_level_search
from .secret_scan import op4_secret_ownership
from .token_files import op10_rans_token_files
from .winnowing import OP5_SQL, op5_winnowing_decontamination

QUERIES = {
    "op7_bilstm_crf_personal_data": op7_bilstm_crf_personal_data,
    "op9_log_frequency_bloom": op9_log_frequency_bloom,
    "op2_weighted_sampling": op2_weighted_sampling,
    "op4_secret_ownership": op4_secret_ownership,
    "op3_host_reputation": op3_host_reputation,
    "op5_winnowing_decontamination": op5_winnowing_decontamination,
    "op1_zstd_quality": op1_zstd_quality,
    "op6_golden_ratio_mix": op6_golden_ratio_mix,
    "op8_minmax_near_dedup": op8_minmax_near_dedup,
    "op10_rans_token_files": op10_rans_token_files,
    "op11_template_chat": op11_template_chat,
    "op12_suffix_automaton_runs": op12_suffix_automaton_runs,
    "op13_two_level_search": op13_two_level_search,
}
ORACLES = {
    "op3_host_reputation": OP3_SQL,
    "op5_winnowing_decontamination": OP5_SQL,
    "op8_minmax_near_dedup": OP8_SQL,
    "op11_template_chat": OP11_SQL,
    "op13_two_level_search": OP13_SQL,
}
