"""The registered queries of this subpackage and their DuckDB SQL."""

from .decontaminate import op10_decontaminate
from .dual_tree import OP11_SQL, op11_dual_tree
from .fuzzy_lines import op8_fuzzy_lines
from .kneser_ney import op1_kneser_ney
from .langid import op9_language_id
from .license_diagonals import op6_license_diagonals
from .merkle import OP12_SQL, op12_merkle_manifest
from .minhash import op4_minhash
from .mixture import OP7_SQL, op7_mix_sources
from .secret_ledger import op3_secret_ledger
from .target_ratio import op5_target_ratio
from .token_rollup import op2_token_rollup
from .url_rules import op13_url_rules

QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_token_rollup": op2_token_rollup,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_minhash": op4_minhash,
    "op5_target_ratio": op5_target_ratio,
    "op6_license_diagonals": op6_license_diagonals,
    "op7_mix_sources": op7_mix_sources,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_dual_tree": op11_dual_tree,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_rules": op13_url_rules,
}

SQL = {"op7_mix_sources": OP7_SQL, "op11_dual_tree": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
