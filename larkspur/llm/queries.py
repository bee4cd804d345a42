"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import brown, licenses, linededup, mixing, packing, pivots, rules, sharding, simhash, toxicity

QUERIES = {
    "op1_brown": brown.op1_brown,
    "op2_packing": packing.op2_packing,
    "op3_sharding": sharding.op3_sharding,
    "op4_pivots": pivots.op4_pivots,
    "op5_rules": rules.op5_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_licenses": licenses.op7_licenses,
    "op8_mixing": mixing.op8_mixing,
    "op9_linededup": linededup.op9_linededup,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {"op2_packing": packing.SQL, "op3_sharding": sharding.SQL, "op4_pivots": pivots.SQL, "op5_rules": rules.SQL,
                              "op7_licenses": licenses.SQL, "op9_linededup": linededup.SQL, "op10_simhash": simhash.SQL}
