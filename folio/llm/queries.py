"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from folio.llm import bpe, counting, exact, importance, licenses, mixing, negatives, pii, quality, rules, simhash, substring, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_substring": substring.op3_substring,
    "op4_bpe": bpe.op4_bpe,
    "op5_licenses": licenses.op5_licenses,
    "op6_mixing": mixing.op6_mixing,
    "op7_rules": rules.op7_rules,
    "op8_quality": quality.op8_quality,
    "op9_urls": urls.op9_urls,
    "op10_exact": exact.op10_exact,
    "op11_negatives": negatives.op11_negatives,
    "op12_counts": counting.op12_counts,
    "op13_importance": importance.op13_importance,
}

ORACLE = {**exact.ORACLE, **substring.ORACLE, **urls.ORACLE, **negatives.ORACLE, **importance.ORACLE}
