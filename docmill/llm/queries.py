"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import bpe, dualtree, exact_dedup, maxent, minhash, mixing, packing, pii, secret_scan, token_file, topk, toxicity, whitening

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_mixing": mixing.op2_mixing,
    "op3_minhash": minhash.op3_minhash,
    "op4_maxent": maxent.op4_maxent,
    "op5_bpe": bpe.op5_bpe,
    "op6_token_file": token_file.op6_token_file,
    "op7_topk": topk.op7_topk,
    "op8_pii": pii.op8_pii,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_packing": packing.op12_packing,
    "op13_dualtree": dualtree.op13_dualtree,
}

SQL = {
    "op2_mixing": mixing.SQL,
    "op3_minhash": minhash.SQL,
    "op7_topk": topk.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op13_dualtree": dualtree.SQL,
}
