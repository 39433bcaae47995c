"""The queries of this subpackage, and the SQL of those that SQL can express."""

from bandgraph.llm import cws, decontaminate, langid, licenses, line_dedup, lm, mixing, partenum, toxicity, warc

QUERIES = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op10_license_scan": licenses.op10_license_scan,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op4_ngram_jaccard": partenum.op4_ngram_jaccard,
    "op2_document_fingerprints": cws.op2_document_fingerprints,
    "op9_language_id": langid.op9_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_source_mixing": mixing.op6_source_mixing,
}
ORACLE = {
    "op4_ngram_jaccard": partenum.ORACLE,
    "op1_warc_revisits": warc.ORACLE,
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
}
