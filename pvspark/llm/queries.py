"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pvspark.llm import filter_audit, licenses, merkle
from pvspark.llm.decontaminate import op3_decontaminate
from pvspark.llm.embeddings import op4_embedding_dedup
from pvspark.llm.filter_audit import op13_filter_audit
from pvspark.llm.fingerprints import op12_fingerprints
from pvspark.llm.jaccard_join import op8_jaccard_join
from pvspark.llm.licenses import op2_license_scan
from pvspark.llm.lm_scoring import op7_lm_scoring
from pvspark.llm.merkle import op11_merkle_manifest
from pvspark.llm.packing import op9_best_fit_packing
from pvspark.llm.pii import op1_pii
from pvspark.llm.quality import op10_quality
from pvspark.llm.secrets_scan import op5_secrets
from pvspark.llm.toxicity import op6_toxicity


def queries() -> dict:
    every = (op1_pii, op2_license_scan, op3_decontaminate, op4_embedding_dedup, op5_secrets, op6_toxicity, op7_lm_scoring, op8_jaccard_join, op9_best_fit_packing, op10_quality, op11_merkle_manifest, op12_fingerprints, op13_filter_audit)
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op11_merkle_manifest": merkle.oracle(), "op13_filter_audit": filter_audit.oracle()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
