"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

import corpus_pipeline

from .conversations import OP13_SQL, op13_conversation_repair
from .decontam import op3_decontamination
from .langid import op4_language_id
from .lm_score import op1_lm_score
from .media import op7_media_chunks
from .packing import op9_packing
from .quality import op12_quality_neighbours
from .runs import op11_periodic_runs
from .secrets import op8_secret_scan
from .simhash import op6_simhash_dedup
from .token_counts import op10_token_counts
from .toxicity import op2_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_lm_score": op1_lm_score,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_media_chunks": op7_media_chunks,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_neighbours": op12_quality_neighbours,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op13_conversation_repair": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
