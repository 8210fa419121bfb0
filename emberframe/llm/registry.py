"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import bpe, decontamination, exact_dedup, language, ranked_search, secrets, set_join, simhash_balls, token_files, tool_calls, toxicity, warc, word_runs

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language": language.op2_language,
    "op3_warc": warc.op3_warc,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_jaccard_join": set_join.op6_jaccard_join,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_token_files": token_files.op8_token_files,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_simhash_balls": simhash_balls.op11_simhash_balls,
    "op12_word_runs": word_runs.op12_word_runs,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLES = {
    "op3_warc": warc.OP3_SQL,
    "op4_tool_calls": tool_calls.OP4_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op6_jaccard_join": set_join.OP6_SQL,
    "op7_secret_scan": secrets.OP7_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
