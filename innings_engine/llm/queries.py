"""One query per operator over its whole table; each takes (spark, sf_dir)."""
from __future__ import annotations

import public_tokenizers

from . import coordinates, decontaminate, derivatives, lexicon, outliers, ranked, rans, repeats, simhash, tool_calls, toxicity, url_lists, whitening
from .scratch import table

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def op1_token_output(spark, sf_dir):
    return rans.read(*rans.write(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID))


def op2_substring_dedup(spark, sf_dir):
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def op3_tool_calls(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return tool_calls.linked(tool_calls.calls_of(turns), tool_calls.results_of(turns), tool_calls.schemas_of(spark))


def op4_warc_derivatives(spark, sf_dir):
    return derivatives.derivatives(derivatives.responses_of(table(spark, sf_dir, "pages")))


def op5_bpe_round_trip(spark, sf_dir):
    return lexicon.encoded(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op6_robust_outliers(spark, sf_dir):
    return outliers.outlier_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_temporal_url_lists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.judged(url_lists.captures_of(pages), url_lists.entries_of(pages))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))


def op12_minhash_dedup(spark, sf_dir):
    return coordinates.near_duplicates(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark, sf_dir):
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_token_output, op2_substring_dedup, op3_tool_calls, op4_warc_derivatives, op5_bpe_round_trip, op6_robust_outliers, op7_toxicity, op8_decontamination,
    op9_simhash_dedup, op10_temporal_url_lists, op11_embedding_whitening, op12_minhash_dedup, op13_ranked_search)}
#: The other queries are tested against brute force, as SQL can't express them or is too slow on whole tables.
SQL = {"op3_tool_calls": tool_calls.SQL, "op10_temporal_url_lists": url_lists.SQL, "op12_minhash_dedup": coordinates.SQL, "op13_ranked_search": ranked.SQL}
