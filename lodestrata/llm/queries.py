"""The training-data queries of ``__spark_entry__`` and their SQL: whole tables, production parameters."""

from __future__ import annotations

import os

from . import ann, bpe, ctw, decontam, fim, htmlmain, linededup, simhash, tokenpack, toolcalls, toxicity, warc, whitening
from .common import table


def tokenizer_file(name: str) -> str:
    """A public tokenizer file: from the folder in TOKENIZER_DIR if set, else as the installed package says."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_context_tree(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents"))


def op4_token_blocks(spark, sf_dir):
    return tokenpack.token_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_tool_calls(spark, sf_dir):
    return toolcalls.link_calls(toolcalls.derived_calls(table(spark, sf_dir, "conversations")), toolcalls.derived_tools(spark))


def op6_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), ranks=tokenizer_file("byte_bpe_50k.tiktoken"))


def op7_line_dedup(spark, sf_dir):
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents"), removed_col="n_removed").select("doc_id", "text", "n_removed")


def op8_main_text(spark, sf_dir):
    return htmlmain.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_one_bit_codes(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_warc(spark, sf_dir):
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op12_fill_in_middle(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_context_tree, op4_token_blocks, op5_tool_calls, op6_bpe, op7_line_dedup, op8_main_text, op9_one_bit_codes, op10_toxicity, op11_warc, op12_fill_in_middle, op13_whitening)}
ORACLE = {"op2_decontamination": decontam.ORACLE, "op5_tool_calls": toolcalls.ORACLE, "op7_line_dedup": linededup.ORACLE, "op11_warc": warc.ORACLE, "op12_fill_in_middle": fim.ORACLE}
