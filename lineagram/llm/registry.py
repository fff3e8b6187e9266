"""Queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineagram.llm import ann, anchors, html, langid, lm, mixing, quality, sentencepiece, simhash, suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_anchors": anchors.op2_anchors,
        "op3_lm": lm.op3_lm,
        "op4_html": html.op4_html,
        "op5_suffix": suffix.op5_suffix,
        "op6_quality_rules": quality.op6_quality_rules,
        "op10_simhash": simhash.op10_simhash,
        "op7_mixing": mixing.op7_mixing,
        "op8_langid": langid.op8_langid,
        "op9_sentencepiece": sentencepiece.op9_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_anchors": anchors.OP2_SQL}
