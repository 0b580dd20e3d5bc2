"""The registered queries of this subpackage: each operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import chat, digests, topk
from ledgerlake.llm.bpe import op3_bpe
from ledgerlake.llm.common import table
from ledgerlake.llm.hilbert import op9_hilbert
from ledgerlake.llm.packing import op10_packing
from ledgerlake.llm.periodic import op11_periodic
from ledgerlake.llm.quality import op5_quality
from ledgerlake.llm.scoring import op1_lm
from ledgerlake.llm.secrets import op4_secrets
from ledgerlake.llm.simhash import op2_simhash
from ledgerlake.llm.toxicity import op6_toxicity
from ledgerlake.llm.whitening import op13_whitening

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_lm": _over("documents", op1_lm),
    "op2_simhash": _over("documents", op2_simhash),
    "op4_secrets": _over("documents", op4_secrets),
    "op5_quality": _over("documents", op5_quality),
    "op6_toxicity": lambda spark, sf_dir: op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_pivots": _over("embeddings", topk.op7_pivots),
    "op8_chat": _over("conversations", chat.op8_chat),
    "op9_hilbert": _over("documents", op9_hilbert),
    "op3_bpe": _over("documents", op3_bpe),
    "op10_packing": _over("documents", op10_packing),
    "op11_periodic": _over("documents", op11_periodic),
    "op12_exact": _over("documents", digests.op12_exact),
    "op13_whitening": _over("embeddings", op13_whitening),
}

ORACLES: dict[str, str] = {
    "op7_pivots": topk.ORACLE,
    "op8_chat": chat.ORACLE,
    "op12_exact": digests.ORACLE,
}
