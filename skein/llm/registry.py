"""The corpus operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from . import ann, fixity, langid, linededup, mixing, neardup, packing, quality, secrets, urls
from .text import table

QUERIES = {
    "op1_line_suffix_array": linededup.result,
    "op2_host_trust": urls.result,
    "op3_order_minhash": neardup.result,
    "op4_merkle_audit": fixity.result,
    "op5_length_buckets": packing.result,
    "op6_additive_quantisation": ann.result,
    "op7_water_filling": mixing.result,
    "op8_langid_bitmask": lambda spark, d: langid.predicted(table(spark, d, "documents")),
    "op9_quality_crf": lambda spark, d: quality.result(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_secret_layers": lambda spark, d: secrets.scanned(table(spark, d, "documents").select("doc_id", "text")).drop("text"),
}
ORACLES = {
    "op1_line_suffix_array": linededup.ORACLE,
    "op2_host_trust": urls.ORACLE,
    "op4_merkle_audit": fixity.ORACLE,
}
