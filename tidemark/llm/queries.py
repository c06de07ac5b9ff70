"""The registered queries of this package and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import ann, bpe, chat, mixing, parsing, pii, simhash, toxicity, urls, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_neighbours": ann.op3_neighbours,
    "op4_pii": pii.op4_pii,
    "op5_bpe": bpe.op5_bpe,
    "op6_fingerprints": parsing.op6_fingerprints,
    "op7_preferences": chat.op7_preferences,
    "op8_simhash": simhash.op8_simhash,
    "op9_urls": urls.op9_urls,
    "op10_warc": warc.op10_warc,
}
ORACLE_SQL = {"op7_preferences": chat.SQL, "op9_urls": urls.SQL}
