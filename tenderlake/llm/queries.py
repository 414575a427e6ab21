"""Queries of the corpus operators, for the driver's registry."""

from __future__ import annotations

from .audit import OP12_SQL, op12_filter_audit
from .bpe import op9_bpe_encoding
from .chat import op8_chat_formatting
from .fim import OP13_SQL, op13_fill_in_middle
from .jaccard import OP6_SQL, op6_ngram_jaccard
from .licences import OP10_SQL, op10_license_scans
from .mixing import OP2_SQL, op2_mixing_sources
from .packing import op11_best_fit_packing
from .quality import OP3_SQL, op3_quality_rules
from .retrieval import OP1_SQL, op1_topk_search
from .secrets import op5_secret_scans
from .sharding import OP4_SQL, op4_sharding
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_mixing_sources": op2_mixing_sources,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_secret_scans": op5_secret_scans,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_warc": op7_warc,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_bpe_encoding": op9_bpe_encoding,
    "op10_license_scans": op10_license_scans,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_topk_search": OP1_SQL,
    "op2_mixing_sources": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_sharding": OP4_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op10_license_scans": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
