"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from .bytebpe import op11_bytebpe
from .divergence import OP13_SQL, op13_divergence
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .htmltext import op4_htmltext
from .langid import op5_langid
from .linededup import op2_linededup
from .mixing import OP7_SQL, op7_mixing
from .packing import op10_packing
from .simhash import op6_simhash
from .spelling import OP12_SQL, op12_spelling
from .spotsigs import op8_spotsigs
from .substrings import OP9_SQL, op9_substrings
from .urlfilter import OP3_SQL, op3_urlfilter

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_linededup": op2_linededup,
    "op3_urlfilter": op3_urlfilter,
    "op4_htmltext": op4_htmltext,
    "op5_langid": op5_langid,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_spotsigs": op8_spotsigs,
    "op9_substrings": op9_substrings,
    "op10_packing": op10_packing,
    "op11_bytebpe": op11_bytebpe,
    "op12_spelling": op12_spelling,
    "op13_divergence": op13_divergence,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op3_urlfilter": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op9_substrings": OP9_SQL,
    "op12_spelling": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
