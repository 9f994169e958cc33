"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from docengine.llm.align import op13_align
from docengine.llm.archives import op12_archives
from docengine.llm.bpe import op3_bpe
from docengine.llm.codes import OP11_SQL, op11_codes
from docengine.llm.decontaminate import op1_decontaminate
from docengine.llm.html import op5_html
from docengine.llm.langid import op7_langid
from docengine.llm.ngram_join import OP6_SQL, op6_ngram_join
from docengine.llm.secrets import OP10_SQL, op10_secrets
from docengine.llm.substrings import op8_substrings
from docengine.llm.topk import OP9_SQL, op9_topk
from docengine.llm.toxicity import op2_toxicity
from docengine.llm.urls import op4_urls

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_urls": op4_urls,
    "op5_html": op5_html,
    "op6_ngram_join": op6_ngram_join,
    "op7_langid": op7_langid,
    "op8_substrings": op8_substrings,
    "op9_topk": op9_topk,
    "op10_secrets": op10_secrets,
    "op11_codes": op11_codes,
    "op12_archives": op12_archives,
    "op13_align": op13_align,
}
ORACLES = {"op6_ngram_join": OP6_SQL, "op9_topk": OP9_SQL, "op10_secrets": OP10_SQL, "op11_codes": OP11_SQL}
