"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from functools import wraps

from weftgraph.llm.collocations import OP12_SQL, op12_collocations
from weftgraph.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from weftgraph.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from weftgraph.llm.language_id import op5_language_id
from weftgraph.llm.mixing import OP9_SQL, op9_mixing
from weftgraph.llm.packing import op8_packing
from weftgraph.llm.scratch import importable
from weftgraph.llm.secret_scan import op1_secret_scan
from weftgraph.llm.source_divergence import OP11_SQL, op11_source_divergence
from weftgraph.llm.suffix_dedup import op2_suffix_dedup
from weftgraph.llm.topk_search import OP3_SQL, op3_topk_search
from weftgraph.llm.url_filter import op4_url_filter
from weftgraph.llm.warc import OP13_SQL, op13_warc
from weftgraph.llm.window_dedup import OP6_SQL, op6_substring_dedup



def _ready(build):
    @wraps(build)
    def run(spark, sf_dir: str):
        importable(spark)
        return build(spark, sf_dir)

    return run


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_topk_search": op3_topk_search,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_warc": op13_warc,
}
QUERIES = {name: _ready(build) for name, build in QUERIES.items()}
ORACLE_SQL = {"op3_topk_search": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op9_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_collocations": OP12_SQL, "op13_warc": OP13_SQL}
