"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from farebox.llm.bitpack import op5_bit_packing
from farebox.llm.boundaries import op12_forced_boundaries
from farebox.llm.collocations import ORACLE as COLLOCATIONS_SQL
from farebox.llm.collocations import op11_collocations
from farebox.llm.gif import op8_gif
from farebox.llm.mixing import op6_pivotal_mixing
from farebox.llm.neighbours import op10_pruned_graph
from farebox.llm.packing import op9_lexical_packing
from farebox.llm.pii import op4_anchor_pii
from farebox.llm.resampling import op13_crc_resampling
from farebox.llm.simhash import op3_golay_simhash
from farebox.llm.toolcalls import ORACLE as CALLS_SQL
from farebox.llm.toolcalls import op1_tool_call_linking
from farebox.llm.toxicity import op7_nearest_toxicity
from farebox.llm.warc import ORACLE as WARC_SQL
from farebox.llm.warc import op2_content_addressed_warc

QUERIES = {
    "op1_tool_call_linking": op1_tool_call_linking,
    "op3_golay_simhash": op3_golay_simhash,
    "op4_anchor_pii": op4_anchor_pii,
    "op5_bit_packing": op5_bit_packing,
    "op2_content_addressed_warc": op2_content_addressed_warc,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_nearest_toxicity": op7_nearest_toxicity,
    "op8_gif": op8_gif,
    "op9_lexical_packing": op9_lexical_packing,
    "op10_pruned_graph": op10_pruned_graph,
    "op11_collocations": op11_collocations,
    "op12_forced_boundaries": op12_forced_boundaries,
    "op13_crc_resampling": op13_crc_resampling,
}
ORACLES: dict[str, str] = {
    "op1_tool_call_linking": CALLS_SQL,
    "op2_content_addressed_warc": WARC_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
}
