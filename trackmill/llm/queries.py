"""The training-data queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from trackmill.llm.audio import op4_audio
from trackmill.llm.decontam import op10_decontamination
from trackmill.llm.infill import OP11_SQL, op11_fill_in_middle
from trackmill.llm.lattice import op13_lattice_scores
from trackmill.llm.mixing import OP2_SQL, op2_mixing
from trackmill.llm.phrases import OP12_SQL, op12_phrases
from trackmill.llm.repeats import op3_repeats
from trackmill.llm.sharding import op7_sharding
from trackmill.llm.simhash import op5_simhash
from trackmill.llm.tokencount import op6_token_counts
from trackmill.llm.tokenfiles import op8_token_files
from trackmill.llm.toxicity import op9_toxicity
from trackmill.llm.warc import OP1_SQL, op1_warc

_ALL = (
    op1_warc, op2_mixing, op3_repeats, op4_audio, op5_simhash, op6_token_counts, op7_sharding, op8_token_files, op9_toxicity, op10_decontamination,
    op11_fill_in_middle, op12_phrases, op13_lattice_scores,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op1_warc": OP1_SQL, "op2_mixing": OP2_SQL, "op11_fill_in_middle": OP11_SQL, "op12_phrases": OP12_SQL}
