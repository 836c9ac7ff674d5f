"""The registered queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from trailmill.llm.bpe import op8_bpe
from trailmill.llm.chat import OP6_SQL, op6_chat
from trailmill.llm.decontaminate import op9_decontaminate
from trailmill.llm.linedup import OP7_SQL, op7_linedup
from trailmill.llm.lm import op2_lm
from trailmill.llm.media import op4_media
from trailmill.llm.neardup import op3_neardup
from trailmill.llm.phrases import OP13_SQL, op13_phrases
from trailmill.llm.quality import op10_quality
from trailmill.llm.secrets import op5_secrets
from trailmill.llm.tokenfile import op11_tokenfile
from trailmill.llm.toxicity import op1_toxicity
from trailmill.llm.veccodes import OP12_SQL, op12_veccodes

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_lm, op3_neardup, op4_media, op5_secrets, op6_chat, op7_linedup, op8_bpe, op9_decontaminate, op10_quality, op11_tokenfile, op12_veccodes, op13_phrases)
}
ORACLE_SQL = {"op6_chat": OP6_SQL, "op7_linedup": OP7_SQL, "op12_veccodes": OP12_SQL, "op13_phrases": OP13_SQL}
