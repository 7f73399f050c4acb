"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op6_exact_dedup as _op6
from . import op2_warc as _op2
from . import op7_embedding_dedup as _op7
from . import op10_ngram_join as _op10
from . import op11_conversations as _op11
from . import op13_collocations as _op13
from .op1_bpe import op1_bpe
from .op2_warc import op2_warc
from .op3_mixing import op3_mixing
from .op4_line_dedup import op4_line_dedup
from .op5_langid import op5_langid
from .op6_exact_dedup import op6_exact_dedup
from .op7_embedding_dedup import op7_embedding_dedup
from .op8_secrets import op8_secrets
from .op9_quality import op9_quality
from .op10_ngram_join import op10_ngram_join
from .op11_conversations import op11_conversations
from .op12_media import op12_media
from .op13_collocations import op13_collocations

QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_mixing, op4_line_dedup, op5_langid, op6_exact_dedup, op7_embedding_dedup, op8_secrets, op9_quality, op10_ngram_join, op11_conversations, op12_media, op13_collocations)}
ORACLE_SQL = {"op2_warc": _op2.SQL, "op6_exact_dedup": _op6.SQL, "op7_embedding_dedup": _op7.SQL, "op10_ngram_join": _op10.SQL, "op11_conversations": _op11.SQL, "op13_collocations": _op13.SQL}
