"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, collocations, importance, jaccard, mixing, simhash, warc, winnow
from .chat import op3_chat
from .collocations import op13_collocations
from .decontaminate import op1_decontaminate
from .importance import op12_importance
from .jaccard import op11_jaccard
from .langid import op5_langid
from .mixing import op8_mix
from .quality import op10_quality
from .secretscan import op9_secrets
from .simhash import op7_simhash
from .tokens import op4_tokens
from .warc import op2_warc
from .winnow import op6_winnow

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_chat": op3_chat,
    "op4_tokens": op4_tokens,
    "op5_langid": op5_langid,
    "op6_winnow": op6_winnow,
    "op7_simhash": op7_simhash,
    "op8_mix": op8_mix,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_jaccard": op11_jaccard,
    "op12_importance": op12_importance,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op3_chat": chat.SQL,
    "op6_winnow": winnow.SQL,
    "op7_simhash": simhash.SQL,
    "op8_mix": mixing.SQL,
    "op11_jaccard": jaccard.SQL,
    "op12_importance": importance.SQL,
    "op13_collocations": collocations.SQL,
}
