"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from rillgraph.llm import chat, decontaminate, embeddings, langid, lm, mixing, sharding, simhash, tokens, warc

MODULES = [mixing, decontaminate, sharding, chat, simhash, tokens, warc, embeddings, lm, langid]
QUERIES: dict = {m.NAME: m.query for m in MODULES}
ORACLES: dict = {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
