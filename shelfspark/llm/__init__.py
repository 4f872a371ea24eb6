"""Training-data operators over a document corpus; nothing else in the library imports this package."""

from importlib import import_module

_MODULES = ("quality_rules", "sentencepiece_table", "token_files", "simhash", "sharding", "weighted_minhash", "packing", "toxicity", "quality_classifier", "html_extract", "conversation_repair", "merkle", "decontamination")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
