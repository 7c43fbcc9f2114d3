"""PII masking and corpus preparation on Spark; the public names load on use."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_HOMES = {
    "functions.languages": ["DEFAULT_ENTITIES", "LANGUAGES", "OPTIONAL_ENTITIES", "STRUCTURED_ENTITIES", "UnsupportedLanguageError", "guess_language"],
    "plans.anonymizer": ["AnonymizerConfig", "anonymize", "anonymize_conversations", "anonymize_parts", "deanonymize", "patched", "preview_then_upgrade", "scan"],
    "operators.generate": ["generate_cases", "samples"],
    "operators.restore": ["restore_table", "restored_with_report"],
    "streaming.restore": ["restore_batch", "restore_stream"],
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}
__all__ = ["__version__", *sorted(_HOME_OF)]


def __getattr__(name: str) -> object:
    if name not in _HOME_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_HOME_OF[name]}"), name)
