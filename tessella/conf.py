"""Engine settings: validated, immutable, passed explicitly."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, fields

# Whole trimmed lines that are page furniture, matched without case.
BOILERPLATE = (
    r"reCAPTCHA",
    r"Recaptcha requires verification\.?",
    r"protected by \*\*reCAPTCHA\*\*",
    r"Privacy\s+-\s+Terms",
    r"Skip to (?:main )?content",
    r"Accept(?: all)? cookies",
    r"Manage cookies",
)
# Words that a title need not capitalise.
SMALL_WORDS = (
    "a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "nor",
    "of", "on", "or", "the", "to", "up", "via", "with", "is", "are", "be",
)
# File name extensions with a loader.
EXTENSIONS = (".json", ".zip", ".pdf", ".docx", ".md", ".txt", ".html", ".htm")


@dataclass(frozen=True)
class EngineConf:
    """Defaults of ingestion and retrieval.  Values out of range raise; nothing falls back silently."""

    embedding_dimensions: int = 768
    vector_store: str = "parquet"
    max_chunk_tokens: int = 450
    chunk_overlap_ratio: float = 0.15
    min_chunk_tokens: int = 12
    max_question_chars: int = 140
    max_toc_scan_lines: int = 60
    max_heading_chars: int = 90
    heading_caps_ratio: float = 0.6
    max_sentence_heading_chars: int = 70
    max_sentence_heading_words: int = 10
    min_heading_letters: int = 3
    max_heading_upper_ratio: float = 0.9
    max_heading_words: int = 14
    embed_batch_size: int = 64
    embed_concurrency: int = 2
    embed_max_retries: int = 5
    top_k: int = 8
    min_score: float = 0.55
    context_token_budget: int = 6000
    context_header_tokens: int = 40
    sibling_score_discount: float = 0.95
    condense_history_turns: int = 6
    citation_snippet_chars: int = 400
    chat_title_chars: int = 70
    history_turn_chars: int = 500
    max_upload_bytes: int = 20 * 1024 * 1024
    chat_model: str = "extractive-stub"
    embedding_model: str = "hash-stub"
    chat_temperature: float = 0.1
    data_dir: str = "./data"
    site_suffix: str = r"\s*\|\s*[^|]+\s*\z"
    site_default_title: str = ""
    title_collation: str = "UNICODE"

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and (not math.isfinite(v) or v < 0):
                raise ValueError(f"{f.name} must be a finite number of at least 0, not {v!r}")
        for name in ("embedding_dimensions", "max_chunk_tokens", "top_k", "embed_batch_size", "embed_concurrency"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.vector_store != "parquet":
            raise ValueError(f"unknown vector store {self.vector_store!r}")

    @property
    def overlap_tokens(self) -> int:
        return math.floor(self.max_chunk_tokens * self.chunk_overlap_ratio)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConf:
        """Settings from upper-cased environment names; a value that does not parse raises."""
        env = dict(os.environ) if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[str(f.type)](env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})


DEFAULT = EngineConf()
