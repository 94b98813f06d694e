"""Settings of the build and of retrieval, as frozen values."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class ParseOptions:
    """What a re-ingest must notice when it changes: all of it is part of the fingerprint."""

    engine: str = "basic"
    pdf_strategy: str = "hi_res"
    ocr_languages: tuple[str, ...] = ("eng",)
    infer_tables: bool = True
    pdf_tables_as_csv: bool = True
    captions: bool = False
    caption_tokens: int = 64


@dataclass(frozen=True)
class ChunkOptions:
    """Token budget of a chunk and the share of it that neighbours have in common."""

    target_tokens: int = 300
    overlap: float = 0.12

    def __post_init__(self) -> None:
        object.__setattr__(self, "target_tokens", max(50, int(self.target_tokens)))
        object.__setattr__(self, "overlap", min(0.5, max(0.0, float(self.overlap))))

    @property
    def overlap_tokens(self) -> int:
        return int(self.target_tokens * self.overlap)


@dataclass(frozen=True)
class RetrievalConfig:
    """Depths, weights and the choice of steps of one question's way through the index."""

    k_summary: int = 60
    k_full: int = 60
    k_sparse: int = 60
    weights: tuple[float, float, float] = (0.9, 1.2, 0.8)
    rrf_constant: int = 60
    per_doc: int = 8
    pool: int = 120
    top_reranked: int = 40
    final_k: int = 10
    lambda_mmr: float = 0.8
    inject: bool = True
    previews: bool = True
    coherence: bool = True
    check_citations: bool = True
    mmr: bool = False
    keep_zero: bool = False
    slide_hints: tuple[str, ...] = ()
    system_prompt: str | None = None
    timeout: int = 60

    def replace(self, **changes: object) -> RetrievalConfig:
        """A changed copy; values out of bounds are errors."""
        new = replace(self, **changes)
        bounds = {"final_k": (1, 20), "per_doc": (1, 12), "lambda_mmr": (0, 1), "timeout": (10, 180)}
        for name, (low, high) in bounds.items():
            if not low <= getattr(new, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        return new


ONE_SHOT = RetrievalConfig()
CHAT = RetrievalConfig(per_doc=4, pool=100, top_reranked=20, final_k=8, lambda_mmr=0.7, inject=False, previews=False, coherence=False, check_citations=False, mmr=True)


def config_hash(*parts: object) -> str:
    """16 hex digits of SHA-256 over the parts; dataclasses count with all their fields."""
    plain = [asdict(p) if hasattr(p, "__dataclass_fields__") else p for p in parts]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]
