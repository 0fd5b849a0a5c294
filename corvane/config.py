"""Settings of the retrieval plans; immutable, so an expansion makes a new one."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RetrievalConfig:
    # The defaults that results depend on.
    dense_k: int = 30
    sparse_k: int = 30
    candidate_k: int = 50
    rerank_k: int = 50
    rrf_k: int = 60
    min_chunk_chars: int = 80
    ingest_min_chars: int = 30
    max_per_source: int = 2
    max_per_section: int = 1
    final_k: int = 4
    max_variants: int = 8
    expansion_n: int = 3
    summary_k: int = 12
    hyde_k: int = 12
    summary_weight: float = 0.35
    hyde_weight: float = 0.35
    evidence_capacity: int = 5
    pad_zero: bool = False

    @property
    def hybrid_k(self) -> int:
        """How many documents the hybrid stage hands on."""
        return max(self.final_k, max(12, 3 * self.final_k))

    @property
    def per_query_k(self) -> int:
        return max(4, self.dense_k // 2)

    def expanded(self, cap: int = 20) -> RetrievalConfig:
        """For another round: every k doubled up to ``cap``, never made smaller."""
        wider = lambda k: max(k, min(2 * k, cap))
        names = ("dense_k", "sparse_k", "candidate_k", "rerank_k", "final_k", "summary_k", "hyde_k")
        return replace(self, **{n: wider(getattr(self, n)) for n in names})


DEFAULT = RetrievalConfig()
