"""Settings with their defaults, read from the environment when made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

FALSE_WORDS = frozenset({"0", "false", "no"})


def _from_env(name: str, default):
    raw = os.environ.get(name)
    if raw is None:
        return default
    if isinstance(default, bool):
        return raw.strip().lower() not in FALSE_WORDS
    return type(default)(raw)


def env(name: str, default):
    return field(default_factory=lambda: _from_env(name, default), metadata={"env": name})


@dataclass(frozen=True)
class Settings:
    pdf_dir: str = env("PDF_DIR", "textbook")
    markdown_dir: str = env("MARKDOWN_DIR", "markdown_docs")
    index_dir: str = env("INDEX_DIR", "index")
    checkpoint_dir: str = env("INGEST_CHECKPOINT_DIR", "ingest_checkpoint")
    history_dir: str = env("CHAT_HISTORY_DIR", "chat_history")
    eval_dir: str = env("EVAL_DIR", "eval_artifacts")
    chunk_size: int = env("CHUNK_SIZE", 1000)
    chunk_overlap: int = env("CHUNK_OVERLAP", 400)
    embed_batch_size: int = env("EMBED_BATCH_SIZE", 64)
    add_batch_size: int = env("ADD_BATCH_SIZE", 256)
    top_k: int = env("TOP_K", 4)
    retriever_mode: str = env("RETRIEVER_MODE", "hybrid")
    hybrid_sparse_k: int = env("HYBRID_SPARSE_K", 8)
    hybrid_dense_weight: float = env("HYBRID_DENSE_WEIGHT", 0.6)
    hybrid_sparse_weight: float = env("HYBRID_SPARSE_WEIGHT", 0.4)
    hybrid_rrf_k: int = env("HYBRID_RRF_K", 60)
    mmr_fetch_k: int = env("MMR_FETCH_K", 20)
    mmr_lambda: float = env("MMR_LAMBDA", 0.5)
    conversational: bool = env("CONVERSATIONAL_RAG_ENABLED", True)
    chat_session_id: str = env("CHAT_SESSION_ID", "default")
    chat_history_max_turns: int = env("CHAT_HISTORY_MAX_TURNS", 6)
    model_name: str = env("LLM_MODEL", "stub")
    temperature: float = env("LLM_TEMPERATURE", 0.1)
    num_predict: int = env("LLM_NUM_PREDICT", 256)
    think: str = env("LLM_THINK", "auto")
    request_timeout_seconds: int = env("LLM_REQUEST_TIMEOUT_SECONDS", 0)
    judge_name: str = env("LLM_EVAL_MODEL", "stub")
    judge_num_predict: int = env("LLM_EVAL_NUM_PREDICT", 256)
    judge_retries: int = env("LLM_EVAL_JSON_RETRY_ATTEMPTS", 2)

    def env_names(self) -> dict[str, str]:
        return {f.name: f.metadata["env"] for f in fields(self)}


#: Model families that think unless told not to (fixed values).
THINKING_PREFIXES = ("qwen3", "deepseek-r1")


def thinks_by_default(model: str) -> bool:
    return (model or "").strip().lower().startswith(THINKING_PREFIXES)


def parse_think(value: str | bool | None, model: str) -> bool | None:
    """True, False or None (leave it to the model); ``auto`` turns thinking off for models that do it unasked."""
    if isinstance(value, bool):
        return value
    word = (value or "").strip().lower()
    if word in ("1", "true", "yes", "on"):
        return True
    if word in FALSE_WORDS | {"off"}:
        return False
    return False if thinks_by_default(model) else None


#: Seconds for an answer by model family; any other has the last entry's (fixed values).
TIMEOUTS = {"deepseek-r1": 600, "": 180}


def request_timeout(settings: Settings) -> int:
    """The setting, or the family's seconds where it is 0."""
    name = settings.model_name.strip().lower()
    return max(settings.request_timeout_seconds, 0) or next(v for k, v in TIMEOUTS.items() if name.startswith(k))


def merged_options(*parts: dict | None) -> dict:
    """Later options win; nulls are dropped."""
    return {k: v for part in parts for k, v in (part or {}).items() if v is not None}
