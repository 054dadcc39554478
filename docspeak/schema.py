"""Row types, options and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass

BLOCKS = "doc_id long, seq int, text string, label string, page_no int, bbox struct<l:double,t:double,r:double,b:double>"
REGIONS = "doc_id long, kind string, page_no int, bbox struct<l:double,t:double,r:double,b:double>"
PAGES = "doc_id long, page_no int, width double, height double"
JOB_METADATA = "job_id string, filename string, created_at string, source_pdf string, detected_language string, effective_language string, engine_used string, stats struct<pages:int,total_blocks:int,kept_blocks:int,dropped_blocks:int,dropped_by_label:map<string,int>,dropped_by_rule:map<string,int>,detected_language:string,reading_order_repaired:boolean,layout_regions_found:int,layout_filter_dropped:int,llm_blocks_processed:int,llm_blocks_dropped:int,llm_blocks_rewritten:int>"


@dataclass(frozen=True)
class Options:
    """What one run does to its documents."""

    language: str = "auto"
    voice: str = "auto"
    engine: str = "piper"
    speech_rate: float = 1.0
    keep_headings: bool = True
    remove_numeric_citations: bool = True
    drop_references_section: bool = True
    drop_acknowledgements: bool = True
    drop_appendices: bool = True
    chunk_max_chars: int = 900
    pause_ms: int = 220
    review: bool = False
    review_url: str = ""
    review_model: str = ""
    #: False repairs the odd corners of the rules: suspended hyphens, single capitals, numbered lists.
    strict_compat: bool = True


@dataclass(frozen=True)
class Settings:
    """Limits of the service, from the environment with a prefix of one's own."""

    max_pages: int = 200
    max_upload_bytes: int = 50 * 1024 * 1024
    max_active_jobs: int = 10
    retention_hours: int = 24
    grace_minutes: int = 10
    max_workers: int = 2
    speech_rate_min: float = 0.5
    speech_rate_max: float = 2.0
    review_url: str = ""
    review_model: str = ""
    review_enabled: bool = False
    data_dir: str = "data"
    cache_dir: str = "cache"
    host: str = "127.0.0.1"
    port: int = 8000

    @classmethod
    def from_env(cls, prefix: str = "DOCSPEAK_") -> Settings:
        """Whatever isn't set, or empty, keeps its default; yes, true and 1 are true."""
        given = {k: v.strip() for k in cls.__dataclass_fields__ if (v := os.environ.get(prefix + k.upper(), "").strip())}
        kinds = {k: type(f.default) for k, f in cls.__dataclass_fields__.items()}
        return cls(**{k: v.lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v) for k, v in given.items()})

    @property
    def uploads(self) -> str:
        return f"{self.data_dir.rstrip('/')}/uploads"

    @property
    def outputs(self) -> str:
        return f"{self.data_dir.rstrip('/')}/outputs"
