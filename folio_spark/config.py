"""Run configuration: defaults, overrides, presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from hashlib import sha256

#: What the choices may be.
DPI = ("72", "144", "200", "300")
VISION_MODES = ("none", "deepseek", "gemini", "openai", "ollama", "llama_cpp", "codex", "claude", "grok", "copilot")
SUMMARIZER_MODES = ("full", "topics_only", "skip")
SUMMARIZER_PROVIDERS = ("ollama", "llama_cpp", "openai", "codex", "claude", "grok", "copilot")
CLI_PROVIDERS = ("codex", "claude", "grok", "copilot")
#: Named sets of overrides.
PRESETS: dict[str, dict] = {
    "default": {},
    "vision-every-page": {"vision_skip_classification": True},
    "finetune-ingest": {"vision_mode": "codex", "summarizer_provider": "llama_cpp", "summarizer_detailed_extraction": True},
}


@dataclass(frozen=True)
class PipelineConfig:
    run_extraction: bool = True
    extract_only: bool = False
    skip_tables: bool = False
    skip_images: bool = False
    skip_pptx_tables: bool = False
    text_only: bool = False
    page_range: str | None = None
    pdf_image_dpi: str = "200"
    vision_mode: str = "none"
    vision_classifier_mode: str | None = None
    vision_extractor_mode: str | None = None
    vision_cli_provider: str | None = None
    vision_skip_classification: bool = False
    chunk_size: int = 3000
    chunk_overlap: int = 80
    run_summarization: bool = True
    summarizer_mode: str = "full"
    summarizer_provider: str = "llama_cpp"
    summarizer_detailed_extraction: bool = False
    summarizer_insight_mode: bool = False
    summarizer_cli_provider: str | None = None
    max_tokens_per_page: int = 100_000
    max_seconds_per_page: int = 300
    keep_base64_images: bool = False

    def __post_init__(self) -> None:
        choices = {
            "pdf_image_dpi": DPI, "vision_mode": VISION_MODES, "vision_classifier_mode": (None, *VISION_MODES), "vision_extractor_mode": (None, *VISION_MODES), "vision_cli_provider": (None, *CLI_PROVIDERS),
            "summarizer_mode": SUMMARIZER_MODES, "summarizer_provider": SUMMARIZER_PROVIDERS, "summarizer_cli_provider": (None, *CLI_PROVIDERS),
        }
        for name, valid in choices.items():
            if getattr(self, name) not in valid:
                raise ValueError(f"{name} must be one of {', '.join(v for v in valid if v)}")

    def merged(self, overrides: dict) -> "PipelineConfig":
        """With the overrides that are fields; others are ignored, nulls keep the value there was."""
        names = {f.name for f in fields(self)}
        known = {k: v for k, v in overrides.items() if k in names and v is not None}
        if "pdf_image_dpi" in known:
            known["pdf_image_dpi"] = str(known["pdf_image_dpi"])
        return replace(self, **known)

    def with_settings(self, settings: list[str]) -> "PipelineConfig":
        """``name=value`` settings; values are JSON where they parse as such, else text."""
        out = {}
        for s in settings:
            name, _, value = s.partition("=")
            try:
                out[name.strip()] = json.loads(value)
            except ValueError:
                out[name.strip()] = value
        return self.merged(out)

    def preset(self, name: str) -> "PipelineConfig":
        return self.merged(PRESETS[name])

    def digest(self) -> str:
        """The same for equal configurations; keys the result cache."""
        return sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:32]
