"""Settings of a chunking run, checked when made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

TEMPLATES = ("generic_structured", "contract_terms", "laws", "paper", "book", "manual", "table_data", "picture_pdf", "qa")
PARSERS = ("docling", "mineru", "pypdf", "table_file", "text_file")


@dataclass(frozen=True)
class ChunkConfig:
    template: str = "auto"
    parser: str = "auto"
    child_max_tokens: int = 450
    child_min_tokens: int = 80
    parent_granularity: str = "chapter"
    table_context_blocks: int = 2
    image_context_blocks: int = 2

    def __post_init__(self) -> None:
        for name, low, high in (("child_max_tokens", 50, 3000), ("child_min_tokens", 0, 500), ("table_context_blocks", 0, 10), ("image_context_blocks", 0, 10)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.template != "auto" and self.template not in TEMPLATES:
            raise ValueError(f"unknown template {self.template!r}")
        if self.parser != "auto" and self.parser not in PARSERS:
            raise ValueError(f"unknown parser {self.parser!r}")
        if self.parent_granularity not in ("chapter", "section"):
            raise ValueError("parent_granularity is chapter or section")

    @property
    def merge_below(self) -> int:
        return max(1, self.child_min_tokens // 2)


@dataclass(frozen=True)
class FlatConfig:
    """Settings of flat chunks."""

    max_tokens: int = 400
    chunk_size_tokens: int = 400
    overlap_tokens: int = 100
    min_chunk_tokens: int = 50

    def __post_init__(self) -> None:
        if self.chunk_size_tokens < 50 or not 0 <= self.overlap_tokens < self.chunk_size_tokens:
            raise ValueError("chunk_size_tokens must be 50 or more, and overlap_tokens less than it")
        for name, low, high in (("max_tokens", 50, 2000), ("chunk_size_tokens", 50, 2000), ("overlap_tokens", 0, 500), ("min_chunk_tokens", 0, 500)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")


#: Files that a request may bring.
SUFFIXES = ("pdf", "csv", "tsv", "xlsx", "xlsm", "txt", "md", "markdown")


def check_request(filename: str, **options) -> ChunkConfig:
    """The settings of a request, or a ValueError: its file must have a name and a known suffix, its options known names and values in range."""
    if not filename or filename.lower().rpartition(".")[2] not in SUFFIXES or "." not in filename:
        raise ValueError(f"unsupported file {filename!r}; one of {', '.join(SUFFIXES)} is wanted")
    try:
        return ChunkConfig(**options)
    except TypeError as e:
        raise ValueError(str(e)) from e


def priority_from(environment: Mapping[str, str], name: str = "DOCLOOM_PARSER_PRIORITY") -> tuple[str, ...]:
    """The order of PDF parsers that the environment asks for; unknown names are passed over, and none is the usual order."""
    asked = [x.strip().lower() for x in environment.get(name, "").split(",")]
    return tuple(x for x in asked if x in PARSERS[:3]) or PARSERS[:3]


def setting_from(environment: Mapping[str, str], name: str, default: bool | int | float) -> bool | int | float:
    """A switch or number of the environment, by the kind of its default; what isn't one is the default."""
    raw = environment.get(name)
    if raw is None:
        return default
    if isinstance(default, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(raw)
    except ValueError:
        return default


def parsers_for(path: str, parser: str = "auto", priority: tuple[str, ...] = ("docling", "mineru", "pypdf")) -> list[str]:
    """Engines to try for a file, in order."""
    suffix = path.lower().rpartition(".")[2] if "." in path else ""
    if parser in ("docling", "mineru"):
        return [parser, "pypdf"]
    if parser != "auto":
        return [parser]
    if suffix in ("csv", "tsv", "xlsx", "xlsm"):
        return ["table_file"]
    if suffix in ("txt", "md", "markdown"):
        return ["text_file"]
    return [p for p in priority if p in PARSERS[:3]] or list(PARSERS[:3])
