"""Every knob of the engine, with its default."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Immutable settings that operators take; nothing is read from globals or the environment."""

    # fixed values: sizes and thresholds
    chunk_target: int = 14000
    chunk_hard: int = 21000
    recurring_max_len: int = 90
    recurring_min_count: int = 3
    key_length: int = 60
    header_max_size: float = 7.6
    heading_min_size: float = 11.0
    full_width: float = 260.0
    before_items: int = 2
    before_chars: int = 900
    after_items: int = 1
    after_chars: int = 400
    bottom_limit: float = 655.0
    centre_min_width: float = 20.0
    centre_share: float = 0.06
    row_tolerance: float = 2.5
    column_gap: float = 2.0
    cell_min_width: float = 20.0
    cell_min_height: float = 6.0
    cell_slack: float = 2.0
    right_margin: float = 566.0
    min_text_size: float = 4.5
    narrow_text_size: float = 4.2
    overlap: float = 2.0
    coverage_tolerance: float = 7.0
    coverage_min_words: int = 2
    coverage_max_miss: float = 0.05
    baseline_tolerance: float = 10.0
    empty_page_chars: int = 20
    watermark_min_len: int = 3
    watermark_max_len: int = 80
    watermark_min_count: int = 5
    watermark_share: float = 0.08
    truncation_min_source: int = 80
    truncation_share: float = 0.12
    short_output_share: float = 0.30
    paragraph_line_share: float = 0.82
    paragraph_share: float = 0.70
    page_suppression: int = 2
    # fixed values: sizes and line heights of a layout, as shares of the font size or in points
    size_min: float = 4.6
    size_share: float = 0.55
    one_line_chars: int = 60
    one_line_size: float = 4.7
    one_line_share: float = 0.78
    wide_block: float = 300.0
    narrow_block: float = 60.0
    single_line_height: float = 1.30
    line_height_min: float = 1.22
    line_height_max: float = 1.45
    line_height_table: float = 2.2
    line_height_spread: float = 2.4
    own_height: float = 1.2
    row_height_share: float = 0.9
    span_slack: float = 3.0
    hanging_least: float = 4.0
    hanging_room: float = 20.0
    hanging_slack: float = 2.0
    hanging_height: float = 1.24
    strip_least: float = 4.0
    strip_share: float = 0.95
    turned_full: float = 0.72
    turned_up: float = 0.18
    turned_down: float = 0.85
    turned_middle: float = 0.4
    stack_least: float = 5.0
    stack_share: float = 0.72
    stack_inset: float = 0.8
    contents_gap: float = 4.0
    grow_from: float = 1.03
    grow_by: float = 9.0
    sample_text: int = 40
    sample_streams: int = 30
    sample_characters: int = 60
    # fixed values: patterns and words that projects replace
    heading_pattern: str = (
        r"^(SECTION [A-Z0-9]|Section [0-9]|Appendix [A-Z]|APPENDIX [A-Z]|[0-9]+\.[0-9]+\s+\S|CHANGES|FOREWORD|CONTENTS|Contents|PART [0-9]"
        r"|Part [A-Z]{1,4}\b|ARTICLE [A-Z]{1,4}-|MANDATORY|NONMANDATORY|Annex [0-9]|Chapter [0-9]|[A-Z]{1,4}-[0-9]+[A-Z]?\b)"
    )
    running_head_pattern: str = r"^(Standard\s+—|Page\s+[0-9]+|[0-9]+/[0-9]+|Changes|Contents$)"
    terminal_pattern: str = r"[.!?:;”’)°]$"
    hint_pattern: str = r"(?i)(www\.|http|\.com|\.cn|\.net|免费下载|水印|扫描件|仅供|内部资料)"
    keep_prefixes: tuple[str, ...] = ("This copy of the document",)
    abbreviations: tuple[str, ...] = ("WLL", "ISO", "NDT", "ITP", "WPS", "HVAC")
    default_title: str = "文档起始"
    joiner: str = " ⏎ "
    toc_parity: bool = False
    modal_verbs: dict[str, str] = field(default_factory=lambda: {"shall not": "不应", "shall": "应", "should": "宜", "may": "可", "must": "必须"})


DEFAULT = EngineConfig()
