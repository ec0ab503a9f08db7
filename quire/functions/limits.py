"""Fixed values of the packet model: limits, vocabularies, paper sizes, finding codes."""

# Fixed limits.
MAX_NESTING = 64
MAX_FIELD_CHARACTERS = 10_000
MAX_ITEMS = 100_000
MAX_RANGE_PAIRS = 100_000
MAX_GENERATED_PAGES = 100_000
MAX_TEXT_BYTES = 64 * 1024 * 1024
MAX_MANIFEST_BYTES = 64 * 1024 * 1024
MAX_SIDE_POINTS = 14_400.0
MAX_PAGE_INDEX = 9_223_372_036_854_775_807
MAX_TIMESTAMP = 253_402_300_799
MANIFEST_VERSION = 8
REPORT_VERSION = 10
SUMMARY_LIMIT = 20
DEFAULT_FIT_TOLERANCE = 0.01
UNNUMBERED_LABEL = "—"

# Fixed vocabularies.
ITEM_KINDS = ["source", "page", "contents", "group"]
NUMBERED_KINDS = ["source", "page", "divider", "contents"]
NUMBERING_MODES = ["physical", "consecutive"]
STRUCTURE_POLICIES = ["preserve", "discard"]
START_VALUES = ["any", "odd"]
NUMBER_POSITIONS = ["top-left", "top-center", "top-right", "bottom-left", "bottom-center", "bottom-right"]

# Fixed paper sizes: name -> (width, height, unit).
PAPERS = {
    "A3": (297, 420, "mm"),
    "A4": (210, 297, "mm"),
    "A5": (148, 210, "mm"),
    "B4": (250, 353, "mm"),
    "B5": (176, 250, "mm"),
    "Letter": (612, 792, "pt"),
    "Legal": (612, 1008, "pt"),
    "Tabloid": (792, 1224, "pt"),
}

# Fixed units: name -> (points times denominator, denominator).
UNITS = {"pt": (1, 1), "mm": (360, 127), "cm": (3600, 127), "in": (72, 1)}

# Fixed grandfathered language tags (RFC 5646).
GRANDFATHERED_TAGS = [
    "art-lojban", "cel-gaulish", "en-gb-oed", "i-ami", "i-bnn", "i-default", "i-enochian", "i-hak", "i-klingon",
    "i-lux", "i-mingo", "i-navajo", "i-pwn", "i-tao", "i-tay", "i-tsu", "no-bok", "no-nyn", "sgn-be-fr", "sgn-be-nl",
    "sgn-ch-de", "zh-guoyu", "zh-hakka", "zh-min", "zh-min-nan", "zh-xiang",
]

# Fixed finding codes: code -> (severity, class).
FINDING_CODES = {
    "request_invalid": ("error", "invalid"),
    "source_selection_out_of_range": ("error", "invalid"),
    "source_selection_form_unsupported": ("error", "invalid"),
    "source_navigation_removed": ("warning", None),
    "source_outline_depth_unsupported": ("error", "invalid"),
    "source_form_unsupported": ("error", "invalid"),
    "source_uri_base_removed": ("warning", None),
    "output_required": ("error", "invalid"),
    "plan_unreadable": ("error", "failed"),
    "plan_too_large": ("error", "invalid"),
    "plan_syntax": ("error", "invalid"),
    "plan_version_unsupported": ("error", "invalid"),
    "plan_unknown_member": ("error", "invalid"),
    "plan_duplicate_member": ("error", "invalid"),
    "plan_null": ("error", "invalid"),
    "plan_type": ("error", "invalid"),
    "plan_value": ("error", "invalid"),
    "plan_item_shape": ("error", "invalid"),
    "plan_limit": ("error", "invalid"),
    "path_invalid": ("error", "invalid"),
    "output_exists": ("error", "invalid"),
    "report_exists": ("error", "invalid"),
    "output_parent_invalid": ("error", "invalid"),
    "report_parent_invalid": ("error", "invalid"),
    "output_not_regular": ("error", "invalid"),
    "report_not_regular": ("error", "invalid"),
    "output_is_input": ("error", "invalid"),
    "report_is_input": ("error", "invalid"),
    "report_is_output": ("error", "invalid"),
    "font_unreadable": ("error", "failed"),
    "font_invalid": ("error", "invalid"),
    "font_not_embeddable": ("error", "invalid"),
    "text_unsupported_character": ("error", "invalid"),
    "text_glyph_missing": ("error", "invalid"),
    "text_overflow": ("error", "invalid"),
    "page_size_required": ("error", "invalid"),
    "page_size_too_large": ("error", "invalid"),
    "source_unreadable": ("error", "failed"),
    "source_changed": ("error", "failed"),
    "source_structure_partial": ("warning", None),
    "source_not_pdf": ("error", "invalid"),
    "source_input_invalid": ("error", "invalid"),
    "plan_input_invalid": ("error", "invalid"),
    "font_input_invalid": ("error", "invalid"),
    "source_xref_entry_ignored": ("warning", None),
    "source_invalid": ("error", "invalid"),
    "source_unsupported": ("error", "invalid"),
    "source_processing_failed": ("error", "failed"),
    "source_validation_notice": ("warning", None),
    "source_viewer_settings_removed": ("warning", None),
    "source_damaged": ("error", "invalid"),
    "source_encrypted": ("error", "invalid"),
    "source_signed": ("error", "invalid"),
    "source_dynamic_form": ("error", "invalid"),
    "source_optional_content": ("error", "invalid"),
    "fit_geometry_unsupported": ("error", "invalid"),
    "fit_annotation_ownership_unsupported": ("error", "invalid"),
    "fit_print_box_omitted": ("warning", None),
    "fit_destination_unsupported": ("error", "invalid"),
    "source_output_incompatible": ("error", "invalid"),
    "fit_annotation_unsupported": ("error", "invalid"),
    "fit_form_unsupported": ("error", "invalid"),
    "assembly_failed": ("error", "failed"),
    "output_write_failed": ("error", "failed"),
    "output_invalid": ("error", "failed"),
    "output_page_count_mismatch": ("error", "failed"),
    "output_publish_failed": ("error", "failed"),
    "report_write_failed": ("error", "failed"),
    "interrupted": ("error", "interrupted"),
    "text_overflow_allowed": ("warning", None),
    "form_fields_renamed": ("warning", None),
    "form_appearance_regeneration_requested": ("warning", None),
    "destinations_renamed": ("warning", None),
    "destinations_dropped": ("warning", None),
    "source_xfa_removed": ("warning", None),
    "source_structure_orphaned": ("warning", None),
    "source_structure_index_normalized": ("warning", None),
    "source_structure_removed": ("warning", None),
    "source_page_labels_removed": ("warning", None),
    "source_output_intents_removed": ("warning", None),
    "source_document_actions_removed": ("warning", None),
    "source_attachments_removed": ("warning", None),
    "working_directory_unavailable": ("error", "failed"),
    "output_inspection_failed": ("error", "failed"),
    "report_inspection_failed": ("error", "failed"),
}

# Fixed precedence: publication failures first, then interrupted > failed > invalid > warnings.
PUBLICATION_FAILURES = ["report_write_failed", "output_publish_failed"]
CLASS_PRIORITY = {"interrupted": 3, "failed": 2, "invalid": 1}
STATUS_BY_PRIORITY = {3: "interrupted", 2: "failed", 1: "invalid", 0: "ok"}
