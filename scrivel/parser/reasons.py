"""Why a document loses something: the texts of reasons in warnings, by what they are about."""

#: What reports state, word for word; {} stands for a name or a number.
UNSUPPORTED_DESTINATION = "Dropped unsupported RTF destination content"
UNKNOWN_DESTINATION = "Dropped unknown destination group \\{}"
NONSHPPICT = "Dropped nonshppict in favor of shppict"
UNRESOLVED_OVERRIDE = "Unresolved list override ls_id={}"
LEGACY_NUMBERING = "Dropped legacy paragraph numbering content"
PAGE_START = "Invalid \\pgnstarts value; ignored"
IMAGE_FORMAT = "Dropped unsupported image format"
IMAGE_HEX = "Dropped malformed image hex payload"
LINK_SCHEME = "Unsupported hyperlink URL scheme"
LINK_URL = "Malformed or unsupported hyperlink URL"
LINK_WITHOUT_RUNS = "Hyperlink field had no text runs for clickable content"
MERGE_FIELD = "Unsupported field type: MERGEFIELD (result preserved)"
FIELD_DOWNGRADED = "Semantic field result contained non-run inline content; downgraded to text runs"
FIELD_UNRECOGNIZED = "Unrecognized field type; result text preserved"
FIELD_WITHOUT_RESULT = "Field with no result text"
UNSUPPORTED_WITHOUT_RESULT = "Dropped unsupported field type with no result"
FIELD_WITHOUT_INSTRUCTION = "Field with no instruction text"
FIELD_WITH_NEITHER = "Field with no instruction and no result"
INTBL_OUTSIDE = "\\intbl content without table row context"
PARAGRAPH_OUTSIDE = "Table paragraph without row context"
NESTED_OUTSIDE = "Nested table start without parent row context"
ROW_AT_NEW_ROW = "Unclosed table row at new row definition"
ROW_AT_END = "Unclosed table row at document end"
CELL_OUTSIDE = "\\cell encountered outside table context"
CELL_CONTROL_OUTSIDE = "Table cell control outside table context"
ROW_OUTSIDE = "\\row encountered outside table context"
ROW_CONTROL_OUTSIDE = "Table row control outside table context"
CELL_EDGES = "Non-increasing \\cellx boundaries at cell {}"
CELL_COUNTS = "Cell count ({}) does not match \\cellx count ({})"
CELL_COUNT_MISMATCH = "Table cell count mismatch"
ORPHAN_MERGE = "Orphan merge continuation without start - treating as standalone cell"
MERGE_SEMANTICS = "merge_semantics"
CELL_AT_DOCUMENT_END = "Unclosed table cell at document end"
CELL_AT_ROW_BOUNDARY = "Unclosed table cell at row boundary"
CELL_AT_ROW_END = "Unclosed table cell at row end"
