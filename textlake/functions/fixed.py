"""Fixed values that define the prompt and answer formats; they must stay exactly as written."""

# Answer markers, prompt headings and the end-marker instruction.
START_MARKER = "<| START OF RESPONSE |>"
END_MARKER = "<| END OF RESPONSE |>"
NO_INPUT = "<| No input |>"
CONTEXT_HEADING = "## Context"
REQUEST_HEADING = "## Request"
RESPONSE_HEADING = "## Response"
EXAMPLE_SUFFIX = " (Example)"
END_INSTRUCTION = f"Once you're finished responding, write {END_MARKER} on a line by itself."

# Fixed value: the rating an answer carries.
RATING_PATTERN = r"\(RATING: (\d{1,2})/10\)"

# Model context windows in tokens (any other model: the default).
MODEL_WINDOWS = {"gpt-3.5-turbo": 8000}
DEFAULT_WINDOW = 4000
MIN_OUTPUT_TOKENS = 1

# Characters Python's str.strip() removes (Unicode white space plus the separators \x1c-\x1f).
STRIP_CLASS = r"[\t\n\x0B\x0C\r\x1C\x1D\x1E\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
STRIP_CLASS_SQL = (r"[\t\n\x0B\x0C\r\x1C\x1D\x1E\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                   r"\x{202F}\x{205F}\x{3000}]")
