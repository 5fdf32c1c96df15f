from .lines import flatten_newlines, line_count, newline_count, split_lines
from .tokens import DEFAULT_TOKENIZER, EncoderTokenizer, WhitespaceTokenizer, clip_tokens, token_count
from .vectors import cosine, dot, round6, sum_squares

__all__ = [
    "flatten_newlines", "line_count", "newline_count", "split_lines",
    "DEFAULT_TOKENIZER", "EncoderTokenizer", "WhitespaceTokenizer", "clip_tokens", "token_count",
    "cosine", "dot", "round6", "sum_squares",
]
