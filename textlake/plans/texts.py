"""Instruction texts and built-in examples of the pipelines (our own wording)."""

from __future__ import annotations

DEFAULT_PRE_PROMPT = (
    "You are a careful writing assistant. Answer the request using the given context, in a clear and "
    "professional style. When a format such as markdown is asked for, follow it exactly."
)

TRANSFORM_PRE_PROMPT = DEFAULT_PRE_PROMPT + (
    " The context is a series of files, each given as a comment holding its path followed by a fenced block "
    "with its contents. Answer in the same form: for every file you output, a comment with its path, then a "
    "fenced block."
)

CREATE_PRE_PROMPT = (
    "You are a careful assistant that writes files. Answer with a series of fenced blocks, each preceded by a "
    "comment that holds the file's relative path, for example <!-- docs/notes.txt -->."
)

COMMIT_PRE_PROMPT = DEFAULT_PRE_PROMPT + (
    "\n\nA useful commit message starts with a short subject in the present tense that says what changed, "
    "then, when needed, a body that says why and gives the context a reviewer needs."
)

RATING_PRE_PROMPT = (
    "Comment on the commit message in the context and rate it from 0 to 10. End with the rating written as "
    "(RATING: n/10)."
)

COMBINE_REQUEST = "Merge these commit messages into one short message."

# Built-in examples: (set, seq, context, request, response). request None = no request line.
BUILTIN_EXAMPLES = [
    ("commit", 0,
     "diff --git a/calc.py b/calc.py\n--- a/calc.py\n+++ b/calc.py\n@@ -1,3 +1,3 @@\n def area(r):\n"
     "-    return 3.14 * r * r\n+    return math.pi * r * r",
     "Write a commit message for the given diff (quality: 10/10)",
     "Use math.pi for the circle area"),
    ("commit", 1,
     "diff --git a/calc.py b/calc.py\n--- a/calc.py\n+++ b/calc.py\n@@ -4,2 +4,4 @@\n def ring(r, s):\n"
     "+    if s > r:\n+        raise ValueError(\"the hole is larger than the disc\")\n     return area(r) - area(s)",
     "Write a commit message for the given diff (quality: 10/10)",
     "Refuse rings whose hole is larger than the disc\n\nSuch a ring had a negative area, which callers only noticed much "
     "later. The error now names the cause where the mistake is made."),
    ("rating", 0, "fixed stuff", None,
     "Too vague: it says neither what was fixed nor why. (RATING: 1/10)"),
    ("rating", 1, "Use math.pi for the circle area", None,
     "Clear and short, in the present tense, but it does not say why the change matters. (RATING: 6/10)"),
    ("rating", 2,
     "Use math.pi for the circle area\n\nThe literal 3.14 lost precision for large radii; math.pi is exact "
     "to double precision.", None,
     "Clear subject, and the body explains the reason for the change. (RATING: 9/10)"),
    ("combine", 0, "Use math.pi for the circle area\nAdd a test for the circle area", COMBINE_REQUEST,
     "Use math.pi for the circle area and test it"),
]
