"""Offline, deterministic stand-ins for the hosted model, used by tests, the bench and the registered
pipeline queries. A real deployment passes its own ``make_fn`` (a client built once per task)."""

from __future__ import annotations

import re

# Fixed value: the default tokenizer's token pattern.
_TOKEN = re.compile(r"[^ \t\n\r]+")
_BLOCK = re.compile(r"(?ms)^<!-- (\S+) -->\n?(`{3,})[^`\n]*\n(.*?)^\2[ \t]*$")
_START = "<| START OF RESPONSE |>"
_END = "<| END OF RESPONSE |>"


def _context(prompt: str) -> str:
    """The task context of a prompt: text after the last ``## Context`` heading, up to the next heading."""
    tail = prompt.rsplit("\n## Context\n", 1)[-1]
    for stop in ("\n## Request\n", "\n## Response\n"):
        tail = tail.split(stop, 1)[0]
    return tail


def make_token_echo():
    """Answers ``"<n> tokens"`` with n = tokens of the prompt."""
    def fn(prompts):
        return [f"{len(_TOKEN.findall(p))} tokens" for p in prompts]
    return fn


def make_rating_model():
    """Answers a comment with ``(RATING: n/10)``, n = tokens of the context mod 11."""
    def fn(prompts):
        return [f"Rated by length. (RATING: {len(_TOKEN.findall(_context(p))) % 11}/10)\n{_END}" for p in prompts]
    return fn


def make_commit_model():
    """Answers a one-line message naming the size of the context."""
    def fn(prompts):
        return [f"Update {len(_context(p).splitlines())} lines\n{_END}" for p in prompts]
    return fn


def make_bundle_model():
    """Transform stand-in: returns every file of the bundle in the context with its lines upper-cased and
    its last line dropped (so diffs have both additions and removals)."""
    def fn(prompts):
        out = []
        for p in prompts:
            blocks = []
            for path, fence, body in _BLOCK.findall(_context(p)):
                lines = body[:-1].split("\n") if body.endswith("\n") else body.split("\n")
                new = "\n".join(x.upper() for x in lines[:-1]) if len(lines) > 1 else body
                blocks.append(f"<!-- {path} -->\n{fence}\n{new}\n{fence}")
            out.append("\n".join(blocks) + f"\n{_END}")
        return out
    return fn


def make_marking_model():
    """Transform stand-in whose edit only inserts: every file of the bundle comes back with a last line added."""
    def fn(prompts):
        return ["\n".join(f"<!-- {path} -->\n{fence}\n{body}@@ end @@\n{fence}" for path, fence, body in
                          _BLOCK.findall(_context(p))) + f"\n{_END}" for p in prompts]
    return fn


def make_create_model():
    """Create stand-in: one file ``created/<n>.txt`` holding the request, n = tokens of the request."""
    def fn(prompts):
        out = []
        for p in prompts:
            req = p.rsplit("\n## Request\n", 1)[-1].split("\n## Response\n", 1)[0]
            out.append(f"<!-- created/{len(_TOKEN.findall(req))}.txt -->\n```\n{req}\n```\n{_END}")
        return out
    return fn
