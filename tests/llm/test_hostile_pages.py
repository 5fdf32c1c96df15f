"""Pages of a megabyte that once took a time quadratic in their length, and malformed tags on small pages."""

import time

import pytest

from textlake.llm.html_main import TagEnds, main_text

M = 1_000_000
PAGES = {"open tags": "<a " * (M // 3), "one name": "<a" * (M // 2), "open quotes": '<a href="x' * (M // 10),
         "nested": "<div>" * (M // 5), "nested text": "<div>x" * (M // 6), "quoted ends": '<a ">" ' * (M // 7),
         "mixed quotes": "<a '\">\"' \"" * (M // 11), "long attribute": "<a " + "x" * M + " =1>t",
         "inline": "<b>" * (M // 6) + "x<hr>" * (M // 10), "stray ends": "<div>" * (M // 10) + "</p></x>" * (M // 16),
         "embedded": "<svg>" + "<g>" * (M // 6) + "</x>" * (M // 8) + "</svg>", "tables": "<p><table>" * (M // 10),
         "lists": "<ul><li>x" * (M // 9), "comments": "<!--" * (M // 4), "references": "&amp" * (M // 4)}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_a_megabyte_takes_seconds(name):
    began = time.process_time()
    main_text(PAGES[name])
    assert time.process_time() - began < 10


def brute_end(page, start):
    """The first ``>`` outside quotes; an unclosed quote or none at all: -1."""
    at = start
    while at < len(page):
        c = page[at]
        if c == ">":
            return at
        if c in "\"'":
            at = page.find(c, at + 1)
            if at < 0:
                return -1
        at += 1
    return -1


def test_tag_ends_match_a_plain_scan():
    import random

    rnd = random.Random(2)
    for _ in range(3000):
        page = "".join(rnd.choice("<a>\"' x") for _ in range(rnd.randint(1, 40)))
        ends = TagEnds(page)
        start = 0
        while start <= len(page):  # as the scanner asks: ever further on, past each tag found
            want = brute_end(page, start)
            assert ends.find(start) == want, (page, start)
            start = want + 1 if want >= 0 else start + 1


def test_tags_without_an_end_are_text():
    long = "This is a paragraph of plain prose, long enough to be taken for the article's own text. " * 4
    assert main_text(f"<article><p>{long}</p><p>{long} a < b and c <d") == f"{long.strip()}\n\n{long}a < b and c <d"
