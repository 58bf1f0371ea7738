"""Pages with optional, self-closed and missing end tags lose no text."""

import pytest

from drawloom.llm import html_blocks as hb


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<head><title>x</title><body><article><p>One story.", "One story."),
        ("<html><head><meta a=b><title>x</title><header>Top</header><p>One", "Top One"),
        ("<head><title>x</title><style>p{}</style>\n<script>a</script>Bare text<p>One", "Bare text One"),
        ("<head><title>x <b>y</title><noscript><p>n</noscript><link a></head><p>One", "One"),
        ("<head><title>x<body><p>One</p>", "x One"),
        ("One <svg/> two</p><p>Three", "One two Three"),
        ("<p>One <iframe src='x' /> two<svg><svg><text>a</text></svg><text>b</text></svg><p>Three", "One two Three"),
        ("<p>One<select><option>a<p>Two<svg><p>Three<svg>x</svg><p>Four", "One a Two Three Four"),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<object data=y><p>Fallback</p></object>", "Let x=2 be Fallback"),
        ("<p>One<script>a</scripts>b</script>c<p>Two<style>d", "Onec Two"),
        ("<p>One<svg><!-- </svg> -->x<script>'</svg>'</script>y</svg><p>Two", "One Two"),
    ],
)
def test_text_of_pages(page, expected):
    assert " ".join(text for _, text, _ in hb.blocks(page)) == expected
