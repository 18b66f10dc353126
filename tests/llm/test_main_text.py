"""Reading of pages with broken or hostile markup."""

import time

import pytest

from curbflow.llm import main_text

BIG = {
    "unclosed tag": "<p>good text</p><a " + 'x="y" ' * 160_000,
    "no end at all": "<a " * 330_000,
    "all ends in quotes": '<a b="> ="' * 100_000,
    "other quotes inside": "<a b='> =\"" * 100_000,
    "declarations": "<!" * 500_000,
    "quotes": "=\"'" * 300_000 + ">",
    "blanks": ("<a b=" + " " * 50) * 18_000,
    "scripts": "<script" * 140_000,
}
DEEP = {
    "end tags of nothing": "<b>" * 50_000 + "</i>" * 50_000,
    "deep boxes": "<div>x" * 50_000,
    "headings under a paragraph": "<p><body>" + "<h1>x" * 50_000,
    "paragraphs in a button": "<button>" + "<b>" * 50_000 + "<p>x" * 50_000 + "</button>",
}


@pytest.mark.parametrize("name", [*BIG, *DEEP])
def test_time_is_linear(name):
    page = (BIG | DEEP)[name]
    began = time.process_time()
    main_text.blocks(page[: len(page) // 4])
    quarter = time.process_time() - began
    began = time.process_time()
    main_text.blocks(page)
    whole = time.process_time() - began
    assert whole < 12 * quarter + 0.5 and whole < 6


def test_attribute_values_of_any_length():
    assert [b.text for b in main_text.blocks(f'<p data-x="{"a" * 5000} > leak">text</p>')] == ["text"]


def test_truncated_tag_ends_the_page():
    for tail in ("<a ", '<a href="x', "<a href='x y", "<!-- no end", "<script>let a = 1", "</p"):
        assert [b.text for b in main_text.blocks(f"<p>good text{tail}")] == ["good text"]


def test_nothing_comes_into_words():
    for inside in ("<script>1</script>", "<noscript>no</noscript>", "<!-- c -->", "<?php x ?>", "<wbr>", "<b></b>", "<!x>", "<style>b{}</style>"):
        assert [b.text for b in main_text.blocks(f"foo{inside}bar")] == ["foobar"]
    assert [b.text for b in main_text.blocks("foo<br>bar 1 < 2 <3")] == ["foo bar 1 < 2 <3"]


def test_paths_hold_the_nearest_elements():
    block = main_text.blocks("<html>" + "<div>" * 20 + '<section class="a b"><i>x')[0]
    assert len(block.path) == main_text.DEPTH and block.path[-1] == ("section", ("a", "b"))
