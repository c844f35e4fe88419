"""What the names of elements may condemn."""

import pytest

from tallyspark.llm.site_tree import main_text

STORY = "A story that is told at some length, so that it is most of the page."


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="no-sidebar"><p>{STORY}</p></body>',
        f'<body class="sidebar-left"><p>{STORY}</p></body>',
        f'<body><div class="content has-sidebar"><p>{STORY}</p></div><div class="sidebar">Links</div></body>',
        f'<body><main class="with-comments"><p>{STORY}</p></main></body>',
        f'<body><article class="post tags-news"><p>{STORY}</p></article></body>',
        f'<body><div id="header-and-share"><article><p>{STORY}</p></article></div></body>',
        f'<body><main><article class="post tags-news"><p>{STORY}</p><div class="comments">Nice, all of it, and more than that, the whole of it!</div></article></main></body>',
        f'<body><main><p>{STORY}</p><article>Teaser</article></main><article>Other</article></body>',
        f'<body><article><p>{STORY}</p></article><div class="related"><article>Teaser</article></div></body>',
        f'<body><form><p>{STORY}</p></form></body>',
    ],
)
def test_no_name_empties_a_page(page):
    assert STORY in main_text(page).split("\n\n")
    assert not any(x in main_text(page) for x in ("Links", "Nice", "Other"))


def test_names_still_cut_parts():
    assert main_text(f'<body><article><p>{STORY}</p></article><div class="related"><article>Teaser</article></div></body>') == STORY
    assert main_text(f'<body><div class="ad">Buy</div><p>{STORY}</p><div class="sidebar">Links</div></body>') == STORY
