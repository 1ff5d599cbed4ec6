"""op6: a head without an end tag ends where something starts that can't stand in it."""

from __future__ import annotations

import pytest

from guestsignal.llm import pages


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><meta charset=x><body><p>One<p>Two</body></html>",
    "<html><head><title>T</title><style>p {}</style><p>One</p><p>Two",
    "<head>\n<title>T</title>\n<a href=x>One</a><p>Two",
    "<head><title>T</title><!-- c -->One<p>Two",
    "<head><script>var a</script><noscript><p>no</p></noscript><template>no</template><body>One<p>Two",
    "<head><noframes><p>no</p></noframes><title>T</title></head><body>One<p>Two",
])
def test_text_after_an_open_head(page):
    assert [b.text for b in pages.blocks(page)] == ["One", "Two"]
    assert not any(tag == "head" for b in pages.blocks(page) for tag, _ in b.path)
