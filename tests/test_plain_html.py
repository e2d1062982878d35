import random
import re

from docloom.sources import html

TAGS = "p table tr td th b i a ul li ol div br h2 body html head caption tbody option form em pre span nobr dl dt dd select button template".split()
PIECES = [f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS] + ['<a href="x y">', '<a href="">', '<p id="1" id="2">', "text", " ", "\n", "&amp;", "&copy", "&lt;b", "a&b=1", "é", "\0"]
OTHER = ["<", "< b>", "<br/>", "<script>x<y</script>", "<style>p</style>", "<svg>", "</svg>", "<title>t</title>", "<!-- c -->", '<img src="a&amp;b">', "<img alt=z>", "<textarea>", "<math>", "<frameset>"]


def test_plain_texts_are_read_as_by_the_general_tokenizer(monkeypatch):
    rng, never = random.Random(3), re.compile(r"(?!)")
    texts = ["".join(rng.choice(PIECES if k % 2 else PIECES + OTHER) for _ in range(rng.randint(0, 14))) for k in range(4000)]
    found = [(html.blocks(t), html.blocks(t, strip=False), list(html.nodes(t))) for t in texts]
    monkeypatch.setattr(html, "_PLAIN", never)
    assert found == [(html.blocks(t), html.blocks(t, strip=False), list(html.nodes(t))) for t in texts]


def test_plain_texts_need_no_general_tokenizer(monkeypatch):
    steps = []
    whole = html.HTMLParser.goahead
    monkeypatch.setattr(html.HTMLParser, "goahead", lambda self, end: steps.append(len(self.rawdata)) or whole(self, end))
    html.blocks('<table><tr><td>a &amp; b<td><a href="x">c</a></table>')
    assert not any(steps)
    html.blocks("<table><!-- c --></table>")
    assert any(steps)
