import pytest

from sylvan.markup.markdown import to_markdown
from sylvan.markup.textfmt import char_count, formatted
from sylvan.markup.treebuilder import parse_document, parse_fragment


def md(html, **more):
    return to_markdown(parse_document(html).root, **more)


@pytest.mark.parametrize(
    ("html", "out"),
    [
        ("<h1>One</h1> <h3><span>IV.</span> Two (x)</h3><hr>", "# One\n\n### IV\\. Two \\(x\\)\n\n---"),
        ("<p>so <em>very</em>  <strong><i>odd</i></strong></p>", "so *very* ***odd***"),
        ("<p>a `b` and <code>c`d</code></p>", "a \\`b\\` and `c\\`d`"),
        ("<code>\n x\n</code>", "`x`"),
        ("<code>one\n two</code>", "```\none\n two\n```"),
        ("<h3>T</h3><ul><li>a</li><li><b>b</b></li></ul>", "### T\n\n- a\n- **b**"),
        ("<ol><li>a</li><div>c</div><li>b</li></ol>", "1. a\n\nc\n\n1. b"),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n\n    - b"),
        ("<ol><li><p>a</p><p>b</p></li><li><p>c</p></li></ol><p>d</p>", "1. a\n\n   b\n\n1. c\n\nd"),
        ("<p>see <a href='u' title='a \"t\"'>it <b>now</b></a>.</p>", 'see [it now](u "a \\"t\\"")\\.'),
        ("<p>see <a>it</a> <a href=x></a>.</p>", "see it \\."),
        ("<p>i <img src=s alt=a title=t><img alt=b></p>", 'i ![a](s "t")'),
        ("<div data-language='c++ x'><pre>a\n  b</pre></div>", "```c++\na\n  b\n```"),
        ("<pre><code class='k language-rs'>a</code></pre>", "```rs\na\n```"),
        ("<blockquote><p>a<br>b</p></blockquote><p>c</p>", "> a  \n> b\n\nc"),
        ("<blockquote></blockquote>", ""),
        ("<table><tr><th>Ä</th><th>b</th></tr><tr><td>1</td><td><i>2</i></td></tr></table>", "| Ä | b |\n| -- | - |\n| 1 | *2* |"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "|   |   |\n| - | - |\n| 1 | 2 |"),
        ("<table> <tr> <td>1</td> <td>2</td> </tr> <tr> <td>3</td> </tr> </table>", "1 2  \n3"),
        ("<table><tr></tr></table>", ""),
        ("<table><tr><td><ul><li>x</li><li>y</li></ul></td></tr></table>", "|   |\n| - |\n| + x<br>+ y<br> |"),
        ("<style>p{}</style><p>a<script>b</script></p>", "a"),
        ("<ul><li></li><li>a</li></ul>", "-\n- a"),
    ],
)
def test_markdown(html, out):
    assert md(html) == out


def test_skip_and_whole():
    assert to_markdown(parse_fragment("<style>p {}</style><div>x</div><p>y</p>").root, ["div"]) == "p \\{\\}\n\ny"
    body = parse_document("<h2>a</h2>").root.children[0].children[1]
    assert to_markdown(body, whole=True) == "\n\n## a\n\n"


@pytest.mark.parametrize(
    ("html", "out"),
    [
        ("<div>a<p>b  c</p>d</div>", "a\nb c\n\nd"),
        ("<ul><li>a</li><li>b</li></ul>c", "a\nb\n\n\nc"),
        ("<table><tr><th>a</th><td>b</td></tr><tr><td>c</td></tr></table>", "a b\nc"),
        ("x<br>y<hr>z", "x\ny\nz"),
        ("<pre>a\n   b</pre>", "a\n   b"),
        ("<b>a</b> <i> b</i>", "a b"),
    ],
)
def test_formatted_text(html, out):
    assert formatted(parse_document(html).root) == out


def test_counts():
    assert char_count(parse_document("<p> a  b<b>\n</b> c</p> ").root) == 5
    assert char_count(parse_document("").root) == 0
