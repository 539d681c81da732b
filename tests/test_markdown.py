from __future__ import annotations

import pytest

from docloom.functions.markdown import clean_text, sections_of, subheadings_of
from docloom.operators.chunks import build_chunks


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("---\ntitle: x\n---\nbody", "body"),
        ("---\nnever closed", ""),
        ("<Badges>\na\n</Badges>\nb", "b"),
        ("<Badges>\nopen to the end", ""),
        ("![alt](img.png)\ntext ![in](line)", "text ![in](line)"),
        ("<LanguageBlock global-id=\"ts\">\n\nkeep\n  \n</LanguageBlock>\nz", "keep\nz"),
        ("::tip\na\n::\nb", "> **tip:**\n> a\nb"),
        ("::WARNING[Important]\na\n::", "> **Important:**\n> a"),
        ('<BlockQuote type="info" label="Note">lost\nq\n</BlockQuote>', "> **Note:**\n> q"),
        ('<BlockQuote type="warning">\nq\n</BlockQuote>', "> **warning:**\n> q"),
        ("<BlockQuote label='x'>\nq", "<BlockQuote label='x'>\nq"),
        ("", ""),
    ],
)
def test_clean(text, want):
    assert clean_text(text) == want


def test_sections():
    got = sections_of("intro\n# T\nlost\n## A\nx\n```\n## no\n```\n### B\ny\n#### C\nz")
    assert [(s["level"], s["heading"]) for s in got] == [(0, ""), (1, "T"), (2, "A"), (3, "B")]
    assert got[2]["body"] == "x\n```\n## no\n```"
    assert got[3]["body"] == "y\n#### C\nz"
    assert subheadings_of("# no\n## a \n```\n## x\n```\n####   b\n##### no") == ["a", "b"]


def test_chunks(spark):
    block = "word " * 40
    files = [
        ("docs/v5_docs/api/hooks.md", "# Hooks\nlost\n## One\nbody\n```ts\ncode\n```\n### Sub\nmore"),
        ("docs/v6_docs/guides/basics/app.md", "one\n\ntwo"),
        ("docs/other/readme.md", "### early\nx\n## B\ny"),
        ("docs/v6_docs/big.md", "# Big\n" + "\n".join(f"## H{i}\n{block}" for i in range(4))),
        ("docs/v6_docs/one.md", "## only\n" + "word " * 200),
        ("docs/x.md", None),
    ]
    got = {(r.sourceFile, r.chunk_index): r for r in build_chunks(spark.createDataFrame(files, "path string, text string"), 150).collect()}
    hooks = got["docs/v5_docs/api/hooks.md", 0]
    assert (hooks.id, hooks.version, hooks.category, hooks.codeLanguages) == ("v5-hooks-0", "v5", "hooks", ["ts", "text"])
    assert hooks.rawContent == "## One\n\nbody\n```ts\ncode\n```\n\n### Sub\n\nmore"
    assert hooks.content.startswith("# Hooks\nBreadcrumb: Hooks\nCovers: One | Sub\n\n")
    app = got["docs/v6_docs/guides/basics/app.md", 0]
    assert (app.heading, app.category, app.rawContent) == ("app", "guides", "one\n\ntwo")
    assert got["docs/other/readme.md", 0].rawContent == "## B\n\ny"
    assert [got["docs/v6_docs/big.md", k].heading for k in (0, 1)] == ["Big (part 1)", "Big (part 2)"]
    assert got["docs/v6_docs/big.md", 1].breadcrumb == "Big > Big (part 2)"
    assert ("docs/v6_docs/one.md", 0) not in got and got["docs/v6_docs/one.md", 1].heading == "one (part 2)"
    assert got["docs/x.md", 0].rawContent == ""
    kept = build_chunks(spark.createDataFrame(files[:1], "path string, text string"), keep_intro=True).first()
    assert kept.rawContent.startswith("lost\n\n## One")
