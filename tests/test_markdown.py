import pytest

from millrace.operators import markdown

TEXT = """# Top

text *with* `co*de*` and
a [link](http://x) <b>bold</b>

```py {x}
x = 1

# no heading
```
| a | **b** |
|---|:-:|
| 1 | 2 \\| 3 |

![alt](i.png "t") said ![](d/e.png)

Sub
---
* one
more of one
* two
   + deep
   + deeper

  still two

    indented

plain
> quoted _text_
> > ~~deep~~
> ```
> q = 1
outside

3. c
7. d
### Third ###
~~~
```
~~~
<div class="x">
<p>Html &amp; more</p>
</div>

***
##
last
```
open"""
WANT = [
    ("Top", "prose", "", "text with `co*de*` and\na link bold"),
    ("Top", "code", "py", "x = 1\n\n# no heading"),
    ("Top", "prose", "", "a | b\n1 | 2 | 3"),
    ("Top", "prose", "", "alt said"),
    ("Top", "image", "", "[Image: alt] (i.png)"),
    ("Top", "image", "", "[Image: e.png] (d/e.png)"),
    ("Top > Sub", "prose", "", "- one\n  more of one\n- two\n  - deep\n  - deeper\n    still two\n    indented"),
    ("Top > Sub", "prose", "", "plain"),
    ("Top > Sub", "prose", "", "quoted text"),
    ("Top > Sub", "prose", "", "deep"),
    ("Top > Sub", "code", "", "q = 1"),
    ("Top > Sub", "prose", "", "outside"),
    ("Top > Sub", "prose", "", "3. c\n4. d"),
    ("Top > Sub > Third", "code", "", "```"),
    ("Top > Sub > Third", "prose", "", "Html &amp; more"),
    ("Top > Sub > Third", "prose", "", "last"),
    ("Top > Sub > Third", "code", "", "open"),
]


def blocks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, md string")
    out = {}
    for r in markdown.markdown_blocks(df, "id", "md").orderBy("id", "ordinal").collect():
        out.setdefault(r.id, []).append((r.heading, r.kind, r.language, r.text))
    return [out.get(i, []) for i in range(len(texts))]


def test_blocks_of_a_text(spark):
    crlf = TEXT.replace("\n", "\r\n")
    plain, other, none, blank = blocks(spark, [TEXT, crlf, None, " \n\n"])
    assert plain == WANT
    assert other == WANT and none == blank == []


@pytest.fixture(scope="module")
def cases():
    return {
        "# A\n\nx\n\n## B\n\ny\n\n# C\nz": [("A", "prose", "", "x"), ("A > B", "prose", "", "y"), ("C", "prose", "", "z")],
        "### deep\na\n## up\nb": [("deep", "prose", "", "a"), ("up", "prose", "", "b")],
        "one\ntwo\n===\nthree": [("one\ntwo", "prose", "", "three")],
        "    a\n\n      b\n\nc": [("", "code", "", "a\n  b"), ("", "prose", "", "c")],
        "p\n    not code": [("", "prose", "", "p\nnot code")],
        "- a\n\n- b\n\nend": [("", "prose", "", "- a\n- b"), ("", "prose", "", "end")],
        "1) x\n   1) y\n   1) z\n2) w": [("", "prose", "", "1. x\n  1. y\n  2. z\n2. w")],
        "a | b\nno table": [("", "prose", "", "a | b\nno table")],
        "~~~js\n```\nx\n~~~~\n````": [("", "code", "js", "```\nx")],
        "`<b>` and \\*stars\\* and <i>x</i>": [("", "prose", "", "`<b>` and *stars* and x")],
        "snake_case_name and __strong__": [("", "prose", "", "snake_case_name and strong")],
        "text\n***\nmore": [("", "prose", "", "text"), ("", "prose", "", "more")],
        "```\n> x\n> ```\n```\ny": [("", "code", "", "> x\n> ```"), ("", "prose", "", "y")],
        "> ```\n> a\nout\n> in": [("", "code", "", "a"), ("", "prose", "", "out"), ("", "prose", "", "in")],
        "> a\nb": [("", "prose", "", "a"), ("", "prose", "", "b")],
        "#no heading\n####### nor this": [("", "prose", "", "#no heading\n####### nor this")],
    }


def test_cases(spark, cases):
    for text, got in zip(cases, blocks(spark, list(cases))):
        assert got == cases[text], text


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "id int, md string")
    plan = markdown.markdown_blocks(df, "id", "md")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
