"""The lines of Markdown texts are read, sorted and shuffled once, however their blocks are told apart."""

import re

from millrace.operators import markdown
from millrace.plans import reports  # noqa: F401
from millrace.plans.registry import QUERIES

MARKED = "a\n> ```x\n> in\nout\n\n```\nb\n```\n~~~ py\nc"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_made_once_and_joined_with_nothing(spark):
    steps = plan(markdown.markdown_blocks(spark.createDataFrame([(1, MARKED)], "id int, md string"), "id", "md"))
    assert "Join" not in steps and "Union" not in steps
    # one for lines, one for a block's images
    assert len(re.findall("Generate posexplode", steps)) == 2
    assert len(re.findall("Exchange hashpartitioning", steps)) == 1


def test_the_query_reads_its_texts_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One, two.\n\nthree\r\n??\nfour"), (2, None), (3, "é – ü"), (4, "é")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["markdown_blocks"](spark, str(tmp_path))
    assert len(re.findall("FileScan|Scan parquet", plan(df))) == 1
    assert len(re.findall("Exchange hashpartitioning", plan(df))) == 1
    got = [(r.doc_id, r.ordinal, r.heading, r.text) for r in df.orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 0, "part 0", "One two\nOne two"), (1, 1, "part 0 > s2", "# three\n\n*x*"), (1, 2, "part 0 > s4", "four\nfour")]


def test_fences_of_a_text_without_key(spark):
    df = spark.createDataFrame([(None, MARKED), (2, MARKED)], "id int, md string")
    got = {}
    for r in markdown.markdown_blocks(df, "id", "md").orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append((r.kind, r.language, r.text))
    want = [("prose", "", "a"), ("code", "x", "in"), ("prose", "", "out"), ("code", "", "b"), ("code", "py", "c")]
    assert got == {None: want, 2: want}


def test_long_lists_go_on_over_their_parts(spark):
    n = 3 * markdown.PART + 5
    text = "\n".join(f"{7 if i == 0 else 1}. x{i}\n   - y\n     more" for i in range(n))
    (got,) = markdown.markdown_blocks(spark.createDataFrame([(1, text)], "id int, md string"), "id", "md").collect()
    assert got.text == "\n".join(f"{7 + i}. x{i}\n  - y\n    more" for i in range(n))
