"""Markdown as a table of lines: containers are islands of neighbouring lines, found by running aggregates.

Every line knows its quote depth, what it opens (heading, fence, list item, table, HTML, rule) and what stands around it; a line
that opens nothing belongs to what was opened last in its stretch between blank lines. Islands become blocks, in
the order of the text, under the path of headings above them. All of it is DataFrame functions; a document's lines meet
in one window, as its blocks are told apart by what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FENCE = r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,}) *(.*?) *$"
_ITEM = r"^( *)([-*+]|\d{1,9}[.)])(?: +|$)(.*)$"
_RULE = r"^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$"
_DELIMITER = r"^ {0,3}\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *$"
_HEADING = r"^ {0,3}(#{1,6})(?: +(.*?))?(?: +#+)? *$"
_IMAGE = r"!\[([^\]]*)\]\(\s*([^)\s]+)(?:\s+\"([^\"]*)\")?\s*\)"
#: Levels of headings and of lists.
LEVELS = 6
#: Lines of a list that are counted at a time.
PART = 64


def inline(text: Column) -> Column:
    """Plain text: marks, links, images and tags flattened; code spans as they are, in their backticks."""
    code = r"(`[^`]*`)|"
    plain = text
    for pattern, keep in (
        (r"!\[([^\]]*)\]\([^)]*\)", "$1$2"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1$2"),
        (r"(?<!\\)(\*\*|__|~~)(?=\S)(.+?)(?<!\\)\2", "$1$3"),
        (r"(?<!\\)\*(?=[^\s*])([^*]+)(?<!\\)\*", "$1$2"),
        (r"(?<![\w\\])_(?=[^\s_])([^_]+)(?<!\\)_(?!\w)", "$1$2"),
        (r"<[A-Za-z/!][^>]*>", "$1"),
        (r"\\([!-/:-@\[-`{-~])", "$1$2"),
    ):
        plain = F.regexp_replace(plain, code + pattern, keep)
    # every pattern needs one of these
    return F.when(text.rlike(r"[\[*_~<\\]"), plain).otherwise(text)


def _quoted(raw: Column) -> Column:
    """The quote marks at the start of a line."""
    return F.when(F.ltrim(raw).startswith(">"), F.regexp_extract(raw, r"^(?: {0,3}> ?)*", 0)).otherwise("")


def _unquoted(raw: Column, marks: Column) -> Column:
    return F.when(marks == "", raw).otherwise(F.substring(raw, F.length(marks) + 1, F.length(raw)))


def _spans(marks: Column) -> Column:
    """The fences (first and last line, quote depth) that the given lines with marks open and close. A fence is closed by a
    line of its own mark, as long at least; one that is never closed ends with its quote or the text."""
    closed = lambda spans: F.struct(*(F.lit(None).cast(k).alias(c) for c, k in (("pos", "int"), ("quote", "int"), ("kind", "string"), ("size", "int"))), spans.alias("spans"))
    with_span = lambda at, last: F.concat(at["spans"], F.array(F.struct(at["pos"].alias("first"), last.cast("int").alias("last"), at["quote"].alias("quote"))))
    opened = lambda m, spans: F.struct(m["pos"].alias("pos"), m["quote"].alias("quote"), m["kind"].alias("kind"), m["size"].alias("size"), spans.alias("spans"))

    def step(at: Column, m: Column) -> Column:
        ends = (m["kind"] == at["kind"]) & (m["size"] >= at["size"]) & (m["info"] == "")
        return (
            F.when(at["pos"].isNull(), opened(m, at["spans"]))
            .when(m["quote"] < at["quote"], opened(m, with_span(at, m["pos"] - 1)))
            .when((m["quote"] == at["quote"]) & ends, closed(with_span(at, m["pos"])))
            .otherwise(at)
        )

    rest = lambda at: F.when(at["pos"].isNull(), at["spans"]).otherwise(with_span(at, F.lit(2**31 - 1)))
    return F.aggregate(marks, closed(F.array().cast("array<struct<first:int,last:int,quote:int>>")), step, rest)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, raw and span (the fence around it, its own two lines included, or null) of each line.

    Fences are found in the text's own row, from the few lines with marks, and dealt to the lines as an array beside theirs:
    no line is joined or shuffled for them."""
    plain = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit("    "))
    rows = docs.select(key, F.split(plain, "\n").alias("lines"))
    near = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("raw"))), lambda s: s["raw"].contains("```") | s["raw"].contains("~~~"))
    near = F.transform(near, lambda s: F.struct(s["pos"], s["raw"], _quoted(s["raw"]).alias("marks")))
    near = F.transform(near, lambda s: F.struct(s["pos"], F.regexp_count(s["marks"], F.lit(">")).alias("quote"), _unquoted(s["raw"], s["marks"]).alias("line")))
    near = F.transform(near, lambda s: F.struct(s["pos"], s["quote"], F.regexp_extract(s["line"], _FENCE, 1).alias("mark"), F.regexp_extract(s["line"], _FENCE, 2).alias("info")))
    marks = F.transform(F.filter(near, lambda s: s["mark"] != ""), lambda s: F.struct(s["pos"], s["quote"], F.substring(s["mark"], 1, 1).alias("kind"), F.length(s["mark"]).alias("size"), s["info"]))
    rows = rows.withColumn("spans", _spans(marks))
    none = F.lit(None).cast("struct<first:int,last:int,quote:int>")
    gap = lambda s, i: s["first"] - F.coalesce(F.get("spans", i - 1)["last"] + 1, F.lit(0))
    held = lambda s: F.least(s["last"], F.size("lines") - 1) - s["first"] + 1
    around = F.flatten(F.transform("spans", lambda s, i: F.concat(F.array_repeat(none, gap(s, i)), F.array_repeat(s, held(s)))))
    rows = rows.select(key, F.posexplode(F.arrays_zip("lines", around.alias("span"))).alias("pos", "at"))
    return rows.select(key, "pos", F.col("at.lines").alias("raw"), F.col("at.span").alias("span"))


def _fenced(lines: DataFrame, key: str) -> DataFrame:
    """key, pos, quote (depth), line (without quote marks), fence: the line that opened the fence around it, or null; and
    last: the line that closes it. A line of a lower quote depth ends the fence."""
    rows = lines.withColumn("marks", _quoted(F.col("raw")))
    rows = rows.withColumn("quote", F.when(F.col("marks") == "", 0).otherwise(F.regexp_count("marks", F.lit(">"))))
    left = F.max(F.when(F.col("quote") < F.col("span.quote"), F.col("pos"))).over(Window.partitionBy(key).orderBy("pos"))
    rows = rows.withColumn("left", left)
    inside = F.col("span").isNotNull() & ~F.coalesce(F.col("left") >= F.col("span.first"), F.lit(False))
    # quote marks beyond the fence's own are part of what it holds
    marks = F.concat(F.lit("^(?: {0,3}> ?){"), F.col("span.quote").cast("string"), F.lit("}"))
    held = F.when(F.col("span.quote") == 0, F.col("raw")).otherwise(F.regexp_replace("raw", marks, F.lit("")))
    return rows.select(
        key,
        "pos",
        F.when(inside, F.col("span.quote")).otherwise(F.col("quote")).alias("quote"),
        F.when(inside, held).otherwise(_unquoted(F.col("raw"), F.col("marks"))).alias("line"),
        F.when(inside, F.col("span.first")).alias("fence"),
        F.when(inside, F.col("span.last")).alias("last"),
    )


def _islands(rows: DataFrame, key: str) -> DataFrame:
    """key, block, kind and the lines of each, in order. All windows are of one order, so that the lines are sorted once; what
    a line's text says is asked once, and only of lines whose first character leaves it open."""
    line = Window.partitionBy(key).orderBy("pos")
    text, free, c = F.col("line"), F.col("fence").isNull(), F.col("mark")
    sees = lambda marks, pattern: c.isin(*marks) & text.rlike(pattern)
    rows = rows.withColumn("mark", F.substring(F.ltrim("line"), 1, 1))
    rows = rows.withColumns({"blank": free & (c == ""), "indent": F.length("line") - F.length(F.ltrim("line")), "rule": sees("*-_", _RULE)})
    rows = rows.withColumns({"item": sees("-*+0123456789", _ITEM) & ~F.col("rule"), "delimiter": sees("|:-", _DELIMITER)})
    under = F.coalesce(F.lead("delimiter").over(line), F.lit(False))
    # stretches of lines without a blank one, of one quote depth, outside fences, begin at a cut
    cut = F.col("blank") | ~free | (F.lag("quote").over(line) != F.col("quote")) | F.lag("fence").over(line).isNotNull()
    rows = rows.withColumns({"cut": F.coalesce(cut, F.lit(True)), "table": under & text.contains("|") & ~F.col("item"), "gap": F.coalesce(F.lag("blank").over(line), F.lit(True))})
    # blank lines go, what they part is known by then
    rows = rows.where(~F.col("blank")).withColumn("first", F.col("cut") | F.col("gap"))
    html = F.col("first") & sees("<", r"^ {0,3}<(?:[A-Za-z/!?])")
    opens = (
        F.when(~free, "fence")
        .when(sees("#", _HEADING), "heading")
        .when(F.col("item"), "list")
        .when(F.col("table"), "table")
        .when(F.col("rule") & (F.col("first") | ~text.rlike("^ {0,3}-+ *$")), "rule")
        .when(html, "html")
    )
    rows = rows.withColumn("opens", opens)
    # a list goes on over blank lines while what follows is set in; anything else at the margin ends it
    margin = F.when(F.col("opens") == "list", 1).when(F.col("opens").isNotNull() & (F.col("indent") < 2), 0).when(F.col("first") & (F.col("indent") < 2), 0)
    # what was opened last in the stretch
    last = F.when(F.col("opens").isin("list", "table", "html", "heading", "rule"), F.col("opens")).when(F.col("first"), "")
    rows = rows.withColumns({"listed": F.coalesce(F.last(margin, True).over(line), F.lit(0)) == 1, "opened": F.last(last, True).over(line)})
    loose = F.when(F.col("listed"), "list").when(F.col("opened").isin("table", "html"), F.col("opened")).when((F.col("indent") >= 4) & F.col("first"), "indented").otherwise("paragraph")
    rows = rows.withColumn("kind", F.coalesce("opens", loose))
    # set-in code goes on line by line, unless a blank one is before it
    rows = rows.withColumn("head", F.last(F.when(F.col("cut"), F.col("kind")).when(F.col("first"), ""), True).over(line))
    shown = rows.withColumn("kind", F.when((F.col("kind") == "paragraph") & (F.col("indent") >= 4) & (F.col("head") == "indented"), "indented").otherwise(F.col("kind")))
    shown = shown.withColumn("line_below", (F.col("kind") == "paragraph") & ~F.col("first") & sees("=-", r"^ {0,3}(?:=+|-+) *$"))
    before = lambda c, n=1: F.lag(c, n).over(line)
    joins = F.col("kind").isin("list", "indented", "fence") | ~F.col("first")
    # a line of = or - ends the paragraph that it stands below
    below = before("line_below") & (before("kind", 2) == "paragraph")
    same = (before("kind") == F.col("kind")) & (before("quote") == F.col("quote")) & before("fence").eqNullSafe(F.col("fence")) & joins & ~F.col("kind").isin("heading", "rule") & ~below
    shown = shown.withColumn("same", F.coalesce(same, F.lit(False)))
    shown = shown.withColumn("block", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(line))
    return shown.select(key, "block", "kind", "pos", "line", "indent", "last")


def _listed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with listed: the lines of lists as they are shown, two blanks a level, a dash, or numbers that go on from the
    first of their level; null for other blocks. Lines are counted ``PART`` at a time, so that long lists are not copied for each."""
    inside = F.col("kind") == "list"
    read = lambda x: F.struct(x["indent"].alias("indent"), F.regexp_extract(x["line"], _ITEM, 2).alias("mark"), F.regexp_extract(x["line"], _ITEM, 3).alias("rest"), x["line"].alias("line"))
    blocks = blocks.withColumn("items", F.when(inside, F.transform("ls", read)))
    blocks = blocks.withColumn("indents", F.when(inside, F.sort_array(F.array_distinct(F.transform(F.filter("items", lambda x: x["mark"] != ""), lambda x: x["indent"])))))

    def placed(x: Column) -> Column:
        level = F.least(F.lit(LEVELS - 1), F.array_position("indents", x["indent"]).cast("int") - 1)
        first = F.when(x["mark"].rlike(r"^\d"), F.regexp_extract(x["mark"], r"^\d+", 0).cast("int"))
        return F.struct(F.when(x["mark"] != "", level).alias("level"), first.alias("first"), F.when(x["mark"] != "", x["rest"]).otherwise(F.trim(x["line"])).alias("text"))

    blocks = blocks.withColumn("items", F.when(inside, F.transform("items", placed)))
    state = lambda level, counts, starts, out: F.struct(level.alias("level"), counts.alias("counts"), starts.alias("starts"), out.alias("out"))

    def step(at: Column, x: Column) -> Column:
        # items of a level belong together until one of a higher level comes
        level = x["level"]
        counts = F.transform(at["counts"], lambda n, k: F.when(k < level, n).when(k == level, n + 1).otherwise(0))
        starts = F.transform(at["starts"], lambda n, k: F.when(k < level, n).when(k == level, F.coalesce(n, x["first"])))
        number = F.coalesce(F.get(at["starts"], level), x["first"]) + F.get(at["counts"], level)
        shown = lambda level, number: F.concat(at["out"], F.array(F.struct(level.alias("level"), number.alias("number"))))
        return F.when(level.isNull(), state(at["level"], at["counts"], at["starts"], shown(at["level"], F.lit(None).cast("int")))).otherwise(state(level, counts, starts, shown(level, number)))

    none = F.array().cast("array<struct<level:int,number:int>>")
    start = state(F.lit(0), F.array_repeat(F.lit(0), LEVELS), F.array_repeat(F.lit(None).cast("int"), LEVELS), none)
    again = lambda at: state(at["level"], at["counts"], at["starts"], none)
    part = lambda done, k: F.concat(done, F.array(F.aggregate(F.slice("items", k * PART + 1, PART), again(F.element_at(done, -1)), step)))
    parts = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / PART).cast("int")), F.array(start), part)
    blocks = blocks.withColumn("places", F.when(inside, F.flatten(F.transform(parts, lambda p: p["out"]))))
    bullet = lambda x, at: F.when(x["level"].isNull(), "  ").when(x["first"].isNotNull(), F.concat(at["number"].cast("string"), F.lit(". "))).otherwise("- ")
    shown = F.zip_with("items", "places", lambda x, at: F.concat(F.repeat(F.lit("  "), at["level"]), bullet(x, at), inline(x["text"])))
    return blocks.withColumn("listed", F.when(inside, shown))


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, heading (path joined by ' > '), kind (prose, code, image), language, text, url of the blocks of Markdown
    texts: fences and set-in code, lists, tables (cells joined by ' | '), quotes (their content), HTML without tags, paragraphs
    with line ends kept, and the images of paragraphs behind them.

    Null and blank texts have no blocks; fences that are not closed run to the end. Known departures from a full grammar: code
    inside list items stays lines of the list, lazy lines of quotes end them, references to links are not resolved."""
    rows = _islands(_fenced(_lines(docs, key, text), key), key)
    blocks = rows.groupBy(key, "block", "kind").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "indent"))).alias("ls"), F.max("last").alias("last"))
    blocks = _listed(blocks)
    lines = F.col("ls.line")
    n = F.size("ls")
    body = F.slice("ls", 2, F.greatest(n - F.when(F.element_at("ls", -1)["pos"] == F.col("last"), 2).otherwise(1), F.lit(0)))["line"]
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\n+", ""), r"\s+$", "")
    info = F.regexp_extract(F.element_at(lines, 1), _FENCE, 2)
    cells = F.transform(F.filter(lines, lambda x, i: i != 1), lambda x: F.array_join(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(inline(c))), " | "))
    blocks = blocks.withColumn("joined", F.when(F.col("kind").isin("paragraph", "html"), F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n")))
    joined = F.col("joined")
    # a line of = or - below a paragraph makes it a heading
    under = F.regexp_extract(F.element_at(lines, -1), r"^ {0,3}(=+|-+) *$", 1)
    setext = (F.col("kind") == "paragraph") & (n > 1) & (under != "")
    title = F.when(F.col("kind") == "heading", F.regexp_extract(F.element_at(lines, 1), _HEADING, 2)).when(setext, F.array_join(F.transform(F.slice("ls", 1, F.greatest(n - 1, F.lit(0)))["line"], lambda x: F.trim(x)), "\n"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(F.element_at(lines, 1), _HEADING, 1))).when(setext, F.when(under.startswith("="), 1).otherwise(2))
    shown = (
        F.when(F.col("kind") == "fence", strip(F.array_join(body, "\n")))
        .when(F.col("kind") == "indented", strip(F.array_join(F.transform(lines, lambda x: F.substring(x, F.lit(5), F.length(x))), "\n")))
        .when(F.col("kind") == "table", F.array_join(cells, "\n"))
        .when(F.col("kind") == "list", F.array_join(F.transform("listed", lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"))
        .when(F.col("kind") == "html", F.trim(F.regexp_replace(F.regexp_replace(joined, "<[^>]+>", " "), r"\s+", " ")))
        .when(F.col("kind") == "paragraph", F.trim(inline(joined)))
    )
    code = F.col("kind").isin("fence", "indented")
    images = F.when((F.col("kind") == "paragraph") & ~setext, F.regexp_extract_all(joined, F.lit(_IMAGE), F.lit(0)))
    out = blocks.select(
        key,
        "block",
        F.when(code, "code").otherwise("prose").alias("kind"),
        F.when(F.col("kind") == "fence", F.lower(F.regexp_extract(info, r"^[^\s{,]*", 0))).otherwise("").alias("language"),
        F.when(level.isNull(), shown).alias("text"),
        level.alias("level"),
        F.trim(inline(title)).alias("title"),
        F.coalesce(images, F.array().cast("array<string>")).alias("images"),
    )
    above = Window.partitionBy(key).orderBy("block")
    named = (F.col("level") >= 1) & (F.col("title") != "")
    path = []
    for k in range(1, LEVELS + 1):
        own = F.max(F.when(named & (F.col("level") == k), F.struct("block", "title"))).over(above)
        ended = F.max(F.when(named & (F.col("level") < k), F.col("block"))).over(above)
        path.append(F.when(ended.isNull() | (own["block"] > ended), own["title"]))
    out = out.withColumn("heading", F.substring(F.array_join(F.filter(F.array(*path), lambda p: p.isNotNull()), " > "), 1, 1000)).where("level is null")
    image = lambda x: F.struct(F.lit("image").alias("kind"), F.lit("").alias("language"), F.concat(F.lit("[Image: "), F.coalesce(F.nullif(F.trim(F.regexp_extract(x, _IMAGE, 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(x, _IMAGE, 3)), F.lit("")), F.substring_index(F.regexp_extract(x, _IMAGE, 2), "/", -1)), F.lit("] ("), F.regexp_extract(x, _IMAGE, 2), F.lit(")")).alias("text"), F.regexp_extract(x, _IMAGE, 2).alias("url"))
    whole = F.array(F.struct("kind", "language", "text", F.lit("").alias("url")))
    kept = F.filter(F.concat(whole, F.transform("images", image)), lambda b: F.trim(F.coalesce(b["text"], F.lit(""))) != "")
    out = out.select(key, "block", "heading", kept.alias("bs"))
    # a block's images follow it, so its numbers begin where those of the blocks above end
    out = out.withColumn("from", F.sum(F.size("bs")).over(above) - F.size("bs"))
    every = out.select(key, "heading", "from", F.posexplode("bs").alias("at", "b"))
    return every.select(key, (F.col("from") + F.col("at")).cast("int").alias("ordinal"), "heading", "b.*")
