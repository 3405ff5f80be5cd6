"""HTML into blocks, page metadata, links, image rules, code languages."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "track", "wbr"}
_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "head"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "dd", "dt", "dl", "address", "details", "summary"}
_CODE_CLASS = re.compile(r"(?:^|\s)(?:language-|lang-|highlight-source-|brush:\s*)([A-Za-z0-9+#_.-]+)")


class Node:
    """An element with its children; text is a plain string among them."""

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag == "br":
                out.append("\n")
            elif x.tag not in _SKIP:
                todo += reversed(x.children)
        return "".join(out)

    def all(self, *tags: str) -> list[Node]:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.tag in tags:
                    out.append(x)
                todo += reversed(x.children)
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("li", "p", "tr", "td", "th", "dt", "dd") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def render_table(node: Node) -> str:
    rows = [[_flat(c.text()) for c in r.all("td", "th")] for r in node.all("tr")]
    return "\n".join(" | ".join(r) for r in rows if r)


def render_list(node: Node, depth: int = 0) -> str:
    lines, n = [], 0
    for item in (c for c in node.children if isinstance(c, Node) and c.tag == "li"):
        n += 1
        own = Node("li", {})
        own.children = [c for c in item.children if not (isinstance(c, Node) and c.tag in ("ul", "ol"))]
        lines.append("  " * depth + (f"{n}. " if node.tag == "ol" else "- ") + _flat(own.text()))
        lines += [r for c in item.children if isinstance(c, Node) and c.tag in ("ul", "ol") if (r := render_list(c, depth + 1))]
    return "\n".join(lines)


def code_language(node: Node) -> str:
    for n in [node, *node.all("code")]:
        if n.attrs.get("data-lang"):
            return n.attrs["data-lang"].lower()
        if m := _CODE_CLASS.search(n.attrs.get("class", "")):
            return m[1].lower()
    return ""


def main_content(root: Node) -> Node:
    for n in root.all("main", "article"):
        return n
    todo = [root]
    while todo:
        n = todo.pop(0)
        if n.attrs.get("role") == "main":
            return n
        todo += [c for c in n.children if isinstance(c, Node)]
    return next(iter(root.all("body")), root)


def html_blocks(html: str, content: bool = True) -> list[dict]:
    """Blocks of a page in order: heading (path joined by ' > '), kind, language, text, url of images, and image: what the page
    says of an image, as it stands there."""
    root = tree(html)
    path: list[tuple[int, str]] = []
    out: list[dict] = []
    inline: list = []

    def add(kind: str, text: str, language: str = "", url: str = "", image: dict | None = None) -> None:
        if text.strip() or image:
            out.append({"heading": " > ".join(t for _, t in path)[-1000:], "kind": kind, "language": language, "text": text, "url": url, "image": image})

    def flush() -> None:
        if inline:
            n = Node("span", {})
            n.children = list(inline)
            inline.clear()
            add("prose", _flat(n.text()))

    def visit(node: Node, above: tuple[Node, ...] = ()) -> None:
        above += (node,)
        for c in node.children:
            if isinstance(c, str):
                inline.append(c)
            elif c.tag in _SKIP:
                continue
            elif re.fullmatch("h[1-6]", c.tag):
                flush()
                level = int(c.tag[1])
                while path and path[-1][0] >= level:
                    path.pop()
                if _flat(c.text()):
                    path.append((level, _flat(c.text())))
            elif c.tag == "pre":
                flush()
                add("code", c.text().strip("\n"), code_language(c))
            elif c.tag == "table":
                flush()
                add("prose", render_table(c))
            elif c.tag in ("ul", "ol"):
                flush()
                add("prose", render_list(c))
            elif c.tag == "img":
                flush()
                add("image", image_line(c.attrs), url=best_source(c.attrs), image=image_of(c, above))
            elif len(above) <= 200 and (c.tag in _BLOCK or c.tag in ("body", "html", "blockquote") or c.all("p", "div", "pre", "table", "ul", "ol", "img", "h1", "h2", "h3", "h4", "h5", "h6")):
                flush()
                visit(c, above)
                flush()
            else:
                inline.append(c)

    visit(main_content(root) if content else root)
    flush()
    return out


def image_of(node: Node, above: tuple[Node, ...]) -> dict:
    """An image's own words and those of what it stands in; nothing is chosen, resolved or judged here."""
    own, parent = node.attrs, above[-1]
    sources = [n.attrs["srcset"] for n in parent.all("source") if n.attrs.get("srcset")] if parent.tag == "picture" else []
    figure = next((n for n in reversed(above) if n.tag == "figure"), None)
    caption = next((_flat(n.text()) for n in figure.all("figcaption")), "") if figure else ""
    marks = [own.get("class", ""), own.get("id", ""), own.get("role", "")]
    for n in reversed(above):
        if sum(map(len, marks)) >= 400:
            break
        marks += [n.attrs.get("class", ""), n.attrs.get("id", "")]
        if n.tag == "body":
            break
    return {
        **{k: own.get(k, "") for k in ("src", "title", "width", "height")},
        "srcset": own.get("srcset", "").strip() or next(iter(sources), ""),
        "data_src": own.get("data-src", ""),
        "link": parent.attrs.get("href", "") if parent.tag == "a" else "",
        "alt": own["alt"].strip() if "alt" in own else None,
        "caption": caption or None,
        "hints": " ".join(" ".join(marks).lower().split()),
        "decorative": own.get("role") in ("presentation", "none") or own.get("aria-hidden") == "true",
    }


def best_source(attrs: dict[str, str]) -> str:
    """The widest candidate of srcset, else src."""
    best = (0.0, attrs.get("src", ""))
    for part in attrs.get("srcset", "").split(","):
        bits = part.split()
        if bits:
            size = float(m[1]) if len(bits) > 1 and (m := re.fullmatch(r"([0-9.]+)[wx]", bits[1])) else 1.0
            if size > best[0]:
                best = (size, bits[0])
    return best[1]


def image_line(attrs: dict[str, str], caption: str = "") -> str:
    url = best_source(attrs)
    label = attrs.get("alt", "").strip() or attrs.get("title", "").strip() or url.rsplit("/", 1)[-1]
    return f"[Image: {label}{f' — {caption}' if caption else ''}] ({url})" if url else ""


#: Words in names and parts of addresses of images that say nothing about the content.
NAME_HINTS = (
    "icon", "logo", "avatar", "emoji", "badge", "sprite", "spinner", "loader", "favicon", "social", "share", "button", "arrow",
    "pixel", "tracking", "gravatar", "banner-ad", "advert",
)
BAD_HOSTS = (
    "img.shields.io", "badgen.net", "badge.fury.io", "travis-ci.", "circleci.com/gh", "codecov.io", "coveralls.io",
    "gravatar.com", "doubleclick.net", "google-analytics.com", "googletagmanager.com", "facebook.com/tr", "pixel.",
    "bat.bing.com", "scorecardresearch.com",
)
#: Characters below which an image inside the address is tiny; words from which an alternative text describes.
TINY_DATA, DESCRIBED = 2048, 4


def image_anchor(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, url, anchor_ordinal: the first chunk that shows the image's address in brackets, else the last chunk
    under its heading."""
    met = images.select("document_id", "url", "heading").join(chunks.select("document_id", "ordinal", F.col("heading").alias("own"), "content"), "document_id", "left")
    shown = F.min(F.when(F.col("content").contains(F.concat(F.lit("("), F.col("url"), F.lit(")"))), F.col("ordinal")))
    under = F.max(F.when(F.col("own").eqNullSafe(F.col("heading")), F.col("ordinal")))
    return met.groupBy("document_id", "url", "heading").agg(F.coalesce(shown, under).alias("anchor_ordinal")).drop("heading")


def usable_image(size: Column, width: Column, height: Column, mime: Column) -> Column:
    """After download: not too small, not too long, no drawing."""
    short, long = F.least(width, height), F.greatest(width, height)
    return (size >= 5 * 1024) & (short >= 128) & (long <= 8 * short) & ~mime.contains("svg")


def body_text(blocks: list[dict]) -> str:
    """Blocks as one text, code between fences, a blank line between them; where the path of headings changes its last one
    stands on the line above."""
    out, shown = [], ""
    for b in blocks:
        if not b["text"].strip():
            continue
        lead = b["heading"].split(" > ")[-1] + "\n" if b["heading"] and b["heading"] != shown else ""
        shown = b["heading"] if lead else shown
        out.append(lead + (f"```{b.get('language') or ''}\n{b['text']}\n```" if b["kind"] == "code" else b["text"]))
    return "\n\n".join(out)


def normal_text(s: str) -> str:
    return unicodedata.normalize("NFC", s.replace("\r\n", "\n").replace("\r", "\n"))


def page_metadata(html: str, url: str = "") -> dict:
    root = tree(html)
    metas = {(m.attrs.get("name") or m.attrs.get("property") or "").lower(): m.attrs.get("content", "") for m in root.all("meta")}
    first = lambda *tags: next((_flat(n.text()) for n in root.all(*tags)), None)
    title = next((_flat("".join(c for c in n.children if isinstance(c, str))) for n in root.all("title")), None)
    return {
        "title": title or first("h1"),
        "lang": next((n.attrs["lang"] for n in root.all("html") if n.attrs.get("lang")), None),
        "description": metas.get("description"),
        "author": metas.get("author"),
        "open_graph": {k[3:]: v for k, v in metas.items() if k.startswith("og:")},
        "headings": [_flat(n.text()) for n in root.all("h1", "h2", "h3")],
        "canonical": next((urljoin(url, n.attrs["href"]) for n in root.all("link") if n.attrs.get("rel", "").lower() == "canonical" and n.attrs.get("href")), None),
        "links": [urljoin(url, a.attrs["href"]) for a in root.all("a") if a.attrs.get("href")],
        "scripts": len(root.all("script")),
        "characters": len(_flat(main_content(root).text())),
    }


#: Space characters (class Zs).
_SPACES = " \u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def listed_title(html: Column) -> Column:
    """Title of raw HTML as lists of pages show it: the text of the first bare title element with white space folded and
    spaces cut at both ends, empty without one. Of references only those to <, >, " and & are read, as they were escaped; a cut
    one stays, but for &amp."""
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"')):
        title = F.replace(title, F.lit(f"&{name};"), F.lit(c))
    return F.btrim(F.regexp_replace(F.regexp_replace(title, "&amp;?", "&"), r"[\t\n\f\r ]+", " "), F.lit(_SPACES))


def html_lang(html: Column) -> Column:
    """Language that the first html element with one names, else null."""
    return F.nullif(F.regexp_extract(html, r'(?i)<html[^>]*[\t\n\f\r ]lang="([^"]*)"', 1), F.lit(""))


def is_script_shell(characters: Column, scripts: Column) -> Column:
    """A page with next to no text and several scripts is worth a browser."""
    return (characters < 100) & (scripts > 3)


_IMAGE = ("src", "srcset", "data_src", "link", "alt", "title", "caption", "width", "height", "hints")
_IMAGE_STRUCT = pa.struct([*((n, pa.string()) for n in _IMAGE), ("decorative", pa.bool_())])
_BLOCK_STRUCT = pa.struct([*((n, pa.string()) for n in ("heading", "kind", "language", "text", "url")), ("image", _IMAGE_STRUCT)])


#: Pages that are held as Python objects at once.
PARSED = 100


def parse_pages(pages: DataFrame, key: str, html: str, url: str | None = None) -> DataFrame:
    """key, blocks, title, lang, links, characters, scripts of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, PARSED) for b in batches for a in range(0, b.num_rows, PARSED)):
            texts = [normal_text(x or "") for x in batch.column(1).to_pylist()]
            metas = [page_metadata(t, u or "") for t, u in zip(texts, batch.column(2).to_pylist())]
            columns = [
                batch.column(0),
                pa.array([html_blocks(t) for t in texts], pa.list_(_BLOCK_STRUCT)),
                *(pa.array([m[k] for m in metas], pa.string()) for k in ("title", "lang")),
                pa.array([m["links"] for m in metas], pa.list_(pa.string())),
                *(pa.array([m[k] for m in metas], pa.int32()) for k in ("characters", "scripts")),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "blocks", "title", "lang", "links", "characters", "scripts"])

    kind = dict(pages.dtypes)[key]
    image = ",".join(f"{n}:string" for n in _IMAGE) + ",decorative:boolean"
    block = f"struct<heading:string,kind:string,language:string,text:string,url:string,image:struct<{image}>>"
    source = pages.select(key, html, F.col(url) if url else F.lit("").alias("__url"))
    return source.mapInArrow(run, f"{key} {kind}, blocks array<{block}>, title string, lang string, links array<string>, characters int, scripts int")


def format_of(content_type: Column, name: Column) -> Column:
    """image, markdown, html, code or text."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(kind.startswith("image/") | ext.isin("png", "jpg", "jpeg", "gif", "webp"), "image")
        .when(kind.contains("markdown") | ext.isin("md", "markdown"), "markdown")
        .when(kind.contains("html") | ext.isin("html", "htm"), "html")
        .when(ext.isin(*LANGUAGES), "code")
        .otherwise("text")
    )


#: Languages by file extension.
LANGUAGES = {
    "java": "java", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp",
    "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "sh": "bash", "bash": "bash", "zsh": "bash",
    "kt": "kotlin", "kts": "kotlin", "php": "php", "swift": "swift", "scala": "scala", "sql": "sql", "yml": "yaml", "yaml": "yaml",
    "json": "json", "toml": "toml", "xml": "xml", "html": "html", "htm": "html", "css": "css", "scss": "scss", "gradle": "groovy",
    "groovy": "groovy", "lua": "lua", "pl": "perl", "r": "r", "dart": "dart", "tf": "terraform", "proto": "protobuf", "ini": "ini",
    "properties": "properties", "rst": "rst", "adoc": "asciidoc",
}


def language_of(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    ending = F.when(name.contains("."), F.element_at(table, F.substring_index(name, ".", -1)))
    return F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile").when(name == "makefile", "makefile").otherwise(ending)


def forge_url(uri: Column) -> Column:
    """Web address of git+https://host/owner/repo@sha/path, by the kind of host; null for other texts."""
    part = lambda i: F.regexp_extract(uri, r"^git\+(https?://[^/]+/.+?)(?:\.git)?@([0-9a-f]+)/(.*)$", i)
    repo, sha, path = part(1), part(2), part(3)
    return (
        F.when(repo == "", F.lit(None))
        .when(repo.contains("gitlab"), F.concat(repo, F.lit("/-/blob/"), sha, F.lit("/"), path))
        .when(repo.contains("bitbucket"), F.concat(repo, F.lit("/src/"), sha, F.lit("/"), path))
        .when(repo.contains("github"), F.concat(repo, F.lit("/blob/"), sha, F.lit("/"), path))
        .otherwise(F.concat(repo, F.lit("/src/commit/"), sha, F.lit("/"), path))
    )
