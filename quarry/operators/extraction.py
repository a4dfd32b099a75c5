"""Documentation pages to text, sections, symbols and chunks.

Developer pages (symbol blocks of class ``memitem``, tables of class ``memberdecls``) become one
group of chunks for each declared symbol and a summary; other pages become sections at second and third
level headings. Parsing needs a tree, so it is done over Arrow batches; the rest is columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.chunking import char_windows, token_windows
from quarry.operators.html_tree import Node, has_class, is_tag, parse
from quarry.sources.store import with_positions

NOISE = is_tag("script", "style", "noscript")
CHROME = is_tag("script", "style", "noscript", "nav")
CHROME_CLASSES = has_class("sphinxsidebar", "related", "footer")
PAGE_NOISE = is_tag("script", "style", "nav", "footer", "header")
PAGE_IDS = frozenset(("nav-tree", "nav-path", "top", "side-nav"))
#: The owner and the member at the end of a qualified name.
OWNER = re.compile(r"([A-Za-z_]\w*)::~?[A-Za-z_]\w*\s*$")
BLANKS = re.compile(r"\n{3,}")
CUT = "\n[cut]"
BLOCK = frozenset("p div section article table ul ol dl tr blockquote header footer main aside figure body html".split())


def content_root(tree: Node, category: str) -> Node:
    """Where a page's content is: ``div.contents`` of developer pages, else the first usual container, else the body."""
    body = tree.find(is_tag("body")) or tree
    if category == "dev":
        return tree.find(lambda n: n.tag == "div" and "contents" in n.classes) or body
    tests = (lambda n: n.attrs.get("role") == "main", *[lambda n, c=c: n.tag == "div" and c in n.classes for c in ("document", "body", "section")], is_tag("article"))
    return next((n for t in tests if (n := tree.find(t))), body)


def code_text(node: Node) -> str:
    """The text of a code element; of a fragment, its lines."""
    lines = node.find_all(lambda n: n.tag == "div" and "line" in n.classes)
    return ("\n".join(n.text() for n in lines) if lines else node.text()).strip("\n")


def fenced(node: Node) -> str:
    code = code_text(node)
    return f"```\n{code}\n```" if code.strip() else ""


def _is_code(n: Node) -> bool:
    return n.tag == "pre" or (n.tag == "div" and "fragment" in n.classes)


def markdown(node: Node, skip=NOISE) -> str:
    """Markdown of a subtree: headings with #, bullets with -, code fenced, links as text; three and more line feeds become two."""
    out: list[str] = []

    def visit(n: Node, depth: int) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            elif skip(c):
                continue
            elif _is_code(c):
                out.append(f"\n\n{fenced(c)}\n\n")
            elif re.fullmatch("h[1-6]", c.tag):
                out.append(f"\n\n{'#' * int(c.tag[1])} {re.sub(r'\s+', ' ', c.text()).strip()}\n\n")
            elif c.tag == "li":
                out.append("\n" + "  " * depth + "- ")
                visit(c, depth + 1)
            elif c.tag == "br":
                out.append("\n")
            elif c.tag in ("code", "tt"):
                out.append(f"`{c.text()}`")
            elif c.tag in ("b", "strong") or c.tag in ("i", "em"):
                mark, inner = "**" if c.tag in ("b", "strong") else "*", c.text().strip()
                out.append(f"{mark}{inner}{mark}" if inner and not c.find(lambda x: x.tag in BLOCK) else "")
                if inner and c.find(lambda x: x.tag in BLOCK):
                    visit(c, depth)
            elif c.tag in BLOCK:
                out.append("\n\n")
                visit(c, depth)
                out.append("\n\n")
            else:
                visit(c, depth)

    visit(node, 0)
    text = "\n".join(line.rstrip() for line in "".join(out).split("\n"))
    return BLANKS.sub("\n\n", text).strip()


def page_title(tree: Node, name: str) -> str:
    """The first heading, the title, or the file's name without its ending."""
    for tag in ("h1", "title"):
        node = tree.find(is_tag(tag))
        if node and (text := re.sub(r"\s+", " ", node.text()).strip()):
            return text
    return re.sub(r"\.[^.]*$", "", re.sub(r"[#?].*$", "", name).rstrip("/").rsplit("/", 1)[-1])


def page_text(tree: Node, category: str, limit: int | None = 8000) -> str:
    """Readable text of a page, cut at ``limit`` characters with a mark; whole without one."""
    body = tree.find(is_tag("body")) or tree
    skip = lambda n: PAGE_NOISE(n) or n.attrs.get("id") in PAGE_IDS
    root = content_root(tree, category)
    text = BLANKS.sub("\n\n", (root if root is not body else body).text("\n", skip))
    return text if limit is None or len(text) <= limit else text[:limit] + CUT


def split_sections(tree: Node, category: str) -> list[tuple[str | None, str]]:
    """(heading, text) of each section; what stands before the first second or third level heading has none."""
    root = content_root(tree, category)
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    stack: list[Node | str] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if s := x.strip():
                out[-1][1].append(s)
        elif x is not root and NOISE(x):
            continue
        elif x.tag in ("h2", "h3"):
            out.append((re.sub(r"\s+", " ", x.text()).strip(), []))
        elif x is not root and _is_code(x):
            if code := fenced(x):
                out[-1][1].append(code)
        else:
            stack += reversed(x.children)
    found = [(h, "\n".join(t)) for h, t in out if t]
    return found or [(None, markdown(root))]


def has_symbols(tree: Node) -> bool:
    """Whether the page has symbol blocks, inherited ones included."""
    return tree.find(lambda n: n.tag == "div" and "memitem" in n.classes) is not None


def symbols(tree: Node) -> list[dict[str, str]]:
    """The page's own symbols: anchor, name, signature and description of each block that isn't inherited."""
    out = []
    for item in tree.find_all(lambda n: n.tag == "div" and "memitem" in n.classes):
        proto = item.find(has_class("memproto"))
        if proto is None or proto.find(lambda n: n.tag == "span" and "inherited" in n.classes):
            continue
        signature = " ".join(proto.text(" ").split())
        named = proto.find(lambda n: n.tag == "td" and "memname" in n.classes)
        doc = item.find(has_class("memdoc"))
        before = item.parent.children[: item.parent.children.index(item)]
        anchor = next((c.attrs["id"] for c in reversed(before) if isinstance(c, Node) and c.tag == "a" and c.attrs.get("id")), "")
        name = " ".join("".join(x.strip() for x in named.strings()).split()) if named else signature[:80]
        out.append({"anchor": anchor, "name": name, "signature": signature, "text": doc.text("\n") if doc else ""})
    return out


def class_of(names: list[str]) -> str:
    """The class that most symbols belong to; of equals, the first."""
    votes = Counter(m[1] for n in names if (m := OWNER.search(n)))
    return max(votes, key=lambda k: votes[k]) if votes else ""  # max() keeps the first of equals


def member_name(row: Node, anchor: str) -> str:
    """The text of the row's link to the anchor: others lead to types."""
    link = row.find(lambda n: n.tag == "a" and n.attrs.get("href", "").endswith(f"#{anchor}"))
    return "".join(x.strip() for x in link.strings()) if link else ""


def class_summary(tree: Node, anchors: set[str], owner: str) -> str:
    """The class's description, and a line with name, signature and brief for each declared member of the page's tables; empty without tables."""
    tables = tree.find_all(lambda n: n.tag == "table" and "memberdecls" in n.classes)
    block = tree.find(lambda n: n.tag == "div" and "textblock" in n.classes)
    parts = [" ".join(block.text(" ").split())] if block and tables else []
    for table in tables:
        rows: dict[str, list[str]] = {}
        for row in table.find_all(is_tag("tr")):
            for cls in row.classes:
                kind, _, anchor = cls.partition(":")
                if kind in ("memitem", "memdesc") and anchor in anchors:
                    cell = rows.setdefault(anchor, ["", "", ""])
                    cell[kind == "memdesc"] = " ".join(row.text(" ").split())
                    if kind == "memitem":
                        cell[2] = member_name(row, anchor)
        if rows:
            head = table.find(is_tag("h2"))
            lines = [f"{owner}::{name}  {sig}  {brief}" if owner and name else f"{sig}  {brief}" for sig, brief, name in rows.values()]
            parts.append("\n".join(x for x in [head.text().strip() if head else "", *(line.strip() for line in lines)] if x))
    return "\n\n".join(p for p in parts if p)


def code_blocks(tree: Node) -> list[str]:
    """The first five code texts of more than ten characters that aren't part of one kept before."""
    kept: list[str] = []
    for n in tree.find_all(is_tag("pre", "code")):
        text = n.text().strip()
        if len(text) > 10 and not any(text in k for k in kept):
            kept.append(text)
    return kept[:5]


def chunker(*, size: int = 1000, overlap: int = 200, tokenizer: tuple[Callable[[str], list[int]], Callable[[list[int]], str]] | None = None, use_tokens: bool = False, max_tokens: int = 384, overlap_tokens: int = 50) -> Callable[[str], list[str]]:
    """The function that cuts texts: by tokens where that is asked for and there is a tokenizer (encode, decode), else by characters."""
    if use_tokens and tokenizer:
        return lambda t: token_windows(t, *tokenizer, max_tokens, overlap_tokens)
    return lambda t: char_windows(t, size, overlap)


def short_enough(text: str, encode: Callable[[str], list[int]] | None, most: int = 512) -> bool:
    """Whether a chunk has no more tokens than an embedding model takes; without a tokenizer every one is kept."""
    return encode is None or len(encode(text)) <= most


def page_chunks(page: str, name: str, category: str, cut: Callable[[str], list[str]] = char_windows, encode: Callable[[str], list[int]] | None = None) -> list[dict]:
    """All chunks of a page, in order, with the position of each in its section; one that is too long goes and leaves a gap."""
    return tree_chunks(parse(page), name, category, cut, encode)


def tree_chunks(tree: Node, name: str, category: str, cut: Callable[[str], list[str]] = char_windows, encode: Callable[[str], list[int]] | None = None) -> list[dict]:
    """:func:`page_chunks` of a page that is parsed."""
    title = page_title(tree, name)
    groups: list[dict] = []
    own = symbols(tree) if category == "dev" else []
    if own:
        owner = class_of([s["name"] for s in own])
        summary = class_summary(tree, {s["anchor"] for s in own if s["anchor"]}, owner)
        if summary:
            groups.append({"id": "__summary", "heading": title, "symbol": "", "anchor": "", "texts": [f"{title}\n\n{t}" for t in cut(summary)]})
        for s in own:
            ident = s["anchor"] or re.sub(r"\W", "_", s["name"].lower())[:50]
            groups.append({"id": ident, "heading": s["name"], "symbol": s["name"], "anchor": s["anchor"], "texts": cut(f"{s['signature']}\n\n{s['text']}")})
    else:
        for heading, text in split_sections(tree, category):
            if text.strip():
                body = text if heading is not None else f"{title}\n\n{text}"
                groups.append({"id": re.sub(r"\W", "_", heading.lower())[:50] if heading else "root", "heading": heading or title, "texts": cut(body)})
    code = code_blocks(tree)
    out: list[dict] = []
    for g in groups:
        for i, t in enumerate(g["texts"]):
            if t.strip() and short_enough(t, encode):
                out.append({"chunk_id": len(out), "title": title, "hierarchy": g["heading"], "section": g["id"], "pos": i + 1, "total": len(g["texts"]), "symbol_name": g.get("symbol"), "anchor_id": g.get("anchor"), "content": t, "has_code": bool(code), "code_blocks": code})
    return out


WORD = re.compile(r"\w+")


def page_score(text: str, title: str, min_score: float, min_chars: int = 50) -> float | None:
    """The quality score of a page's whole text, of two places; None where the page is too short or its unrounded score below the minimum."""
    words = len(WORD.findall(text))
    score = min(1.0, min(words / 200.0, 1.0) + (0.1 if title.strip() else 0.0) + (0.1 if words > 50 else 0.0) + (0.1 if words > 100 else 0.0)) if text.strip() else 0.0
    return round(score, 2) if score >= min_score and len(f"{title}\n\n{text}".strip()) >= min_chars else None


def _map(pages: DataFrame, schema: str, rows_of, category: str = "user", keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_id``, the columns ``keep``, and the rows that ``rows_of(html, url, category)`` makes of each page; a column ``doc_category`` of the pages goes before ``category``."""
    fields = [c.split() for c in schema.split(", ")]
    names = [c for c, _ in fields]
    own = F.col("doc_category") if "doc_category" in pages.columns else F.lit(category)
    rows = pages.select("page_id", "url", "html", own.alias("category"), *keep)
    types = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = [types[k] for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                at, made = [], []
                for i, (url, html, kind) in enumerate(zip(*(b[c].to_pylist() for c in ("url", "html", "category")), strict=True)):
                    found = rows_of(html or "", url or "", kind or "user")
                    at += [i] * len(found)
                    made += found
                cols = [pa.array([m[n] for m in made], k) for n, k in zip(names, kinds, strict=True)]
                taken = [b[c].take(pa.array(at, pa.int64())) for c in ("page_id", *keep)]
                yield pa.RecordBatch.from_arrays([*taken, *cols], ["page_id", *keep, *names])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("page_id", *keep))
    return rows.mapInArrow(run, f"{kept}, {schema}")


def pages(source: DataFrame, category: str = "user") -> DataFrame:
    """``page_id, title, text, has_symbols`` of each page; the text is cut for reading."""

    def one(html: str, url: str, kind: str) -> list[dict]:
        tree = parse(html)
        return [{"title": page_title(tree, url), "text": page_text(tree, kind), "has_symbols": has_symbols(tree)}]

    return _map(source, "title string, text string, has_symbols boolean", one, category)


def sections(source: DataFrame, category: str = "user") -> DataFrame:
    """``page_id, ord, section, n_chars`` of each section of each page."""

    def many(html: str, url: str, kind: str) -> list[dict]:
        return [{"ord": i, "heading": h, "text": t} for i, (h, t) in enumerate(split_sections(parse(html), kind))]

    out = _map(source, "ord int, heading string, text string", many, category)
    return out.select("page_id", "ord", C.section_id(F.col("page_id").cast("string"), F.col("heading")).alias("section"), F.length("text").alias("n_chars"))


CHUNK = "chunk_id int, title string, hierarchy string, section string, pos int, total int, symbol_name string, anchor_id string, content string, has_code boolean, code_blocks array<string>, quality_score double"


def chunks(source: DataFrame, *, category: str = "user", min_score: float = 0.3, project: str = "docs", cut: Callable[[str], list[str]] = char_windows, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """Chunks of the pages that pass the quality gate, with their metadata, in one pass over the pages.

    ``source(page_id, url, html)`` may have ``module, doc_category, base_url, module_description``. The gate and the score are of the page's whole text.
    """
    def many(html: str, url: str, kind: str) -> list[dict]:
        tree = parse(html)
        score = page_score(page_text(tree, kind, None), page_title(tree, url), min_score)
        return [] if score is None else [m | {"quality_score": score} for m in tree_chunks(tree, url, kind, cut, encode)]

    has = lambda c, default: (F.coalesce(F.col(c), F.lit(default)) if c in source.columns else F.lit(default)).alias(c)
    about = source.select("page_id", "url", "html", F.coalesce("url", F.lit("")).alias("file"), has("module", ""), has("doc_category", category), has("base_url", "").alias("parent_doc_id"), has("module_description", ""))
    out = _map(about, CHUNK, many, category, ("file", "module", "doc_category", "parent_doc_id", "module_description"))
    page = C.page_url(F.col("parent_doc_id"), F.col("file"))
    anchored = F.coalesce(F.nullif(F.col("anchor_id"), F.lit("")).isNotNull(), F.lit(False))
    return out.select(
        "page_id", "chunk_id", "title", "hierarchy", "section", "pos", "total", "symbol_name", "anchor_id", "content", "has_code", "code_blocks", "quality_score", "module", "doc_category",
        "parent_doc_id", "module_description", "file", F.concat(F.col("pos").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("chunk_position"),
        F.when(anchored, F.concat(page, F.lit("#"), F.col("anchor_id"))).otherwise(page).alias("url"), F.concat(page, F.lit("#"), F.col("section")).alias("section_id"),
        C.doc_type(C.file_name(F.col("file")), F.col("doc_category")).alias("doc_type"),
        F.concat(F.lit(f"{project} "), F.col("module"), F.lit(" "), F.initcap("doc_category"), F.lit(" Documentation")).alias("source"),
    )


#: The order in which a module's kinds of pages are processed.
CATEGORIES = ("dev", "user", "methodology")


def build_corpus(spark: SparkSession, roots: list[dict[str, str]], *, project: str = "docs", **options) -> DataFrame:
    """Chunks of all registered folders with ``ord``, a dense long from 0: modules in the order given, categories in that of ``CATEGORIES``, then files and places in them.

    ``roots`` are mappings with ``module, doc_category, path`` and perhaps ``base_url`` and ``description``. All folders are one plan.
    """
    from quarry.sources.files import html_pages

    order = list(dict.fromkeys(r["module"] for r in roots))
    found = None
    for r in roots:
        at = order.index(r["module"]) * len(CATEGORIES) + CATEGORIES.index(r["doc_category"])
        literal = {"at": F.lit(at), "module": F.lit(r["module"]), "doc_category": F.lit(r["doc_category"]), "base_url": F.lit(r.get("base_url", "")), "module_description": F.lit(r.get("description", ""))}
        one = html_pages(spark, r["path"]).withColumns(literal).withColumn("page_id", F.concat_ws("/", F.lpad(F.col("at").cast("string"), 6, "0"), "url"))
        found = one if found is None else found.unionByName(one)
    made = chunks(found, project=project, **options)
    return with_positions(made, "page_id", "chunk_id")
