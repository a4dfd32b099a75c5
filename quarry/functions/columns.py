"""Scalar functions on corpus rows, as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters, digits and underscores of any script (a plain ``\\w`` is ASCII in the JVM).
TOKEN = r"[\p{L}\p{N}_]+"
#: White space that is stripped at the ends of texts.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Navigation pages that documentation generators write, and families of their names.
GENERATED_NAMES = (
    "annotated.html", "classes.html", "hierarchy.html", "files.html", "namespaces.html", "namespacemembers.html", "functions.html", "globals.html", "pages.html", "modules.html",
    "todo.html", "deprecated.html", "bug.html", "inherits.html", "genindex.html", "search.html", "py-modindex.html", "modindex.html",
)
GENERATED_PATTERN = r"^([^/]*_source|(functions|globals|namespacemembers|classmembers)_[A-Za-z0-9_]*|dir_[0-9a-f]+)\.html$"


def tokens(text: Column) -> Column:
    """Lower-cased words; stop words stay, nothing is stemmed."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))


def quality_score(text: Column, title: Column) -> Column:
    """Length-based score from 0 to 1, with bonuses for a title and for 50 and 100 words; blank text scores 0."""
    words = n_words(text)
    bonus = lambda c: F.when(c, F.lit(0.1)).otherwise(F.lit(0.0))
    total = F.least(words / F.lit(200.0), F.lit(1.0)) + bonus(F.coalesce(strip(title), F.lit("")) != "") + bonus(words > 50) + bonus(words > 100)
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def passes_gate(text: Column, title: Column, *, min_score: float = 0.3, min_chars: int = 50) -> Column:
    """Whether a page is long enough and its unrounded score reaches the minimum."""
    whole = strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit(""))))
    return (F.length(whole) >= min_chars) & (quality_score(text, title) >= min_score)


def round2(value: Column) -> Column:
    """Two decimal places: the nearer of the two numbers around, by the exact binary value, the even one in a tie."""
    v = value.cast("double")
    product = v * 100
    # what the product lost by rounding, from the upper and the lower half of the value's bits
    shifted = v * 134217729.0
    upper = shifted - (shifted - v)
    lost = (upper * 100 - product) + (v - upper) * 100
    low = F.floor(product)
    part = product - low
    up = (part > 0.5) | ((part == 0.5) & ((lost > 0) | ((lost == 0) & (low % 2 != 0))))
    return (low + F.when(up, 1).otherwise(0)) / F.lit(100.0)


def first_line(text: Column) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_generated(path: Column) -> Column:
    """Pages that a generator wrote for navigation: exact names, families of names, or below ``_modules``."""
    name = file_name(path)
    return name.isin(*GENERATED_NAMES) | name.rlike(GENERATED_PATTERN) | F.array_contains(F.split(path, "/"), "_modules")


def doc_type(name: Column, category: Column) -> Column:
    """Kind of a page from its file name; developer pages have other kinds than user pages."""
    n = F.lower(name)
    dev = F.when(n.startswith("class") | n.startswith("struct"), "class").when(n.startswith("namespace"), "namespace").when(n.contains("modules") | n.contains("group"), "module").otherwise("page")
    user = F.when(n.contains("tutorial"), "tutorial").when(n.contains("guide") | n.contains("howto"), "guide").when(n.contains("api") | n.contains("reference"), "reference").otherwise("page")
    return F.when(category == "dev", dev).otherwise(user)


def slug(heading: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}_]", "_"), 1, 50)


def section_id(url: Column, heading: Column) -> Column:
    """The page's address and the heading's slug; ``root`` for what stands before the first heading."""
    return F.concat(url, F.lit("#"), F.coalesce(slug(heading), F.lit("root")))


def page_url(base: Column, path: Column) -> Column:
    """The page's public address, or its path where there is no base."""
    return F.when(F.coalesce(base, F.lit("")) == "", path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))


def citation_base(bases: Column, category: Column) -> Column:
    """The base address for a category, else the first that isn't empty."""
    some = F.get(F.filter(F.map_values(bases), lambda x: x != ""), F.lit(0))
    return F.coalesce(F.nullif(F.try_element_at(bases, category), F.lit("")), some, F.lit(""))


def page_key(url: Column, file: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(F.coalesce(url, F.lit("")), "#", 1), F.lit("")), file)


def qualified_name(url: Column) -> Column:
    """The last two parts of an address's path, without fragment and query."""
    parts = F.filter(F.split(F.regexp_replace(url, r"[#?].*$", ""), "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")


def position_key(position: Column, chunk_id: Column) -> Column:
    """Sorts the chunks of a page by place: the numerator of ``i/n``, then the chunk's number; what can't be read is last."""
    at = F.substring_index(F.coalesce(position, F.lit("")), "/", 1).try_cast("double")
    return F.struct(F.coalesce(at, F.lit(float("inf"))).alias("at"), F.coalesce(chunk_id.cast("double"), F.lit(float("inf"))).alias("id"))


#: The owner and the member at the end of a qualified name, and the kinds of pages that declare members.
OWNED = r"([A-Za-z_][A-Za-z0-9_]*)::~?[A-Za-z_][A-Za-z0-9_]*\s*$"
DECLARING = ("class", "struct", "interface")


def declaring_files(hierarchy: Column) -> Column:
    """File names of the pages that may declare the member at the end of a qualified name (underscores of its owner are doubled there)."""
    owner = F.regexp_extract(F.coalesce(hierarchy, F.lit("")), OWNED, 1)
    made = F.replace(owner, F.lit("_"), F.lit("__"))
    return F.when(owner == "", F.array().cast("array<string>")).otherwise(F.array(*[F.concat(F.lit(p), made, F.lit(".html")) for p in DECLARING]))


def declares(url: Column, hierarchy: Column) -> Column:
    """Whether a row's page is one that declares its symbol."""
    return F.array_contains(declaring_files(hierarchy), file_name(F.substring_index(F.coalesce(url, F.lit("")), "#", 1)))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def duration(seconds: Column) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``."""
    s = F.floor(seconds).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def config_label(entries: Column) -> Column:
    """``k=v, ...`` of an array of (k, v) in its order; ``default`` where there is none."""
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ", ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("default"))


#: Tags that say difficulty and language; others are type, then modules.
DIFFICULTIES, LANGUAGES = ("easy", "medium", "hard"), ("Fr", "En")


def tag_dimensions(tags: Column) -> Column:
    """One struct of difficulty, language, type and module names from a question's tags."""
    low = F.coalesce(tags, F.array().cast("array<string>"))
    rest = F.filter(low, lambda t: ~F.lower(t).isin(*DIFFICULTIES) & ~t.isin(*LANGUAGES))
    pick = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("unspecified"))
    modules = F.when(F.size(rest) > 1, F.slice(rest, F.lit(2), F.greatest(F.lit(1), F.size(rest) - 1))).otherwise(F.array(F.lit("unspecified")))
    return F.struct(
        pick(F.filter(low, lambda t: F.lower(t).isin(*DIFFICULTIES))).alias("difficulty"),
        pick(F.filter(low, lambda t: t.isin(*LANGUAGES))).alias("language"),
        F.coalesce(F.get(rest, F.lit(0)), F.when(F.size(low) == 0, F.lit("untagged")).otherwise(F.lit("unspecified"))).alias("type"),
        modules.alias("modules"),
    )
