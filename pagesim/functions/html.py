"""HTML to tag sequences.

Two engines. ``parser`` (the default and the contract) reads pages with the standard library's
HTML parser inside one ``mapInArrow``: the operator is opaque to the optimizer, so a page is
parsed once however many of its results are used, and ``html`` is dropped there unless asked for.
``native`` keeps everything in JVM expressions and is exact on well-formed pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import REMOVED_ELEMENTS, TAGS_ATTRS, TAGS_ONLY, VOID_ELEMENTS

# Patterns for resources.
CSS_URL = re.compile(r"""url\(["']?([^"')]+)["']?\)""")
PRELOAD_HINTS = ["preload", "prefetch", "dns-prefetch", "preconnect"]
SRC_ELEMENTS = ["script", "img", "iframe", "video", "audio", "source"]
DOMAIN_ELEMENTS = ["script", "link", "img", "iframe"]

PARSE_ROWS = 512

_VOID = frozenset(VOID_ELEMENTS)
_REMOVED = frozenset(REMOVED_ELEMENTS)

_STRINGS = T.ArrayType(T.StringType())
PAGE_FIELDS = {
    "all_tags": _STRINGS,        # every start tag, document order
    "depth": T.IntegerType(),    # deepest nesting
    "tags": _STRINGS,            # without script/style/noscript subtrees
    "tag_attrs": _STRINGS,       # the same tags as tag:attr pairs
    "refs": _STRINGS,            # resource references as written
    "domain_refs": _STRINGS,     # src or else href of script/link/img/iframe
    "events": _STRINGS,          # start tags and /end tags as they open and close
}


class _PageReader(HTMLParser):
    """Collects the tag events of one page.

    Nesting rule: void elements never stay open, an end tag closes up to its nearest open
    match and is ignored when there is none, nothing is closed implicitly."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out = {name: [] for name in PAGE_FIELDS}
        self.out["depth"] = 0
        self.open_tags: list[str] = []
        self.dropped_from: int | None = None
        self.style_text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, leave_open=tag not in _VOID)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, leave_open=False)

    def handle_endtag(self, tag):
        if tag not in self.open_tags:
            return
        while self.open_tags:
            closed = self.open_tags.pop()
            self.out["events"].append("/" + closed)
            if closed == "style":
                self._end_style()
            if closed == tag:
                break
        if self.dropped_from is not None and len(self.open_tags) <= self.dropped_from:
            self.dropped_from = None

    def handle_data(self, data):
        if self.style_text is not None:
            self.style_text.append(data)

    def finish(self):
        self.close()
        if self.style_text is not None:
            self._end_style()
        return self.out

    def _start(self, tag, attrs, leave_open):
        values = {name: value or "" for name, value in attrs}
        out = self.out
        out["events"].append(tag)
        out["all_tags"].append(tag)
        out["depth"] = max(out["depth"], len(self.open_tags) + 1)
        if self.dropped_from is None and tag not in _REMOVED:
            out["tags"].append(tag)
            out["tag_attrs"].extend([f"{tag}:{name}" for name in values] or [tag])
        self._references(tag, values)
        if leave_open:
            if self.dropped_from is None and tag in _REMOVED:
                self.dropped_from = len(self.open_tags)
            self.open_tags.append(tag)
            if tag == "style":
                self.style_text = []
        else:
            out["events"].append("/" + tag)

    def _references(self, tag, values):
        refs = self.out["refs"]
        if tag in SRC_ELEMENTS and "src" in values:
            refs.append(values["src"])
        elif tag == "link" and "href" in values:
            rel = values.get("rel", "").split()
            joined = " ".join(rel)
            if "stylesheet" in rel or any(hint in joined for hint in PRELOAD_HINTS):
                refs.append(values["href"])
        if tag in DOMAIN_ELEMENTS:
            target = values.get("src") or values.get("href")
            if target:
                self.out["domain_refs"].append(target)

    def _end_style(self):
        self.out["refs"].extend(CSS_URL.findall("".join(self.style_text or [])))
        self.style_text = None


def read_page(html: str) -> dict:
    """Parse results of one page, keyed as ``PAGE_FIELDS``."""
    reader = _PageReader()
    reader.feed(html)
    return reader.finish()


def html_tokens(df: DataFrame, fields=("tags",), html: str = "html",
                keep_html: bool = False, engine: str = "parser") -> DataFrame:
    """Add the parse results ``fields`` to ``df`` and drop the page text.

    A page without text gives NULLs. A page that fails to parse gives empty results and its
    message in ``parse_error``; it never fails the job."""
    fields = list(fields)
    unknown = set(fields) - set(PAGE_FIELDS)
    if unknown:
        raise ValueError(f"unknown page fields {sorted(unknown)}")
    if engine == "native":
        native = {"tags": native_tags, "all_tags": native_all_tags, "depth": native_depth, "tag_attrs": native_tag_attrs,
                  "refs": native_refs, "domain_refs": native_domain_refs, "events": native_events}
        out = df.withColumns({f: F.when(F.octet_length(html) > 0, native[f](F.col(html))) for f in fields})
        out = out.withColumn("parse_error", F.lit(None).cast("string"))
        return out if keep_html else out.drop(html)
    if engine != "parser":
        raise ValueError(f"unknown engine {engine!r}")

    replaced = {*fields, "parse_error"} | (set() if keep_html else {html})
    kept = [f for f in df.schema.fields if f.name not in replaced]
    schema = T.StructType(
        kept + [T.StructField(f, PAGE_FIELDS[f]) for f in fields]
        + [T.StructField("parse_error", T.StringType())]
    )
    kept_names = [f.name for f in kept]
    arrow_types = {
        f: pa.int32() if PAGE_FIELDS[f] == T.IntegerType() else pa.list_(pa.string()) for f in fields
    }

    def parse(batches):
        # slices bound the Python copies when pages are large
        for batch in (b.slice(at, PARSE_ROWS) for b in batches for at in range(0, b.num_rows, PARSE_ROWS)):
            columns = {f: [] for f in fields}
            errors = []
            for text in batch.column(html).to_pylist():
                page, error = None, None
                if text:
                    try:
                        page = read_page(text)
                    except Exception as exc:  # one bad page must not fail the job
                        page, error = {f: 0 if f == "depth" else [] for f in fields}, str(exc)
                for f in fields:
                    columns[f].append(None if page is None else page[f])
                errors.append(error)
            arrays = [batch.column(name) for name in kept_names]
            arrays += [pa.array(columns[f], arrow_types[f]) for f in fields]
            arrays.append(pa.array(errors, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=kept_names + fields + ["parse_error"])

    return df.mapInArrow(parse, schema)


def as_dom(tags: Column) -> Column:
    """Space-joined UTF-8 bytes of a tag sequence."""
    return F.encode(F.array_join(tags, " "), "UTF-8")


def sanitize_tags(df: DataFrame, html: str = "html", keep_html: bool = False,
                  engine: str = "parser") -> DataFrame:
    """``tags`` and ``dom`` without script, style and noscript subtrees."""
    out = html_tokens(df, ["tags"], html, keep_html, engine)
    return out.withColumn("dom", as_dom(F.col("tags")))


def sanitize_tags_attrs(df: DataFrame, html: str = "html", keep_html: bool = False,
                        engine: str = "parser") -> DataFrame:
    """``tag_attrs`` and ``dom`` of tag:attr pairs in source order."""
    out = html_tokens(df, ["tag_attrs"], html, keep_html, engine)
    return out.withColumn("dom", as_dom(F.col("tag_attrs")))


def sanitize(df: DataFrame, mode: str = TAGS_ONLY, **options) -> DataFrame:
    """Dispatch on the sanitizing mode. Empty pages give a NULL dom."""
    if mode == TAGS_ONLY:
        return sanitize_tags(df, **options)
    if mode == TAGS_ATTRS:
        return sanitize_tags_attrs(df, **options)
    raise ValueError(f"no sanitizing mode {mode!r}; there are {TAGS_ONLY!r} and {TAGS_ATTRS!r}")


def dom_length(dom: Column) -> Column:
    """P5: bytes of the sanitized page."""
    return F.octet_length(dom)


# --- native engine: JVM expressions only -------------------------------------------------

COMMENT = r"(?s)<!--.*?-->"
START_TAG = r"<([a-zA-Z][^\s/>]*)"
# A whole tag: quoted values may hold anything, ``>`` included.
_TAG_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""
TAG_TEXT = rf"</?[a-zA-Z]{_TAG_REST}"
TAG_START = rf"{START_TAG}{_TAG_REST}"
TAG_EVENT = rf"(</?[a-zA-Z][^\s/>]*){_TAG_REST}"


def _without_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def native_tags(html: Column) -> Column:
    """Sanitized tag names."""
    text = _without_comments(html)
    for element in REMOVED_ELEMENTS:
        text = F.regexp_replace(text, rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", "")
    return F.transform(F.regexp_extract_all(text, F.lit(TAG_START), 1), F.lower)


def _blank_raw_text(html: Column) -> Column:
    text = _without_comments(html)
    for element in ["script", "style"]:
        text = F.regexp_replace(text, rf"(?is)(<{element}\b[^>]*>).*?(</{element}\s*>)", "$1$2")
    return text


def native_all_tags(html: Column) -> Column:
    """Every tag name, nothing removed."""
    return F.transform(F.regexp_extract_all(_blank_raw_text(html), F.lit(TAG_START), 1), F.lower)


def native_depth(html: Column) -> Column:
    """Deepest nesting: fold the tag events over the stack of open tags."""
    events = F.transform(F.regexp_extract_all(_blank_raw_text(html), F.lit(TAG_EVENT), 1), F.lower)
    void = F.array(*[F.lit("<" + name) for name in VOID_ELEMENTS])
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("deepest"))

    def step(state, event):
        is_end = event.startswith("</")
        opened = state["open"]
        # innermost first, so the position of a name is how many entries its end tag closes
        nearest = F.array_position(opened, F.concat(F.lit("<"), F.substr(event, F.lit(3))))
        after_end = F.when(
            nearest > 0, F.slice(opened, (nearest + 1).cast("int"), F.greatest(F.size(opened), F.lit(1)))
        ).otherwise(opened)
        after_start = F.when(F.array_contains(void, event), opened).otherwise(
            F.concat(F.array(event), opened))
        return F.struct(
            F.when(is_end, after_end).otherwise(after_start).alias("open"),
            F.when(is_end, state["deepest"]).otherwise(
                F.greatest(state["deepest"], F.size(opened) + 1)).alias("deepest"),
        )

    return F.aggregate(events, start, step, lambda state: state["deepest"])


#: One attribute within a tag: its name, and its value as written, quotes included.
ATTRIBUTE = r"""(?<=['"\s/])([^\s/>=][^\s/=>]*)(?:\s*=+\s*('[^']*'|"[^"]*"|(?!['"])[^>\s]*))?"""
#: Entities that occur in urls as written; others stay as they are.
ENTITIES = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, START_TAG, 1))


def _attribute_names(tag: Column) -> Column:
    """Names in source order, the first of repeated ones."""
    rest = F.regexp_replace(tag, r"^<[a-zA-Z][^\s/>]*", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), 1), F.lower))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, the last of repeated ones; empty without a value, NULL without the attribute."""
    rest = F.regexp_replace(tag, r"^<[a-zA-Z][^\s/>]*", "")
    names = F.reverse(F.transform(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), 1), F.lower))
    values = F.reverse(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), 2))
    at = F.array_position(names, name).cast("int")
    value = F.regexp_replace(F.get(values, at - 1), r"""(?s)^(['"])(.*)\1$""", "$2")
    for entity, character in ENTITIES.items():
        value = F.replace(value, F.lit(entity), F.lit(character))
    return F.when(at > 0, value)


def native_tag_attrs(html: Column) -> Column:
    """Tag:attr pairs of the sanitized tags, a tag without attributes by its name."""
    text = _without_comments(html)
    for element in REMOVED_ELEMENTS:
        text = F.regexp_replace(text, rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", "")

    def pairs(tag):
        names = _attribute_names(tag)
        return F.when(F.size(names) > 0, F.transform(names, lambda n: F.concat(_name(tag), F.lit(":"), n))).otherwise(F.array(_name(tag)))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"<[a-zA-Z]{_TAG_REST}"), 0), pairs))


def _without_scripts(html: Column) -> Column:
    return F.regexp_replace(_without_comments(html), r"(?is)(<script\b[^>]*>).*?(</script\s*>)", "$1$2")


def native_refs(html: Column) -> Column:
    """Resource references as written, in document order; those of a style sheet where it ends."""
    pieces = F.regexp_extract_all(_without_scripts(html), F.lit(rf"(?is)<style\b[^>]*>.*?</style\s*>|<[a-zA-Z]{_TAG_REST}"), 0)
    none = F.array().cast("array<string>")

    def one(value):
        return F.when(value.isNull(), none).otherwise(F.array(value))

    def found(piece):
        name = _name(piece)
        css = F.regexp_extract_all(F.regexp_replace(piece, r"(?is)^<style\b[^>]*>", ""), F.lit(CSS_URL.pattern), 1)
        # a split by spaces: stylesheet as a word of its own, a hint anywhere
        rel = F.split(F.trim(F.regexp_replace(F.coalesce(_attribute(piece, "rel"), F.lit("")), r"\s+", " ")), " ")
        joined = F.array_join(rel, " ")
        hinted = F.array_contains(rel, "stylesheet")
        for hint in PRELOAD_HINTS:
            hinted = hinted | joined.contains(hint)
        return (F.when(name == "style", css)
                .when(name.isin(SRC_ELEMENTS), one(_attribute(piece, "src")))
                .when((name == "link") & hinted, one(_attribute(piece, "href"))).otherwise(none))

    return F.flatten(F.transform(pieces, found))


def native_domain_refs(html: Column) -> Column:
    """Src, or else href, of the elements that load from elsewhere."""
    tags = F.regexp_extract_all(_blank_raw_text(html), F.lit(rf"<[a-zA-Z]{_TAG_REST}"), 0)

    def target(tag):
        src, href = _attribute(tag, "src"), _attribute(tag, "href")
        return F.when(_name(tag).isin(DOMAIN_ELEMENTS), F.when(src != "", src).otherwise(F.when(href != "", href)))

    return F.array_compact(F.transform(tags, target))


def native_events(html: Column) -> Column:
    """Start tags and /end tags as they open and close: a fold over the stack of open tags."""
    tags = F.regexp_extract_all(_blank_raw_text(html), F.lit(TAG_TEXT), 0)
    strings = F.array().cast("array<string>")

    def step(state, tag):
        opened, out = state["open"], state["out"]
        is_end = tag.startswith("</")
        name = F.lower(F.regexp_extract(tag, r"</?([a-zA-Z][^\s/>]*)", 1))
        closes = F.when(is_end, F.array_position(opened, name).cast("int")).otherwise(F.lit(0))
        alone = name.isin(VOID_ELEMENTS) | tag.endswith("/>")
        closed = F.transform(F.slice(opened, F.lit(1), closes), lambda n: F.concat(F.lit("/"), n))
        started = F.when(alone, F.array(name, F.concat(F.lit("/"), name))).otherwise(F.array(name))
        return F.struct(
            F.when(is_end, F.slice(opened, closes + 1, F.greatest(F.size(opened), F.lit(1))))
            .when(alone, opened).otherwise(F.concat(F.array(name), opened)).alias("open"),
            F.concat(out, F.when(is_end, closed).otherwise(started)).alias("out"))

    start = F.struct(strings.alias("open"), strings.alias("out"))
    return F.aggregate(tags, start, step, lambda state: state["out"])
