"""Main text of web pages by wrapper induction.

1. Each host has one model page, the one with the smallest id. Every page of the
   host is parsed once, folded (siblings of one tag and label form one slot) and
   aligned with the model page by simple tree matching. Each block of text gets its place: the
   slot of the model that it lies in, or the path below such a slot where the model lacks it.
2. Per host and place it is counted on how many different pages there is a block and
   on how many the same text stands there. What is the same on most pages of
   a host is template, inside the article too; places whose text varies are content.
3. Navigation, headers, footers, sidebars, forms, notices, adverts and reader comments
   that are marked as such by tag, role or label are left out on each page, and pages that
   mark an article or main part are read inside it.

If template blocks would be more than half of the blocks inside a marked article, the
pages are near copies of each other, not template, and the article stays whole.
Pages with the same blocks count as one page, so a host that is mostly copies of
one page does not turn that page into template.

Only hashes of places and blocks are shuffled, by host, place and block with map-side
combine, so a host with a third of all pages is no hot task. Model pages and template
blocks are bounded by the templates of the hosts; they are broadcast when
their measured size allows it and joined by host otherwise.

Defined results: null and empty pages give the empty text; pages without markup
are one block; a null URL and one without a host share the host ''; a host with fewer than PAGES
different pages is judged by tags and labels alone; rows that repeat an id are separate pages;
other columns are not read; markup may nest to any depth.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dom import BLOCKS, SILENT, Node, Slot, fold, match, parse, squeeze
from .staging import small, stage

#: Share of a host's pages from which on a block is template, and fewest pages that show it.
CONSTANT, PAGES = 0.5, 4
#: Bytes of model pages or template blocks up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split()) | SILENT
#: Class, id or role names of what is not the article, alone or with a word for its place or kind of box.
ASIDE_LABEL = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|user|reader)[-_]?)?"
    r"(?:ads?|adbox|adsense|advert\w*|banner|sponsor(?:ed)?|promo|promotion|nav|navbar|navigation|menu|breadcrumbs?|sidebar|header|masthead|footer|contentinfo|complementary|cookies?|consent|gdpr"
    r"|notices?|popup|newsletter|subscribe|signup|login|comments?|disqus|respond|hidden)"
    r"(?:[-_]?(?:box|block|area|bar|list|section|wrapper|container|widget|unit|slot|banner|notice|links?|items?|menu|form|thread|\d+))*(?=\s|$)",
    re.I,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAIN_LABEL = re.compile(r"(?:^|\s)(?:main|main[-_]content|article|(?:article|post|entry|story)[-_](?:content|body|text)|story)(?=\s|$)", re.I)


def _is_aside(tag: str, label: str, inside: bool) -> bool:
    if tag in ("article", "main", "body", "html", "#root"):
        return bool(label) and tag == "article" and inside and bool(ASIDE_LABEL.search(label))
    if tag == "header" and inside:
        return False
    return tag in ASIDE_TAGS or bool(label and (ASIDE_LABEL.search(label) or HIDDEN.search(label)))


def _is_main(tag: str, label: str) -> bool:
    return tag in ("article", "main") or bool(label and tag in ("div", "section") and MAIN_LABEL.search(label))


def host_of(url):
    """Lower-cased host of a URL column, '' if none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _skeleton(slots: list[Slot]) -> str:
    """A folded tree as JSON: per slot its parent and key."""
    parent = {k.id: s.id for s in slots for k in s.kids}
    return json.dumps([[parent.get(s.id, -1), s.key] for s in slots])


def _from_skeleton(text: str) -> Slot:
    slots = []
    for i, (parent, key) in enumerate(json.loads(text)):
        s = Slot(key)
        s.id = i
        slots.append(s)
        if parent >= 0:
            slots[parent].kids.append(s)
    return slots[0]


def _models(batches):
    for batch in batches:
        made = [_skeleton(fold(parse(h or ""))) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], ["host", "model"])


def _places(slots: list[Slot], mapped: dict[int, int]) -> dict[int, str]:
    """Place by node: the model's slot, or the path from the nearest slot that the model has."""
    named: dict[int, str] = {0: "0"}
    out: dict[int, str] = {}
    for s in slots:
        here = named[s.id]
        for n in s.nodes:
            out[id(n)] = here
        for k in s.kids:
            named[k.id] = str(mapped[k.id]) if k.id in mapped else f"{here}/{k.key}"
    return out


def page_blocks(html: str, model: Slot) -> tuple[list[str], list[str], list[bool], bool]:
    """Blocks of a page in page order without marked asides, their places, and whether the page marks a main part."""
    root = parse(html)
    slots = fold(root)
    places = _places(slots, match(model, slots[0]))
    todo: list = [(root, "0", False, False)]
    blocks: list[tuple[str, str, bool, bool]] = []
    now: list[str] = []
    owner, owner_within, heading = "0", False, False
    has_main = False

    def flush():
        text = squeeze("".join(now))
        now.clear()
        if text:
            blocks.append((text, owner, owner_within, heading))

    while todo:
        item, place, within, end = todo.pop()
        if end:
            flush()
            owner, owner_within, heading = place, within, False
        elif isinstance(item, str):
            now.append(item)
        else:
            node: Node = item
            if node.tag == "br":
                now.append("\n")
                continue
            if node.tag in SILENT or _is_aside(node.tag, node.label, within):
                if node.tag in BLOCKS:
                    flush()
                continue
            inner, inner_within = place, within
            if node.tag in BLOCKS or node is root:
                flush()
                todo.append((None, place, within, True))
                inner = places.get(id(node), place)
            if _is_main(node.tag, node.label):
                inner_within = has_main = True
            if node.tag in BLOCKS or node is root:
                owner, owner_within, heading = inner, inner_within, node.tag in HEADINGS
            todo.extend((k, inner, inner_within, False) for k in reversed(node.kids))
    flush()
    kept = [b for b in blocks if b[2]] if has_main else blocks
    return [b[0] for b in kept], [b[1] for b in kept], [b[3] for b in kept], has_main


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _read(names: list[str]):
    def work(batches):
        models: dict[str, Slot] = {}
        for batch in batches:
            texts, places, codes, heads, mains, pages = [], [], [], [], [], []
            for host, html, model in zip(*(batch.column(c) for c in ("host", "html", "model"))):
                host = host.as_py()
                if host not in models:
                    models[host] = _from_skeleton(model.as_py())
                text, place, head, main = page_blocks(html.as_py() or "", models[host])
                texts.append(text)
                places.append([_hash(p) for p in place])
                codes.append([_hash(f"{p}\n{t}") for p, t in zip(place, text)])
                heads.append(head)
                mains.append(main)
                pages.append(_hash(repr(codes[-1])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.bool_())), pa.array(mains, pa.bool_()), pa.array(pages, pa.int64())],
                [*names, "blocks", "places", "codes", "heads", "has_main", "page"],
            )

    return work


def _template(read: DataFrame) -> DataFrame:
    """(host, constants): hashes of the blocks that stand at one place on most different pages of a host."""
    block = F.explode(F.arrays_zip("places", "codes")).alias("b")
    blocks = read.select("host", "page", block).select("host", "page", F.col("b.places").alias("place"), F.col("b.codes").alias("code")).distinct()
    same = blocks.groupBy("host", "place", "code").agg(F.count("*").alias("same")).where(F.col("same") >= PAGES * CONSTANT)
    having = blocks.select("host", "page", "place").distinct().groupBy("host", "place").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    constant = same.join(having, ["host", "place"]).where(F.col("same") > CONSTANT * F.col("pages"))
    return constant.groupBy("host").agg(F.collect_set("code").alias("constants"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, host, text, n_chars."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of("url"))
    place = F.struct(F.isnull("page_id").alias("no_id"), "page_id", F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"))
    first = named.groupBy("host").agg(F.min(place).alias("first")).select("host", F.col("first.page_id").alias("page_id"), F.col("first.h").alias("h"))
    first = stage(first, "model-ids")
    key = named["page_id"].eqNullSafe(first["page_id"]) & (named["host"] == first["host"])
    model_pages = named.join(small(first), key & (F.xxhash64(F.coalesce(named["html"], F.lit(""))) == first["h"])).select(named["host"], named["html"])
    models = stage(model_pages.dropDuplicates(["host"]).mapInArrow(_models, "host string, model string"), "models")
    names = ["page_id", "url", "host"]
    schema = T.StructType([named.schema[c] for c in names]).add("blocks", T.ArrayType(T.StringType())).add("places", T.ArrayType(T.LongType())).add("codes", T.ArrayType(T.LongType())).add("heads", T.ArrayType(T.BooleanType())).add("has_main", "boolean").add("page", "long")
    joined = named.join(small(models, BROADCAST_BYTES, F.length("model") + 64), "host").select(*names, "html", "model")
    read = stage(joined.mapInArrow(_read(names), schema), "blocks")
    template = stage(_template(read), "template")
    out = read.join(small(template, BROADCAST_BYTES, 8 * F.size("constants") + 64), "host", "left")
    block = F.arrays_zip("blocks", "codes", "heads")
    varies = lambda code: ~F.coalesce(F.array_contains("constants", code), F.lit(False))
    # a heading of an article that stands over text of the page's own is content, on however many pages it is
    titles = lambda b, i: F.col("has_main") & b["heads"] & F.get("codes", i + 1).isNotNull() & varies(F.get("codes", i + 1))
    own = F.filter(block, lambda b, i: varies(b["codes"]) | titles(b, i))
    out = out.withColumn("own", own).withColumn("whole", F.col("has_main") & (2 * F.size("own") < F.size("blocks")))
    text = F.when(F.col("whole"), F.array_join("blocks", "\n\n")).otherwise(F.array_join(F.col("own.blocks"), "\n\n"))
    return out.select(*names, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("host")
