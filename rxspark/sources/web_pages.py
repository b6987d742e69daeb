"""Stored catalogue pages: key/value records, one wide table, and the list of pages to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rxspark.functions.text import collapse_spaces


# fixed values: markers of a detail page (".name" is a class, "name" a tag), and tags that never hold anything
TITLE, HEADER, CONTENT = ".main-title", ".detail-header", ".detail-content"
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
CLOSED_BY_NEXT = ["p", "option", "dt", "dd"]  # an element of these ends where the next of its kind begins
_TAG = r"""</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^"'>])*+>"""


def _marked(tag: Column, name: Column, marker: str) -> Column:
    """Whether an opening tag bears a marker. Attribute values may stand in either quotes, or in none."""
    if not marker.startswith("."):
        return name == marker
    values = [F.regexp_extract(tag, rf"(?is)\sclass\s*=\s*{pattern}", 1) for pattern in (r'"([^"]*)"', r"'([^']*)'", r"""([^\s"'>]+)""")]
    found = F.coalesce(*(F.when(v != "", v) for v in values), F.lit(""))
    return F.array_contains(F.split(found, r"\s+"), marker[1:])


def page_tags(html: Column) -> Column:
    """A page as its tags (place, text, name, and step: 1 opens, -1 closes, 0 neither) and the texts between them."""
    clean = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", ""), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    tags = F.transform(F.regexp_extract_all(clean, F.lit(_TAG), F.lit(0)), lambda t, i: F.struct(
        i.alias("i"), t.alias("tag"), F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"),
        F.when(F.startswith(t, F.lit("</")), -1).when(F.endswith(t, F.lit("/>")), 0).otherwise(1).alias("step"),
    ))
    tags = F.transform(tags, lambda t: t.withField("step", F.when(t["name"].isin(VOID_TAGS), 0).otherwise(t["step"])))
    return F.struct(tags.alias("tags"), F.split(clean, _TAG).alias("texts"))


def elements(page: Column, marker: str) -> Column:
    """Visible texts of all elements of a page (``page_tags``) that bear a marker, in page order.

    An element reaches to the tag that closes it: the first place behind its opening tag where as many tags of its name have closed as
    opened. Without such a tag it reaches to the page's end. Tags of one name are taken with the depth at which they open or
    close an element; in the order of (depth, place), a closing tag follows the opening tag that it belongs to. A page has to fit into
    a row.
    """
    tags, texts = page["tags"], page["texts"]

    def with_depth(name: Column) -> Column:
        """Tags of a name with the depth of their element, by depth and place."""
        nothing = F.array().cast("array<struct<depth:int,i:int,step:int>>")

        def step(a: Column, t: Column) -> Column:
            own = F.when(name.isin(CLOSED_BY_NEXT), 0).otherwise(a["now"] + F.greatest(t["step"], F.lit(0)))
            row = F.struct(own.alias("depth"), t["i"].alias("i"), t["step"].alias("step"))
            return F.struct((a["now"] + t["step"]).alias("now"), F.concat(a["rows"], F.array(row)).alias("rows"))

        start = F.struct(F.lit(0).alias("now"), nothing.alias("rows"))
        return F.aggregate(F.filter(tags, lambda t: (t["name"] == name) & (t["step"] != 0)), start, step, lambda a: F.array_sort(a["rows"]))

    def closing(rows: Column) -> Column:
        """Opening tags with the place where their element ends."""
        def pair(t: Column, i: Column) -> Column:
            after = F.get(rows, i + 1)
            return F.when(t["step"] == 1, F.struct(t["i"].alias("i"), F.when(after["depth"] == t["depth"], after["i"]).alias("end")))

        return F.array_compact(F.transform(rows, lambda t, i: pair(t, i)))

    def end(open_: Column, ends: Column) -> Column:
        return F.coalesce(F.element_at(ends, open_["i"]), F.size(tags))

    marked = F.filter(tags, lambda t: (t["step"] == 1) & _marked(t["tag"], t["name"], marker))
    names = F.array_distinct(F.transform(marked, lambda t: t["name"]))
    ends = F.map_from_entries(F.flatten(F.transform(F.transform(names, with_depth), closing)))
    # the text after tag i is texts[i + 1]; tags stand for white space between texts
    whole = F.transform(
        F.array(F.struct(marked.alias("marked"), ends.alias("ends"))),
        lambda p: F.transform(p["marked"], lambda t: inner_text(F.array_join(F.slice(texts, t["i"] + 2, end(t, p["ends"]) - t["i"]), "<>"))),
    )
    return whole[0]


def inner_text(html: Column) -> Column:
    """Visible text: tags dropped, common entities decoded, white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse_spaces(text)


def extract_records(
    pages: DataFrame, html: str = "html", title: str = TITLE, header: str = HEADER, content: str = CONTENT
) -> DataFrame:
    """``drug_name`` and a map ``record`` per page that has a title. Headers pair with contents up to
    the shorter list; blank headers are skipped; of equal headers the last one counts. Markers are classes or tags."""
    markers = {"_titles": title, "_headers": header, "_contents": content}
    rows = pages.withColumn("_page", page_tags(F.col(html))).withColumns({c: elements(F.col("_page"), m) for c, m in markers.items()})
    rows = rows.drop("_page").filter(F.size("_titles") > 0)
    pairs = F.arrays_zip(F.col("_headers").alias("key"), F.col("_contents").alias("value"))
    rows = rows.withColumn("_pairs", F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())).drop("_headers", "_contents")
    # the title is the first entry, so a header of the same name replaces it
    first = F.struct(F.lit("drug_name").alias("key"), F.get("_titles", F.lit(0)).alias("value"))
    entries = F.concat(F.array(first), F.filter("_pairs", lambda p: p["key"] != ""))
    rows = rows.withColumn("_entries", entries)
    keys_back = F.reverse(F.transform("_entries", lambda e: e["key"]))
    last_of_key = F.filter(
        "_entries", lambda e, i: i + F.array_position(keys_back, e["key"]) == F.size("_entries")
    )
    return rows.withColumn("record", F.map_from_entries(last_of_key)).drop("_titles", "_pairs", "_entries")


def widen_records(records: DataFrame, keep: list[str], headers: list[str]) -> DataFrame:
    """One column per header, null where a record lacks it. A projection: no pivot, no shuffle."""
    return records.select(*keep, *[F.col("record")[h].alias(h) for h in headers])


def record_headers(records: DataFrame) -> DataFrame:
    """Headers in use with the number of records that have them."""
    return (
        records.select(F.explode_outer(F.map_keys("record")).alias("header"))  # explode would make the records twice, to drop empty ones
        .groupBy("header").agg(F.count(F.lit(1)).alias("records"))
    )


def listing_urls(letters: DataFrame, base: str) -> DataFrame:
    """Pages to fetch per letter. The last all-digit part of the last pagination link is the page
    count, else one page; the first page has no page number in its URL."""
    last = F.when(F.size("hrefs") > 0, F.element_at("hrefs", -1))
    digits = F.filter(F.split(last, "/"), lambda p: p.rlike(r"^\d+$"))
    pages = F.coalesce(F.when(F.size(digits) > 0, F.element_at(digits, -1).try_cast("int")), F.lit(1))
    # a count of zero lists nothing
    numbers = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    rows = letters.select("letter", F.explode(numbers).alias("page"))
    folder = F.when(F.col("page") == 1, "").otherwise(F.concat(F.lit("page/"), F.col("page").cast("string"), F.lit("/")))
    return rows.withColumn("url", F.concat(F.lit(base + "/"), folder, F.lit("?lettre="), F.col("letter").cast("string")))
