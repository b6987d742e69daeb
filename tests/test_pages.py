"""Elements of stored pages against a parser of the standard library."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from rxspark.sources import web_pages


class Parser(HTMLParser):
    """Visible texts of the elements of a class, in the order of their opening tags."""

    def __init__(self, name):
        super().__init__(convert_charrefs=True)
        self.name, self.found, self.open, self.quiet = name, [], [], 0

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in ("script", "style")
        for e in self.found:
            e["text"] += " " if e["open"] else ""
            if e["open"] and tag == "p" == e["tag"]:
                e["open"] = 0
            elif e["open"] and tag == e["tag"]:
                e["open"] += 1
        if self.name in (dict(attrs).get("class") or "").split() and tag not in web_pages.VOID_TAGS:
            self.found.append({"tag": tag, "open": 1, "text": ""})

    def handle_startendtag(self, tag, attrs):
        for e in self.found:
            e["text"] += " " if e["open"] else ""

    def handle_endtag(self, tag):
        self.quiet -= tag in ("script", "style")
        for e in self.found:
            if e["open"]:
                e["text"] += " "
                e["open"] -= tag == e["tag"]

    def handle_data(self, data):
        for e in self.found:
            e["text"] += data if e["open"] and not self.quiet else ""


def page(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "div", "section", "p", "b"])
        mark = rng.choice(["", ' class="x key y"', " class='key'", " class=key", ' id="key" title="a > b"', ' class="keys"', '\n class = "key"'])
        inside = page(rng, depth + 1) if depth < 3 and tag != "p" and rng.random() < 0.7 else ""
        close = "" if tag == "p" and rng.random() < 0.3 else f"</{tag.upper() if rng.random() < 0.2 else tag}>"
        parts.append(f"<{tag}{mark}>{rng.choice(['un', 'deux &amp; 3', '', 'é'])}{inside}{close}")
        parts.append(rng.choice(["", "<br>", "<br/>", "texte", "<!-- <div class='key'>no</div> -->", "<script>var a = '<div class=\"key\">';</script>", '<img class="key" src="a">']))
    return "".join(parts)


def test_elements_like_a_parser(spark):
    rng = random.Random(5)
    pages = [page(rng) for _ in range(150)] + ["", "no tags", "<div class='key'>open <div>in</div> to the end", "</div><div class=key>a</div></div>", None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").withColumn("p", web_pages.page_tags(F.col("html")))
    got = {r.page_id: r.e for r in df.select("page_id", web_pages.elements(F.col("p"), ".key").alias("e")).collect()}
    some = 0
    for i, html in enumerate(pages):
        if html is None:
            assert not got[i]
            continue
        parser = Parser("key")
        parser.feed(html)
        parser.close()
        want = [" ".join(e["text"].split()) for e in parser.found]
        assert got[i] == want, html
        some += len(want)
    assert some > 100


def test_shipped_markers(spark):
    html = """<div class='main-title x'>DOLI <div>500</div> mg</div><p class=detail-header>PPV</p><div class="detail-content"><div>6 dhs</div> per
      <div>box</div></div><div class="detail-header">Statut</div><div class='a detail-content'>Commercialisé</div>"""
    record = web_pages.extract_records(spark.createDataFrame([(1, html)], "page_id int, html string")).first().record
    assert record == {"drug_name": "DOLI 500 mg", "PPV": "6 dhs per box", "Statut": "Commercialisé"}
